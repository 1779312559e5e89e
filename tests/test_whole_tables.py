"""Registered spatial queries over all rows of a small table, against their SQL and each other."""

import duckdb
import pytest

from tessera.plans import spatial_queries

NAMES = ["visible_fraction", "tile_classify", "yolo_lines", "dissolve", "component_summary", "centre_hit", "crown_outcomes", "crown_layer", "match_centroid"]


@pytest.fixture(scope="module")
def orders(spark, tmp_path_factory):
    """Orders of one plot and tile, with keys of every remainder."""
    sf = str(tmp_path_factory.mktemp("orders"))
    spark.createDataFrame([(i, 60 * (i % 3)) for i in range(1, 61)], "o_orderkey bigint, o_custkey bigint").write.parquet(f"{sf}/orders.parquet")
    return sf


def rounded(rows):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_queries_equal_their_sql(spark, orders, name):
    df = spatial_queries.QUERIES[name](spark, orders)
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{orders}/orders.parquet/*.parquet')")
    found = con.execute(spatial_queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert rounded(df.select(*columns).collect()) == rounded(found.fetchall())


def test_fragments_are_all_boxes(spark, orders):
    parts = {r.component: r.n_frag for r in spatial_queries.component_summary(spark, orders).collect()}
    labels = [r.component for r in spatial_queries.dissolve(spark, orders).collect()]
    assert len(labels) == 60 and set(labels) == set(parts) and all(parts[c] >= labels.count(c) for c in parts)
    judged = spatial_queries.crown_outcomes(spark, orders).collect()
    assert sum(r.n for r in judged) == len(parts)
    assert {r.component for r in spatial_queries.centre_hit(spark, orders).collect()} <= set(parts)
    assert spatial_queries.crown_layer(spark, orders).count() == sum(r.n for r in judged if r.outcome == "kept")
