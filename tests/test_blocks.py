"""Products of all with all in blocks: nearest neighbours and ranking metrics are the same in one block and in many."""

import numpy as np
import pytest

from tessera.operators import openset, retrieval


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(90, 6))
    x[10:14] = x[0]  # ties
    labels = [None if i % 17 == 0 else int(v) for i, v in enumerate(rng.integers(0, 5, 90))]
    return spark.createDataFrame([(i, labels[i], (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(x)], "retrieval_id bigint, label int, embedding array<double>").cache()


def test_query_metrics_in_blocks(rows):
    one = {r.retrieval_id: r for r in retrieval.query_metrics(rows, 20).collect()}
    many = {r.retrieval_id: r for r in retrieval.query_metrics(rows, 20, block_bytes=8 * 6 * 25).collect()}
    assert set(one) == set(many) and len(one) > 70
    for i, r in one.items():
        assert (r.label, r.hits) == (many[i].label, many[i].hits)
        assert r.average_precision == pytest.approx(many[i].average_precision) and r.recall_at_k == pytest.approx(many[i].recall_at_k)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_nearest_in_blocks(spark, rows, k, monkeypatch):
    test = rows.selectExpr("retrieval_id as id", "embedding as features")
    train = rows.where("retrieval_id % 2 = 0").selectExpr("embedding as features")
    one = {r.id: r.knn for r in openset.knn_score(test, train, k).collect()}
    monkeypatch.setattr(openset, "BLOCK_ROWS", 13)
    many = {r.id: r.knn for r in openset.knn_score(test, train, k).collect()}
    assert many == pytest.approx(one) and len(many) == 90


def test_curves_by_stretches(spark):
    rng = np.random.default_rng(5)
    s, known = np.round(rng.normal(size=3000), 2), rng.random(3000) < 0.6
    s[known] += 0.7
    correct = known & (rng.random(3000) < 0.8)
    df = spark.createDataFrame([("a" if i % 2 else None, float(v), bool(k), bool(c)) for i, (v, k, c) in enumerate(zip(s, known, correct))], "g string, score double, known boolean, correct boolean")
    for stretches in (2, 64):
        got = {r.g: r for r in openset.osr_metrics(df, ["g"], stretches).collect()}
        for g, odd in (("a", 1), (None, 0)):
            at = np.arange(3000) % 2 == odd
            k, u, c = s[at & known], s[at & ~known], s[at & correct]
            pairs = lambda a: ((a[:, None] > u).sum() + 0.5 * (a[:, None] == u).sum()) / (len(k) * len(u))
            assert got[g].auroc == pytest.approx(pairs(k)) and got[g].oscr == pytest.approx(pairs(c))
            assert (got[g].known_samples, got[g].unknown_samples) == (len(k), len(u))
