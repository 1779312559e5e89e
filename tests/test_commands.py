import json

import numpy as np
import pytest

from tessera import cli, registry
from tessera.operators import openset
from tessera.streaming import detections

SF = "/root/testdata/sf0.001"


def test_registry():
    with pytest.raises(ValueError, match="missing"):
        registry.run("query", None, index="x")
    with pytest.raises(ValueError, match="unknown"):
        registry.run("query", None, index="x", query_id="1", colour="red")
    with pytest.raises(ValueError, match="already"):
        registry.register("query")(lambda spark: None)


def test_retrieval_commands(spark, tmp_path, capsys):
    e = spark.read.parquet(f"{SF}/embeddings.parquet")
    e.write.parquet(f"{tmp_path}/e")
    e.selectExpr("vec_id as id", "label as class_id", "vec_id % 3 as month").coalesce(1).write.csv(f"{tmp_path}/a.csv", header=True)
    run = lambda *a: (cli.main([str(x) for x in a]), [json.loads(x) for x in capsys.readouterr().out.splitlines()])[1]
    built, = run("build-index", "--candidates", f"{tmp_path}/e", "--output", f"{tmp_path}/i", "--id-column", "vec_id")
    assert built == {"rows": 500, "contiguous": True, "dimension": 64, "failed": 0}
    assert len(run("query", "--index", f"{tmp_path}/i", "--query-id", 7, "--top-k", 5)) == 5
    got, = run("evaluate", "--index", f"{tmp_path}/i", "--annotations", f"{tmp_path}/a.csv", "--month-column", "month", "--output", f"{tmp_path}/o")
    assert got["labeled_candidates"] == 500 and spark.read.csv(f"{tmp_path}/o/monthly_metrics", header=True).count() == 3
    assert len(run("similarity", "--index", f"{tmp_path}/i", "--annotations", f"{tmp_path}/a.csv")) == 100


def test_dataset_commands(spark, tmp_path):
    rng = np.random.default_rng(0)
    with open(tmp_path / "d.csv", "w") as f:
        f.write("year,tif,source_path,class,confidence,center_x_geo,center_y_geo,tile_x,tile_y,x1,y1,x2,y2\n")
        for i in range(400):
            f.write(f"{2023 + i % 2 * 2},t{i % 10},/t{i % 10},{'ABC'[i % 3]},{rng.random():.6f},{rng.random() * 90},{rng.random() * 90},0,0,{i},1,{i + 30},40\n")
    counts = registry.run("build-manifest", spark, detections=str(tmp_path / "d.csv"), known="A,B", unknown="C", output=f"{tmp_path}/o").collect()
    assert {r.kind for r in counts} == {"known", "unknown"}
    (tmp_path / "manifest.csv").write_text("key,site,year,is_positive,other_crown_count,source_tif\n" + "".join(f"k{i},s{i % 5},{2023 + i % 2 * 2},{i % 3 // 2},0,t\n" for i in range(90)))
    for name in ("split-ablation", "split-deploy"):
        parts = registry.run(name, spark, dataset=str(tmp_path), output=f"{tmp_path}/{name}").collect()
        assert all(r.positive + r.negative == r.total for r in parts)
    features = spark.createDataFrame([(i, int(v), 2023 + i % 2 * 2, "train" if i % 2 and v >= 0 else "test", (rng.normal(size=4) + 3 * np.eye(4)[v]).tolist(), (rng.normal(size=3) + (4 * np.eye(3)[v] if v >= 0 else 0)).tolist()) for i, v in enumerate(rng.integers(-1, 3, 200))], "id int, label int, year int, split string, features array<double>, logits array<double>")
    features.write.parquet(f"{tmp_path}/f")
    got = registry.run("evaluate-openset", spark, features=f"{tmp_path}/f").where("set = 'combined'").collect()
    assert len(got) == 8 and all(0 <= r.oscr <= 1 for r in got)


def test_crown_metrics_command(spark, tmp_path):
    def layer(name, boxes):
        ring = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
        doc = {"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"species": "Oak x", "confidence": 0.9 - i / 10}, "geometry": {"type": "Polygon", "coordinates": [ring(*b)]}} for i, b in enumerate(boxes)]}
        (tmp_path / name).write_text(json.dumps(doc))
        return str(tmp_path / name)

    p, t = layer("p.geojson", [(0, 0, 10, 10), (1, 0, 11, 10), (50, 50, 60, 60)]), layer("t.geojson", [(0, 0, 10, 9), (30, 30, 40, 40)])
    for mode in ("iou", "centroid"):
        r = registry.run("crown-metrics", spark, predictions=p, ground_truth=t, species_pattern="oak", mode=mode).first()
        assert (r.true_positive, r.false_positive, r.false_negative, r.precision) == (1, 2, 1, 0.3333)


def test_head_and_lookalikes(spark):
    rng = np.random.default_rng(1)
    rows = spark.createDataFrame([(i, int(v), (rng.normal(size=3) * 0.1 + np.eye(3)[v]).tolist()) for i, v in enumerate(rng.integers(0, 3, 90))], "id int, label int, features array<double>")
    head, bias = openset.train_head(rows, 3)
    assert openset.apply_head(rows, head, bias).where("predicted = label").count() == 90
    m = spark.createDataFrame([(c, s, f"{c}{i}") for c, s in (("U", "test_unknown"), ("K", "test"), ("K", "train")) for i in range(6)], "class string, split string, relative_path string")
    got = openset.lookalikes(m, [("U", "K", 0.6)], 4).groupBy("side").count().collect()
    assert {r.side: r["count"] for r in got} == {"unknown": 4, "known": 4}


def test_streams(spark, tmp_path):
    rows = lambda a, b: spark.createDataFrame([(i, f"2025-01-01 0{i % 3}:10:00") for i in range(a, b)], "id int, t string").selectExpr("id", "cast(t as timestamp) as t")
    rows(0, 6).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id int, t timestamp").parquet(f"{tmp_path}/in")
    for again in range(2):
        detections.append_new(stream(), f"{tmp_path}/out", f"{tmp_path}/c", ["id"]).awaitTermination()
        rows(3, 9).write.mode("append").parquet(f"{tmp_path}/in")
    assert sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(9))
    q = detections.windowed_counts(stream(), "t", []).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.sql("select sum(n) from counts").first()[0] == 18
