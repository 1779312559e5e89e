"""Commands from rasters to layers and data sets, on small made-up rasters."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import registry
from tessera.operators import detection, openset
from tessera.plans import commands  # noqa: F401  registers them
from tessera.sources import raster, sinks, vector


def scene(path, squares, site=(1000.0, 2000.0), size=400, epsg=32718):
    """A grey raster of 0.1 m with red squares (col, row, side)."""
    a = np.full((4, size, size), 60, np.uint8)
    a[3] = 255
    for x, y, n in squares:
        a[0, y : y + n, x : x + n] = 255
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(raster.write_tiff(a, [0.1, 0, site[0], 0, -0.1, site[1]], epsg))


def layer(path, boxes, epsg=32718, **attributes):
    ring = lambda a, b, c, d: [[a, b], [c, b], [c, d], [a, d], [a, b]]
    features = [{"type": "Feature", "properties": {k: v[i] if isinstance(v, list) else v for k, v in attributes.items()}, "geometry": {"type": "Polygon", "coordinates": [ring(*b)]}} for i, b in enumerate(boxes)]
    with open(path, "w") as f:
        json.dump({"type": "FeatureCollection", "crs": {"properties": {"name": f"EPSG:{epsg}"}}, "features": features}, f)
    return str(path)


def ground(x, y, n, site=(1000.0, 2000.0)):
    """The box of a square of pixels on the ground."""
    return site[0] + x / 10, site[1] - (y + n) / 10, site[0] + (x + n) / 10, site[1] - y / 10


def test_windows_are_read_alone(spark, tmp_path):
    scene(f"{tmp_path}/in/a_1.tif", [(10, 20, 30)])
    (tmp_path / "in" / "bad.tif").write_bytes(b"nothing")
    listed = raster.list_rasters(spark, [(2025, str(tmp_path / "in"))])
    meta = raster.mapped_metadata(listed)
    assert listed.count() == 2 and meta.count() == 1
    windows = listed.select("path", F.lit(20).alias("row_off"), F.lit(10).alias("col_off"), F.lit(30).alias("width"), F.lit(500).alias("height"))
    tile, = raster.read_windows(windows).collect()
    assert (tile.width, tile.height) == (30, 380) and raster.as_array(tile.asDict())[0, :30].min() == 255
    files = raster.find_rasters(spark, str(tmp_path / "in"))
    same, = raster.read_tiles(files, windows).collect()
    assert bytes(same.pixels) == bytes(tile.pixels)
    path = meta.first().path
    rings = spark.createDataFrame([(path, "a", [(10.0, 20.0), (40.0, 20.0), (40.0, 50.0), (10.0, 50.0)]), (path, "b", [(900.0, 0.0), (901.0, 0.0), (901.0, 1.0)])], "path string, source_id string, ring array<struct<x: double, y: double>>")
    encoder = detection.mean_colour_encoder(2)
    one = {r.source_id: (r.embedding, r.reason) for r in detection.embed_polygons(rings, files, encoder, 16).collect()}
    two = {r.source_id: (r.embedding, r.reason) for r in detection.embed_windows(rings, encoder, 16).collect()}
    assert one == two and one["b"] == (None, "no crop")


def test_scan(spark, tmp_path):
    scene(f"{tmp_path}/in/b_1.tif", [(120, 130, 30)])
    counts = registry.run("scan", spark, detector="tests.test_sources:square_detector", source=f"2025={tmp_path}/in", output=f"{tmp_path}/d.csv", tile_size=200, stride=100, margin_ratio=0.0).collect()
    assert [(r.year, r["class"]) for r in counts] == [(2025, "TREE")] and counts[0].detections >= 4
    got = spark.read.csv(f"{tmp_path}/d.csv", header=True, inferSchema=True)
    whole = [r for r in got.collect() if r.x2 - r.x1 == 30 and r.y2 - r.y1 == 30]
    assert whole and all((r.center_x_geo, r.center_y_geo) == pytest.approx((1013.5, 1985.5)) for r in whole)
    for bad in ("nowhere", "x=/y"):
        with pytest.raises(ValueError, match="YEAR"):
            registry.run("scan", spark, detector="tests.test_sources:square_detector", source=bad, output=f"{tmp_path}/x")


def test_detect(spark, tmp_path):
    scene(f"{tmp_path}/in/c_1.tif", [(170, 170, 60)])  # four tiles of 20 m with half of it in common see it
    layer_ = registry.run("detect", spark, rasters=f"{tmp_path}/in", model="tests.test_sources:square_segmenter", output=f"{tmp_path}/crowns", tile_m=20.0, size=200, least_area=10.0, cell=10.0).collect()
    assert len(layer_) == 1
    r = layer_[0]
    assert r.id == 1 and r.confidence == pytest.approx(0.9) and r.area_m2 == pytest.approx(36.0, abs=1.5) and r.redet_conf == pytest.approx(0.9) and r.redet_iou > 0.9
    assert json.loads(spark.read.text(f"{tmp_path}/crowns").first().value)["properties"]["id"] == 1


def test_build_tiles(spark, tmp_path):
    scene(f"{tmp_path}/t23/s1_x.tif", [(40, 40, 60), (300, 300, 40)])
    scene(f"{tmp_path}/t25/p_s2_x.tif", [(100, 100, 60)], site=(5000.0, 2000.0))
    a = layer(tmp_path / "a.geojson", [ground(40, 40, 60), ground(300, 300, 40)], species=["Oak alba", "Elm"])
    b = layer(tmp_path / "b.geojson", [ground(100, 100, 60, (5000.0, 2000.0))], species="oak")
    (tmp_path / "c.yaml").write_text(
        f"output_dir: {tmp_path}/out\nshapefile_2023: {a}\nshapefile_2025: {b}\ntif_root_2023: {tmp_path}/t23\ntif_root_2025: {tmp_path}/t25\n"
        "species_field: species\ntarget_species_substring: oak\ntile_size_m: 20.0\noutput_pixels: 64\nnegative_to_positive_ratio: 1.0\n"
    )
    counts = {(r.year, r.is_positive): r.tiles for r in registry.run("build-tiles", spark, config=str(tmp_path / "c.yaml")).collect()}
    assert counts[2023, 1] >= 2 and counts[2025, 1] >= 2 and counts.get((2023, 0), 0) + counts.get((2025, 0), 0) > 0
    manifest = spark.read.csv(f"{tmp_path}/out/manifest", header=True, inferSchema=True).collect()
    assert {os.path.splitext(f)[0] for f in os.listdir(tmp_path / "out" / "images")} == {r.key for r in manifest} == {os.path.splitext(f)[0] for f in os.listdir(tmp_path / "out" / "labels")}
    for r in manifest:
        lines = (tmp_path / "out" / "labels" / f"{r.key}.txt").read_text().split("\n")[:-1]
        assert bool(lines) == bool(r.is_positive)
        image = raster.from_png((tmp_path / "out" / "images" / f"{r.key}.png").read_bytes())
        assert image.shape == (64, 64, 3)
        for line in lines:  # labels lie where the red is
            points = np.array(line.split()[1:], float).reshape(-1, 2)
            x, y = (points.min(axis=0) + points.max(axis=0)) / 2 * 63
            assert image[int(y), int(x), 0] > 200
    assert {r.site for r in manifest} == {"s1", "2025-s2"}
    assert max(r.other_crown_count for r in manifest) >= 1  # tiles with the elm come first among the negatives


def test_crown_metrics_over_several_rasters(spark, tmp_path):
    scene(f"{tmp_path}/a.tif", [])
    scene(f"{tmp_path}/b.tif", [], site=(5000.0, 2000.0))
    truth = layer(tmp_path / "t.geojson", [ground(0, 0, 100), ground(200, 200, 100), ground(0, 0, 100, (5000.0, 2000.0)), (0, 0, 5, 5)], species="oak")
    p = layer(tmp_path / "p.geojson", [ground(2, 2, 100), ground(50, 300, 50)], species="x", confidence=[0.9, 0.3])
    q = layer(tmp_path / "q.geojson", [ground(1, 0, 100, (5000.0, 2000.0))], species="x", confidence=0.8)
    for mode in ("iou", "centroid"):
        r = registry.run("crown-metrics", spark, predictions=f"{p},{q}", rasters=f"{tmp_path}/a.tif,{tmp_path}/b.tif", ground_truth=truth, species_pattern="oak", mode=mode).first()
        assert (r.true_positive, r.false_positive, r.false_negative) == (2, 1, 1)
    r = registry.run("crown-metrics", spark, predictions=f"{p},{q}", rasters=f"{tmp_path}/a.tif,{tmp_path}/b.tif", ground_truth=truth, species_pattern="oak", minimum_confidence=0.5).first()
    assert (r.true_positive, r.false_positive, r.false_negative) == (2, 0, 1)
    with pytest.raises(ValueError, match="rasters"):
        registry.run("crown-metrics", spark, predictions=f"{p},{q}", rasters="one", ground_truth=truth)


def test_analysis_commands(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, int(v), f"c{v}" if v >= 0 else f"u{i % 2}", 2023 + i % 2 * 2, "train" if i % 3 == 0 and v >= 0 else "test", (rng.normal(size=4) * 0.3 + 3 * np.eye(4)[v] + (i % 2)).tolist()) for i, v in enumerate(rng.integers(-1, 3, 400))]
    spark.createDataFrame(rows, "id int, label int, class string, year int, split string, features array<double>").write.parquet(f"{tmp_path}/f")
    hard = registry.run("per-class", spark, features=f"{tmp_path}/f").collect()
    assert {r["class"] for r in hard} == {"u0", "u1"} and all(r.auroc > 0.8 for r in hard)
    gap = registry.run("domain-gap", spark, features=f"{tmp_path}/f").first()
    assert gap.domain_auc > 0.9 and gap.mean_cross_year_centroid_shift == pytest.approx(2.0, abs=0.2) and set(gap.per_class_cross_year_shift) == {"0", "1", "2"}
    spark.createDataFrame([(i, str(i), (rng.normal(size=3) + 3 * np.eye(3)[i % 3]).tolist()) for i in range(90)], "retrieval_id long, source_id string, embedding array<double>").write.parquet(f"{tmp_path}/i")
    spark.createDataFrame([(i, i % 3) for i in range(90)], "id int, class_id int").coalesce(1).write.csv(f"{tmp_path}/n.csv", header=True)
    seen = registry.run("visualize", spark, index=f"{tmp_path}/i", annotations=f"{tmp_path}/n.csv", output=f"{tmp_path}/v").first()
    assert (seen.cells, seen.points) == (9, 90) and "±" in spark.read.json(f"{tmp_path}/v/class_similarity").first().cell
    crops = "class,year,tif,split,confidence,source_path,relative_path\n"
    (tmp_path / "metadata_known.csv").write_text(crops + "".join(f"K,2023,t,test,0.9,/t,K{i}\n" for i in range(6)))
    (tmp_path / "metadata_unknown.csv").write_text(crops + "".join(f"U,2023,t,test_unknown,0.9,/t,U{i}\n" for i in range(6)))
    found = registry.run("lookalikes", spark, root=str(tmp_path), pairs="U:K:0.61", examples=2).collect()
    assert sorted((r.side, r.auroc) for r in found) == [("known", 0.61)] * 2 + [("unknown", 0.61)] * 2


def test_saved_heads_and_inference(spark, tmp_path):
    head, bias = np.array([[1.0, 0.0], [0.0, 1.0]]), np.array([0.5, -0.5])
    openset.Classifier(("A", "B"), (2023, 2025), head, bias).save(spark, f"{tmp_path}/head")
    back = openset.Classifier.load(spark, f"{tmp_path}/head", ["A", "B"])
    assert back.train_years == (2023, 2025) and (back.head == head).all() and (back.bias == bias).all()
    with pytest.raises(ValueError, match="apart"):
        openset.Classifier.load(spark, f"{tmp_path}/head", ["B", "A"])
    images = spark.createDataFrame([(i, raster.to_png(np.full((4, 4, 3), 10 * i, np.uint8))) for i in range(9)], "id int, image binary")
    got = detection.extract_outputs(images, lambda x: x.mean(axis=(1, 2))[:, :2], head, bias, 4).collect()
    assert {r.id: [round(v, 6) for v in r.logits] for r in got} == {i: [round(10 * i / 255 + 0.5, 6), round(10 * i / 255 - 0.5, 6)] for i in range(9)}
    batches = detection.shuffled_batches(images.select("id"), 4, seed=1).collect()
    assert sorted([sum(r.batch == b for r in batches) for b in range(3)]) == [1, 4, 4]
    other = {r.id: r.batch for r in detection.shuffled_batches(images.select("id"), 4, seed=1, epoch=1).collect()}
    assert other != {r.id: r.batch for r in batches}
    rgb = np.random.default_rng(0).integers(0, 255, (16, 16, 3)).astype(np.uint8)
    assert (detection.augment(rgb, 3) == detection.augment(rgb, 3)).all() and detection.augment(rgb, 3).shape == rgb.shape
    assert (detection.augment(rgb, 3) != detection.augment(rgb, 4)).any()
    assert {tuple(detection.augment(rgb, s, 0.0, 0.0).ravel()) for s in range(20)} == {tuple(a.ravel()) for a in (rgb, rgb[::-1], rgb[:, ::-1], rgb[::-1, ::-1])}


def test_packages_and_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.5, "a", [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0)]), (2, None, None, [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)])], "id int, score double, name string, ring array<struct<x: double, y: double>>")
    sinks.write_gpkg(rows.coalesce(1), f"{tmp_path}/g", 32718)
    back = {r.attributes["id"]: r for r in vector.read_layer(spark, f"{tmp_path}/g/*.gpkg").collect()}
    assert back["1"].crs == "EPSG:32718" and (back["1"].maxx, back["1"].attributes["name"], back["2"].attributes["score"]) == (2.0, "a", None)
    assert [(p.x, p.y) for p in back["2"].ring] == [(5.0, 5.0), (6.0, 5.0), (6.0, 6.0)]
    sinks.write_files(spark.createDataFrame([("x/a.txt", "é")], "name string, data string"), str(tmp_path))
    assert (tmp_path / "x" / "a.txt").read_text() == "é" and os.listdir(tmp_path / "x") == ["a.txt"]
    crops = spark.createDataFrame([("train", "OAK", 2023, "/t/s_1.tif", 7)], "split string, class string, year int, source_path string, number int")
    assert sinks.crop_paths(crops).first().relative_path == "train/OAK/OAK_2023_s_1_000007.png"
