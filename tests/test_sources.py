import json
import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.text import state_name
from tessera.operators import detection, sampling
from tessera.sources import raster, sinks, tables, vector


def test_csv_checks(spark, tmp_path):
    p = str(tmp_path / "d.csv")
    with open(p, "w") as f:
        f.write("id,class_id\n1,a\n2,b\n")
    assert [tuple(r) for r in tables.read_annotations(spark, p).orderBy("id").collect()] == [("1", "a"), ("2", "b")]
    with pytest.raises(ValueError, match="missing"):
        tables.read_detections(spark, p)
    with open(p, "a") as f:
        f.write("1,c\n")
    with pytest.raises(ValueError, match="unique"):
        tables.read_annotations(spark, p)
    with open(p, "w") as f:
        f.write("year,site,key,is_positive,other_crown_count,source_tif,extra\n2023,s,007,1,0,t,x\n2025,s,8,nan,2,u,y\n")
    got = tables.read_manifest(spark, p).orderBy("year").collect()
    assert (got[0].key, got[0].is_positive, got[0].extra, got[1].is_positive) == ("007", 1, "x", None)
    assert tables.dataset_root("d/", None) == ("d", "d/manifest.csv") and tables.dataset_root("d", "e/m.csv") == ("e", "e/m.csv")


def test_configuration():
    c = tables.load_config(tables.DatasetConfig, "overlap: 0.25\n")
    assert c.overlap == 0.25 and c.tile_size_m == 56.0
    for bad in ("overlap: 1.5", "colour: red"):
        with pytest.raises(ValueError):
            tables.load_config(tables.DatasetConfig, bad)
    with pytest.raises(ValueError, match="overlap"):
        tables.load_config(tables.ExperimentConfig, {"known_classes": ["A"], "unknown_classes": ["A"]})


def test_state_and_resuming(spark, tmp_path):
    paths = spark.createDataFrame([("/r/a.tif",), ("/r/b.tif",), ("/r/c.tif",)], "path string")
    names = [r[0] for r in paths.select(state_name("path")).collect()]
    (tmp_path / names[0]).write_text(json.dumps({"positives": [{"key": "k", "site": "s", "year": 2023, "is_positive": 1, "source_tif": "t"}], "negatives": []}))
    (tmp_path / names[1]).write_text('{"positives": [')
    left = tables.unfinished(paths, tables.read_state(spark, str(tmp_path)))
    assert sorted(r.path for r in left.collect()) == ["/r/b.tif", "/r/c.tif"]


SQUARE = [[0, 0], [4, 0], [4, 3], [0, 3], [0, 0]]


def wkb(ring, kind=3):
    body = struct.pack("<I", 1) + struct.pack("<I", len(ring)) + b"".join(struct.pack("<2d", *p) for p in ring)
    one = struct.pack("<BI", 1, 3) + body
    return one if kind == 3 else struct.pack("<BII", 1, 6, 2) + one + one


def test_geojson(spark, tmp_path):
    doc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"FID": 7, "name": "Big Tree"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE, [[1, 1], [2, 1], [2, 2], [1, 1]]]}},
        {"type": "Feature", "properties": {"name": None}, "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [0, 0]}, {"type": "MultiPolygon", "coordinates": [[SQUARE], [SQUARE]]}]}},
        {"type": "Feature", "properties": {"name": "none"}, "geometry": None}]}
    (tmp_path / "l.geojson").write_text(json.dumps(doc))
    layer = vector.read_layer(spark, str(tmp_path / "l.geojson"))
    rows = layer.orderBy("feature", "part").collect()
    assert [(r.feature, r.part, r.maxx) for r in rows] == [(0, 0, 4.0), (1, 0, 4.0), (1, 1, 4.0), (2, 0, None)]
    assert len(rows[0].ring) == 4 and rows[0].attributes["name"] == "Big Tree"
    assert [r[0] for r in layer.where("part = 0").orderBy("feature").select(vector.identifier(layer)).collect()] == ["7", "1", "2"]
    assert vector.species(layer, "name", "big").count() == 1 and vector.species(layer, "name", "big", False).count() == 3


def test_geopackage_and_shapefile(spark, tmp_path):
    con = sqlite3.connect(tmp_path / "l.gpkg")
    con.execute("create table gpkg_geometry_columns (table_name, column_name, srs_id)")
    con.execute("insert into gpkg_geometry_columns values ('crowns', 'geom', 32718)")
    con.execute("create table crowns (fid integer, species text, geom blob)")
    head = b"GP\0\x01" + struct.pack("<i", 32718)
    con.executemany("insert into crowns values (?, ?, ?)", [(3, "a", head + wkb(SQUARE)), (4, "b", head + wkb(SQUARE, 6)), (5, None, None)])
    con.commit()
    con.close()
    rows = vector.read_layer(spark, str(tmp_path / "l.gpkg")).orderBy("feature", "part").collect()
    assert [(r.feature, r.part, r.crs, r.attributes["fid"]) for r in rows] == [(0, 0, "EPSG:32718", "3"), (1, 0, "EPSG:32718", "4"), (1, 1, "EPSG:32718", "4"), (2, 0, "EPSG:32718", "5")]
    points = SQUARE[::-1]  # clockwise: an outer ring
    shape = struct.pack("<i4d2i", 5, 0, 0, 4, 3, 1, len(points)) + struct.pack("<i", 0) + b"".join(struct.pack("<2d", *p) for p in points)
    (tmp_path / "l.shp").write_bytes(b"\0" * 100 + struct.pack(">2i", 1, len(shape) // 2) + shape)
    field = b"NAME".ljust(11, b"\0") + b"C" + b"\0" * 4 + bytes([6]) + b"\0" * 15
    (tmp_path / "l.dbf").write_bytes(b"\x03\0\0\0" + struct.pack("<IHH", 1, 65, 7) + b"\0" * 20 + field + b"\r" + b" " + b"oak   ")
    row, = vector.read_layer(spark, str(tmp_path / "l.shp")).collect()
    assert row.attributes == {"NAME": "oak"} and (row.minx, row.maxx, row.maxy) == (0.0, 4.0, 3.0)


def test_projection():
    # a point whose coordinates in both systems are published with the zone's definition: the crossing of meridian and equator
    assert vector.reproject([(-75.0, 0.0)], "EPSG:4326", "EPSG:32618")[0] == pytest.approx((500000.0, 0.0), abs=1e-6)
    for lon, lat, zone in ((-74.2, -8.4, "EPSG:32718"), (12.5, 41.9, "EPSG:32633"), (-76.9, 60.1, "EPSG:32618")):
        x, y = vector.reproject([(lon, lat)], "EPSG:4326", zone)[0]
        assert vector.reproject([(x, y)], zone, "EPSG:4326")[0] == pytest.approx((lon, lat), abs=1e-8)
    # a small step north is as long as the meridian's radius of curvature says, by the scale of the zone
    a, e2, lat = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563, math.radians(45)
    step = vector.reproject([(15.0, 45.0), (15.0, 45.0001)], "EPSG:4326", "EPSG:32633")
    radius = a * (1 - e2) / (1 - e2 * math.sin(lat) ** 2) ** 1.5
    assert step[1][1] - step[0][1] == pytest.approx(0.9996 * radius * math.radians(0.0001), rel=1e-5)
    with pytest.raises(ValueError):
        vector.reproject([(0, 0)], "EPSG:3857", "EPSG:4326")


@pytest.mark.parametrize("dtype,deflate", [("u1", True), ("u2", False), ("f4", True)])
def test_tiff_windows(dtype, deflate):
    a = (np.random.default_rng(0).random((4, 150, 90)) * 200).astype(dtype)
    t = raster.Tiff(raster.write_tiff(a, [0.05, 0, 500000, 0, -0.05, 9000000], 32718, 0, deflate))
    assert (t.width, t.height, t.count, t.crs, t.nodata) == (90, 150, 4, "EPSG:32718", 0.0)
    assert t.transform == [0.05, 0.0, 500000.0, 0.0, -0.05, 9000000.0]
    assert (t.read(0, 0, 90, 150) == a).all() and (t.read(10, 60, 33, 71) == a[:, 60:131, 10:43]).all()
    with pytest.raises(ValueError):
        raster.Tiff(b"GIF89a..")


def test_png_round_trip():
    a = np.random.default_rng(1).integers(0, 255, (9, 7, 3), dtype=np.uint8)
    assert (raster.from_png(raster.to_png(a)) == a).all() and (raster.from_png(raster.to_png(a[:, :, 0])) == a[:, :, 0]).all()


def square_segmenter(given):
    """Finds the red square of a test image: one anchor, one prototype that is the red share."""
    red = given[0, 0] > 0.9
    n = given.shape[2]
    boxes = np.zeros((1, 4 + 1 + 2, 2), np.float32)
    if red.any():
        ys, xs = np.nonzero(red)
        boxes[0, :5, 0] = ((xs.min() + xs.max() + 1) / 2, (ys.min() + ys.max() + 1) / 2, np.ptp(xs) + 1, np.ptp(ys) + 1, 0.9)
        boxes[0, :5, 1] = boxes[0, :5, 0] * (1, 1, 1, 1, 0.5)  # a weaker double, to be suppressed
        boxes[0, 5, :] = 20
    prototypes = np.zeros((1, 2, n, n), np.float32)
    prototypes[0, 0] = np.where(red, 1, -1)
    return boxes, prototypes


def square_detector(rgb, confidence, iou):
    ys, xs = np.nonzero(rgb[:, :, 0] > 230)
    return [("tree_x", 0.9123456789, int(xs.min()), int(ys.min()), int(xs.max()) + 1, int(ys.max()) + 1)] if len(xs) else []


def test_rasters_to_crowns(spark, tmp_path):
    a = np.full((4, 200, 200), 60, np.uint8)
    a[3] = 255
    a[0, 40:80, 50:90] = 255
    a[:, 120:, 120:] = 0
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "p_1.tif").write_bytes(raster.write_tiff(a, [0.1, 0, 1000, 0, -0.1, 2000], 32718))
    (tmp_path / "in" / "bad.TIF").write_bytes(b"nothing")
    files = raster.find_rasters(spark, str(tmp_path / "in"))
    assert files.count() == 2 and raster.find_rasters(spark, str(tmp_path / "in"), limit=1).count() == 1
    meta = raster.plausible(raster.metadata(files))
    assert [(r.width, r["count"], r.crs) for r in meta.collect()] == [(200, 4, "EPSG:32718")]
    windows = meta.select("path", F.explode(F.array(*[F.lit(v) for v in (0, 100)])).alias("row_off")).withColumn("col_off", F.explode(F.array(F.lit(0), F.lit(100)))).withColumns({"width": F.lit(100), "height": F.lit(100)})
    tiles = raster.read_tiles(files, windows)
    assert tiles.count() == 4 and raster.with_data(tiles).count() == 3 and raster.with_cover(tiles, 0.9).count() == 3
    found = detection.segment_tiles(tiles, meta, square_segmenter, size=100).collect()
    assert len(found) == 1
    r = found[0]
    assert (r.minx, r.maxx, r.miny, r.maxy) == pytest.approx((1005.0, 1009.0, 1992.0, 1996.0), abs=0.11) and r.confidence == pytest.approx(0.9)
    d, = detection.scan_tiles(tiles, meta, square_detector, year=2025).collect()
    assert (d["class"], d.confidence, d.year, d.tif, d.x1, d.y2) == ("TREE", 0.912346, 2025, "p_1.tif", 50, 80)
    assert (d.center_x_geo, d.center_y_geo) == pytest.approx((1007.0, 1994.0))
    path = meta.first().path
    rings = spark.createDataFrame([(path, "a", [(50.0, 40.0), (90.0, 40.0), (90.0, 80.0), (50.0, 80.0)]), (path, "b", [(900.0, 0.0), (901.0, 0.0), (901.0, 1.0)])], "path string, source_id string, ring array<struct<x: double, y: double>>")
    got = {r.source_id: r for r in detection.embed_polygons(rings, files, detection.mean_colour_encoder(2), 16).collect()}
    assert np.linalg.norm(got["a"].embedding) == pytest.approx(1) and got["b"].embedding is None and got["b"].reason == "no crop"
    images = sinks.encode_tiles(tiles, 32).select("image").collect()
    assert all(raster.from_png(bytes(i.image)).shape == (32, 32, 3) for i in images)


def test_sinks(spark, tmp_path):
    layer = spark.createDataFrame([(1, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)])], "id int, ring array<struct<x: double, y: double>>")
    sinks.write_geojson(layer, str(tmp_path / "g"))
    feature = json.loads(spark.read.text(str(tmp_path / "g")).first().value)
    assert feature["properties"] == {"id": 1} and feature["geometry"]["coordinates"] == [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    sinks.write_index(layer, str(tmp_path / "i"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_index(layer, str(tmp_path / "i"))
    sinks.write_index(layer, str(tmp_path / "i"), overwrite=True)
    tiles = spark.createDataFrame([("a",), ("b",)], "key string")
    lines = spark.createDataFrame([("a", "0 1"), ("a", "0 0")], "key string, line string")
    labels = sinks.label_files(lines, tiles)
    assert sorted(map(tuple, labels.collect())) == [("a", "0 0\n0 1\n"), ("b", "")]
    roles = tiles.withColumn("role", F.lit("val"))
    sinks.write_partitioned_text(sinks.split_lists(roles, "x", "/d"), str(tmp_path / "s"), "file")
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/s/*").collect()) == ["/d/images/a.jpg", "/d/images/b.jpg"]
    assert "nc: 1" in sinks.split_yaml("x", "/d", ["crown"])
    sinks.write_csv(tiles, str(tmp_path / "c"), ["key"])
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 2
    sinks.write_report(sampling.site_positive_counts(spark.createDataFrame([("s", 2023, 1)], "site string, year int, is_positive int")), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().positives == 1


def test_bilinear_and_stretch():
    from tessera.functions.polygons import resize_bilinear, stretch

    x = np.arange(12, dtype=np.float32).reshape(3, 4)
    assert (resize_bilinear(x, 4, 3) == x).all()
    assert resize_bilinear(x, 8, 6).shape == (6, 8) and resize_bilinear(np.ones((2, 2, 3)), 5, 7).shape == (7, 5, 3)
    assert resize_bilinear(np.array([[0.0, 4.0]]), 4, 1)[0].tolist() == [0, 1, 3, 4]
    s = stretch(np.linspace(0, 1000, 101))
    assert s.dtype == np.uint8 and s[0] == 0 and s[-1] == 255 and s[50] == 127
