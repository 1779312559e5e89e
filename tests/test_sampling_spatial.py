import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.functions import geometry, polygons
from tessera.operators import sampling, spatial


def points(spark, rows):
    return spark.createDataFrame([(i, "s", "C", float(c), float(x), float(y)) for i, (c, x, y) in enumerate(rows)], "id int, source_path string, class string, confidence double, center_x_geo double, center_y_geo double")


def test_dedup_chain_and_exact_distance(spark):
    # B is dropped for A and so cannot drop C; D stands exactly at the distance
    got = sampling.deduplicate(points(spark, [(0.9, 0, 0), (0.8, 2, 0), (0.7, 4, 0), (0.6, 0, 3)]), 3.0)
    assert sorted(r.id for r in got.collect()) == [0, 2, 3]


def test_dedup_equals_the_plain_loop(spark):
    rng = np.random.default_rng(0)
    rows = list(zip(rng.integers(0, 20, 300) / 20, rng.random(300) * 40, rng.random(300) * 40))
    kept = []
    for i in sorted(range(300), key=lambda i: (-rows[i][0], i)):
        if all(math.hypot(rows[i][1] - rows[j][1], rows[i][2] - rows[j][2]) >= 3 for j in kept):
            kept.append(i)
    df = points(spark, rows)
    once = sampling.deduplicate(df, 3.0)
    assert sorted(r.id for r in once.collect()) == sorted(kept)
    assert once.count() == sampling.deduplicate(once, 3.0).count()


def test_splits_are_whole_and_leak_free(spark):
    rows = [(y, f"p{y}_{i}") for y, n in ((2023, 1), (2024, 9), (2025, 10)) for i in range(n)]
    got = sampling.source_splits(spark.createDataFrame(rows, "year int, source_path string")).collect()
    test = [sum(r.split == "test" and r.source_path.startswith(f"p{y}") for r in got) for y in (2023, 2024, 2025)]
    assert test == [1, 1, 2] and len(got) == 20  # a year of one source is all test; int(1.8) is 1
    both = spark.createDataFrame([(2023, "a"), (2025, "a")] + [(2025, f"b{i}") for i in range(9)], "year int, source_path string")
    a = {r.source_path: r.split for r in sampling.source_splits(both).collect()}["a"]
    only = {r.source_path: r.split for r in sampling.source_splits(both.where("year = 2025")).collect()}["a"]
    assert a == only  # the last year decides


def test_validation_counts(spark):
    df = spark.createDataFrame([(i, "A", 1) for i in range(10)] + [(10, "B", 1)], "id int, class string, year int")
    got = sampling.validation_split(df, 0.25).where("validation").groupBy("class").count().collect()
    assert {r["class"]: r["count"] for r in got} == {"A": 2, "B": 1}  # 2.5 rounds to 2; one row is validation
    assert sampling.cap_groups(df, None).count() == 11 and sampling.cap_groups(df, 3).count() == 4
    m = df.withColumn("split", F.lit("train"))
    train, val = (sampling.role(m, r, ["A", "B"]) for r in ("train", "validation"))
    assert train.count() + val.count() == 11 and not train.join(val, "id").count()
    with pytest.raises(ValueError):
        sampling.role(m, "test_known", ["A"])
    with pytest.raises(ValueError):
        sampling.threshold(df, ["A"], ["A"])


def manifest(spark, sizes, positive=1):
    return spark.createDataFrame([(f"{s}{i}", s, 2023, positive, i % 3) for s, n in sizes for i in range(n)], "key string, site string, year int, is_positive int, other_crown_count int")


def test_held_out_sites(spark):
    got = sampling.held_out_sites(manifest(spark, [("a", 9), ("b", 7), ("c", 7), ("d", 5)]), 0.2)
    assert sorted(r.site for r in got.collect()) == ["b", "c"]  # the largest is skipped, two are taken
    many = sampling.held_out_sites(manifest(spark, [("a", 9), ("b", 4), ("c", 2), ("d", 2), ("e", 1)]), 0.4)
    assert sorted(r.site for r in many.collect()) == ["b", "c", "d"]
    with pytest.raises(ValueError, match="z"):
        sampling.held_out_sites(manifest(spark, [("a", 2)]), sites=["a", "z"])


def test_folds(spark):
    sizes = [("a", 9), ("b", 7), ("c", 7), ("d", 5), ("e", 4), ("f", 4)]
    m = manifest(spark, sizes)
    got = {r.site: r.fold for r in sampling.balanced_folds(m).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4, "f": 4}
    roles = sampling.fold_roles(m, sampling.balanced_folds(m)).collect()
    assert len(roles) == 5 * 36 and sum(r.role == "val" for r in roles) == 36


def test_negatives(spark):
    got = sampling.sample_negatives(manifest(spark, [("a", 60)], 0), 5, 3.0, 0.7).collect()
    assert len(got) == 15 and sum(r.hard for r in got) == 10  # round(10.5) is 10
    assert all(r.other_crown_count == 2 for r in got if r.hard) and len({r.key for r in got}) == 15
    assert sampling.sample_negatives(manifest(spark, [("a", 4)], 0), 5).count() == 4


def test_weighted_sample(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 3.0), (2, 0.0)], "id int, weight double")
    got = sampling.weighted_sample(df, 4000).groupBy("id").count().collect()
    share = {r.id: r["count"] / 4000 for r in got}
    assert set(share) == {0, 1} and share[1] == pytest.approx(0.75, abs=0.03)


def boxes(spark, rows, **more):
    return spark.createDataFrame([(i, 0, c, *map(float, b)) for i, (c, *b) in enumerate(rows)], "id int, plot int, confidence double, minx double, miny double, maxx double, maxy double")


@pytest.mark.parametrize("cell", [0.7, 5.0, 100.0])
def test_grid_join_finds_each_pair_once(spark, cell):
    rng = np.random.default_rng(5)
    at, size = rng.random((120, 2)) * 60 - 30, rng.exponential(3, (120, 2))
    size[3] = 80
    b = boxes(spark, [(0.5, *p, *(p + s)) for p, s in zip(at, size)] + [(0.5, 0, 0, 10, 10), (0.5, 10, 10, 20, 20)])
    rows = b.collect()
    want = sorted((l.id, r.id) for l in rows for r in rows if l.minx <= r.maxx and r.minx <= l.maxx and l.miny <= r.maxy and r.miny <= l.maxy)
    got = sorted((r.l.id, r.r.id) for r in spatial.grid_join(b, b, cell, ("plot",)).collect())
    assert got == want


def test_suppression_keeps_the_threshold(spark):
    b = boxes(spark, [(0.9, 0, 0, 10, 10), (0.8, 0, 0, 10, 10), (0.7, 5, 0, 15, 10), (0.6, 20, 0, 30, 10)]).withColumnRenamed("plot", "tile")
    assert sorted(r.id for r in spatial.suppress(b, 0.7).collect()) == [0, 2, 3]
    assert sorted(r.id for r in spatial.suppress(b, 1 / 3).collect()) == [0, 2, 3]  # an overlap of one third is kept
    assert sorted(r.id for r in spatial.suppress(b, 0.3).collect()) == [0, 3]


def test_matching_cases(spark):
    crowns = boxes(spark, [(1.0, 0, 0, 10, 10)])
    preds = boxes(spark, [(None, 0, 0, 10, 10), (0.5, 0, 0, 10, 9)])
    m = spatial.match(spatial.iou_pairs(preds, crowns, 8.0, ("plot",)), 0.5)
    assert [(r.prediction, r.crown) for r in m.collect()] == [(1, 0)]  # a missing confidence counts as 0
    one = lambda p, c: tuple(spatial.match_counts(spatial.match(spatial.iou_pairs(p, c, 8.0, ("plot",))), p, c).select("true_positive", "false_positive", "false_negative").first())
    assert one(preds, crowns) == (1, 1, 0) and one(preds, crowns.limit(0)) == (0, 2, 0) and one(preds.limit(0), crowns) == (0, 0, 1)
    total = spatial.match_totals(spatial.match_counts(m, preds.limit(0), crowns.limit(0))).first()
    assert (total.precision, total.f1) == (0.0, 0.0)
    assert spatial.confident(preds, 0.0).count() == 2 and spatial.confident(preds, 0.1).count() == 1


def test_dissolve_needs_a_common_edge(spark):
    b = boxes(spark, [(0.9, 0, 0, 1, 1), (0.8, 1, 1, 2, 2), (0.7, 1, 0, 2, 0.5), (0.6, 9, 9, 10, 10)])
    got = {r.id: r.component for r in spatial.dissolve_boxes(b, 1.0).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 3}


def test_tile_classes(spark):
    t = spark.createDataFrame([(v,) for v in (0.0, 0.05, 0.050001, 0.49, 0.5)], "visible double")
    assert [r.kind for r in spatial.classify_tiles(t).orderBy("visible").collect()] == ["negative", "negative", "discarded", "discarded", "positive"]


def test_tilers(spark):
    df = spark.createDataFrame([(n,) for n in (5, 10, 20, 23, 30)], "n int")
    at = lambda c: [r[0] for r in df.orderBy("n").select(c).collect()]
    assert at(geometry.offsets("n", F.lit(10), F.lit(10))) == [[0], [0], [0, 10], [0, 10, 13], [0, 10, 20]]
    assert at(geometry.inset_offsets("n", F.lit(10), 0.1, F.lit(10))) == [[], [], [2, 8], [2, 11], [3, 13, 17]]
    assert at(geometry.clamped_offsets("n", F.lit(10), F.lit(10))) == [[0], [0], [0, 10], [0, 10, 13], [0, 10, 20]]


def gon(n, r=10.0, shift=0.3):
    return [(r * math.cos(shift + 2 * math.pi * k / n), r * math.sin(shift + 2 * math.pi * k / n)) for k in range(n)]


def test_shapes():
    assert polygons.is_tile_cut([(0, 0), (10, 0), (10, 10), (0, 10)])
    assert not polygons.is_tile_cut(gon(24)) and polygons.is_tile_cut(gon(40))  # turns of 15 and of 9 degrees
    assert polygons.aspect_ratio([(0, 0), (4, 0), (4, 1), (0, 1)]) == pytest.approx(4)
    assert polygons.aspect_ratio([(0, 0), (3, 3), (2, 4), (-1, 1)]) == pytest.approx(3)
    assert polygons.aspect_ratio([(0, 0), (1, 0), (2, 0)]) == 999.0
    assert not polygons.is_valid([(0, 0), (2, 2), (2, 0), (0, 2)]) and polygons.is_valid(gon(7))
    parts = polygons.repair([(0, 0), (2, 2), (2, 0), (0, 2)])
    assert sorted(abs(polygons.ring_area(p)) for p in parts) == [1.0, 1.0]
    assert polygons.simplify([(0, 0), (5, 0.1), (10, 0), (10, 10), (0, 10)], 0.2) == [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert polygons.touches([(0, 0), (1, 0), (1, 1)], [(1, 1), (2, 1), (2, 2)]) and not polygons.touches([(0, 0), (1, 0), (1, 1)], [(3, 3), (4, 3), (4, 4)])


def star(seed, n=9):
    rng = random.Random(seed)
    cx, cy = rng.uniform(-3, 3), rng.uniform(-3, 3)
    radii = [rng.uniform(1, 6) for _ in range(n)]  # one for each direction: the outline does not cross itself
    return [(cx + r * math.cos(2 * math.pi * k / n), cy + r * math.sin(2 * math.pi * k / n)) for k, r in enumerate(radii)]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 10**6))
def test_polygon_overlap_by_sampling(a, b):
    p, q = star(a), star(b)
    assert sum(abs(polygons.ring_area(t)) for t in polygons.triangles(p)) == pytest.approx(abs(polygons.ring_area(p)))
    got = polygons.overlap_area(p, q)
    assert got == pytest.approx(polygons.overlap_area(q, p), abs=1e-9)
    assert 0 <= polygons.polygon_iou(p, q) <= 1 + 1e-12 and polygons.polygon_iou(p, p) == pytest.approx(1)
    rng = np.random.default_rng(a)
    xy = rng.uniform(-9, 9, (1500, 2))
    share = np.mean([polygons.inside(tuple(t), p) and polygons.inside(tuple(t), q) for t in xy])
    assert got == pytest.approx(share * 324, abs=4 * 324 * math.sqrt(max(share, 0.002) / 1500) + 1)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(3, 9))
def test_convex_overlap_equals_triangles(seed, n):
    p, q = star(seed), gon(n, 4.0, seed % 7)
    assert polygons.is_convex(q) and polygons.is_convex(q[::-1]) and not polygons.is_convex([(0, 0), (4, 0), (1, 1), (0, 4)])
    total = sum(abs(polygons.ring_area(part)) for t in polygons.triangles(p) for u in [list(t)] for part in [clip_by(u, q)])
    assert polygons.overlap_area(p, q) == pytest.approx(total, abs=1e-9) == polygons.overlap_area(q[::-1], p)


def clip_by(part, convex):
    for (x1, y1), (x2, y2) in zip(convex, convex[1:] + convex[:1]):
        nx, ny = y2 - y1, x1 - x2
        part = polygons.clip_half(part, nx, ny, nx * x1 + ny * y1) if part else part
    return part


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_clip_and_contours(seed):
    p = star(seed)
    inside = sum(abs(polygons.ring_area(polygons.clip_to_box(p, *w))) for w in ((-20, -20, 0.5, 20), (0.5, -20, 20, 20)))
    assert inside == pytest.approx(abs(polygons.ring_area(p)))
    mask = np.random.default_rng(seed).random((8, 9)) < 0.5
    rings = polygons.contours(mask)
    # outer outlines enclose the mask and its holes: filling each region's holes gives the same area
    filled = 0
    seen = np.zeros_like(mask)
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            region, todo = np.zeros_like(mask), [(y, x)]
            while todo:
                i, j = todo.pop()
                if 0 <= i < 8 and 0 <= j < 9 and mask[i, j] and not region[i, j]:
                    region[i, j] = True
                    todo += [(i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)]
            seen |= region
            outer, todo = np.zeros((10, 11), bool), [(0, 0)]
            solid = np.pad(region, 1)
            while todo:
                i, j = todo.pop()
                if 0 <= i < 10 and 0 <= j < 11 and not solid[i, j] and not outer[i, j]:
                    outer[i, j] = True  # the outside reaches through corners
                    todo += [(i + a, j + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
            filled += int((~outer).sum())
    assert sum(polygons.ring_area(r) for r in rings) == pytest.approx(filled)


def test_spatial_polygon_frames(spark):
    ring = lambda pts: [{"x": float(x), "y": float(y)} for x, y in pts]
    df = spark.createDataFrame([(1, ring([(0, 0), (2, 2), (2, 0), (0, 2)])), (2, ring(gon(8))), (3, []), (4, None), (5, ring([(0, 0), (1, 1)]))], f"id int, ring {geometry.RING}")
    fixed = spatial.repaired(df)
    assert {r.id: round(r.a, 6) for r in fixed.select("id", geometry.area("ring").alias("a")).collect()} == {1: 1.0, 2: round(abs(polygons.ring_area(gon(8))), 6)}
    cut = spatial.clipped(fixed.withColumns({"wx1": F.lit(100), "wy1": F.lit(0), "wx2": F.lit(101), "wy2": F.lit(1)}))
    assert [(r.clip, r.share) for r in cut.collect()] == [(None, 0.0)] * 2
