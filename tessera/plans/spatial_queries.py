"""Spatial operators over orders and parts: an order is a box on a plot or tile, a part a raster or a polygon."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import spatial
from .common import rounded, table

CELL = 16.0
BOXES = {
    "id": "o_orderkey",
    "plot": "cast(o_custkey % 60 as int)",
    "tile": "cast(o_custkey % 200 as int)",
    "confidence": "cast((o_orderkey * 7919) % 1000 as double) / 1000",
    "minx": "cast((o_orderkey * 37) % 240 as double) / 2",
    "miny": "cast((o_orderkey * 53) % 230 as double) / 2",
    "maxx": "cast((o_orderkey * 37) % 240 as double) / 2 + 4 + cast(o_orderkey % 23 as double) / 2",
    "maxy": "cast((o_orderkey * 53) % 230 as double) / 2 + 4 + cast(o_orderkey % 19 as double) / 2",
}
SELECT = ", ".join(f"{e} as {n}" for n, e in BOXES.items())
HEX = 6
#: Corners of the crowns of orders, as shares of their boxes: a skew quadrilateral for every third, an octagon for the others.
QUAD = ((0.25, 0.0), (1.0, 0.125), (0.75, 1.0), (0.0, 0.75))
OCTAGON = ((0.25, 0.0), (0.75, 0.0), (1.0, 0.25), (1.0, 0.75), (0.75, 1.0), (0.25, 1.0), (0.0, 0.75), (0.0, 0.25))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*[f"{e} as {n}" for n, e in BOXES.items()])


def crowns(df: DataFrame) -> DataFrame:
    """df with ring: the crown inside each box."""
    place = lambda u, v: F.struct((F.col("minx") + (F.col("maxx") - F.col("minx")) * F.lit(u)).alias("x"), (F.col("miny") + (F.col("maxy") - F.col("miny")) * F.lit(v)).alias("y"))
    return df.withColumn("ring", F.when(F.col("id") % 3 == 0, F.array(*[place(*c) for c in QUAD])).otherwise(F.array(*[place(*c) for c in OCTAGON])))


def polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hexagon per part, about a point of its key, of a radius of its size."""
    corner = lambda k: (F.cos(F.radians(F.lit(60.0 * k))), F.sin(F.radians(F.lit(60.0 * k))))
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") * 13 % 200).cast("double").alias("cx"), (F.col("p_partkey") * 29 % 190).cast("double").alias("cy"), (F.col("p_size") / 5 + 1).alias("r"))
    ring = F.array(*[F.struct((F.col("cx") + F.col("r") * corner(k)[0]).alias("x"), (F.col("cy") + F.col("r") * corner(k)[1]).alias("y")) for k in range(HEX)])
    return p.withColumn("ring", ring)


def split(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return b.where("id % 2 = 0"), b.where("id % 2 = 1")


def box_iou_join(spark, sf_dir):
    l, r = split(spark, sf_dir)
    return rounded(spatial.iou_pairs(l, r, CELL, ("plot",)).select(F.col("l.id").alias("left_id"), F.col("r.id").alias("right_id"), "iou"))


def nms_per_tile(spark, sf_dir):
    return spatial.suppress(boxes(spark, sf_dir), 0.3).select("id", "tile")


def match_iou(spark, sf_dir):
    l, r = split(spark, sf_dir)
    return rounded(spatial.match_boxes(l, r, 0.3))


def match_centroid(spark, sf_dir):
    l, r = (crowns(x) for x in split(spark, sf_dir))
    return spatial.match_centroids(l, r)


def match_counts(spark, sf_dir):
    l, r = split(spark, sf_dir)
    l, r = l.where("plot <> 7"), r.where("plot <> 9")
    return spatial.match_counts(spatial.match_boxes(l, r, 0.3), l, r)


def match_totals(spark, sf_dir):
    return spatial.match_totals(match_counts(spark, sf_dir))


def confident(spark, sf_dir):
    b = boxes(spark, sf_dir).withColumn("confidence", F.when(F.col("id") % 11 == 0, F.lit(float("nan"))).when(F.col("id") % 13 != 0, F.col("confidence")))
    return spatial.confident(b, 0.4).select("id")


def inside_footprint(spark, sf_dir):
    b = boxes(spark, sf_dir)
    f = b.select("plot").distinct().select("plot", F.lit(10.0).alias("minx"), (F.col("plot") / 2).alias("miny"), F.lit(70.0).alias("maxx"), (F.col("plot") / 2 + 50).alias("maxy"))
    return spatial.inside_footprint(b, f).select("id", "plot")


def _tiles(spark, sf_dir):
    """Tiles of 30 by 30 with a stride of 15, over a plot of 120 by 120, for every plot."""
    at = F.sequence(F.lit(0), F.lit(90), F.lit(15))
    t = boxes(spark, sf_dir).select("plot").distinct().withColumn("x", F.explode(at)).withColumn("y", F.explode(at))
    return t.select("plot", F.concat_ws("_", "x", "y").alias("tile"), F.col("x").cast("double").alias("minx"), F.col("y").cast("double").alias("miny"), (F.col("x") + 30.0).alias("maxx"), (F.col("y") + 30.0).alias("maxy"))


def _covered(spark, sf_dir):
    return spatial.polygon_cover(_tiles(spark, sf_dir), crowns(boxes(spark, sf_dir)), CELL)


def visible_fraction(spark, sf_dir):
    return rounded(_covered(spark, sf_dir).select("plot", "tile", "visible", F.col("crowns").cast("bigint").alias("crowns")))


def tile_classify(spark, sf_dir):
    return spatial.classify_tiles(_covered(spark, sf_dir)).select("plot", "tile", "kind")


def _fragments(spark, sf_dir):
    """Crowns spread over a wide plane, so that they form many components."""
    far = lambda c, m: (F.col(c) + F.col("id") % m * 40).alias(c)
    return crowns(boxes(spark, sf_dir).select("id", "confidence", far("minx", 97), far("miny", 89), far("maxx", 97), far("maxy", 89)))


def dissolve(spark, sf_dir):
    return spatial.dissolve(_fragments(spark, sf_dir), CELL)[0]


def _parts(spark, sf_dir):
    f = _fragments(spark, sf_dir)
    # no query asks for a union, or for what one shares with a hit
    return spatial.stitched(f, *spatial.dissolve(f, CELL), unions=False)


def _judged(spark, sf_dir):
    """The stitched crowns, and what a second look (the crowns moved a little, a third left out) finds at their centres."""
    parts, f = _parts(spark, sf_dir), _fragments(spark, sf_dir)
    shift = lambda c: (F.col(c) + F.col("id") % 7 - 3).alias(c)
    again = crowns(f.where("id % 4 <> 0").select("id", "confidence", *[shift(c) for c in spatial.BOX]))
    return parts, spatial.polygon_hits(parts, again, CELL)


def component_summary(spark, sf_dir):
    return _parts(spark, sf_dir).select("component", *spatial.BOX, "n_frag", "confidence")


def centre_hit(spark, sf_dir):
    return rounded(_judged(spark, sf_dir)[1].select("component", "hit", "distance", "redet_conf"))


def crown_outcomes(spark, sf_dir):
    return spatial.polygon_outcomes(*_judged(spark, sf_dir)).groupBy("judged", "outcome").agg(F.count(F.lit(1)).alias("n"))


def crown_layer(spark, sf_dir):
    layer = spatial.polygon_layer(spatial.polygon_outcomes(*_judged(spark, sf_dir)))
    return rounded(layer.select("id", "confidence", "area_m2", "redet_conf", F.size("ring").alias("corners")), 4)


def polygon_measures(spark, sf_dir):
    p = polygons(spark, sf_dir)
    c, b = geometry.centroid("ring"), geometry.bounds("ring")
    return rounded(p.select("p_partkey", geometry.area("ring").alias("area"), c["x"].alias("x"), c["y"].alias("y"), b["minx"].alias("minx"), b["maxy"].alias("maxy")))


def point_in_polygon(spark, sf_dir):
    p = polygons(spark, sf_dir).withColumn("px", F.col("cx") + F.col("p_partkey") % 7 - 3 + 0.01).withColumn("py", F.col("cy") + F.col("p_partkey") % 5 - 2 + 0.013)
    return rounded(p.select("p_partkey", geometry.contains("ring", "px", "py").alias("inside"), geometry.point_distance("ring", "px", "py").alias("distance")), 4)


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ring per part that few symmetries hide: a strip with a notch, long and straight or short and bent by its key."""
    n = lambda m: F.col("p_partkey") % m
    w, h = (n(11) + 2).cast("double"), (n(7) + 1).cast("double")
    at = lambda x, y: F.struct((x + n(5)).cast("double").alias("x"), (y + n(3)).cast("double").alias("y"))
    zero = F.lit(0.0)
    return table(spark, sf_dir, "part").select("p_partkey", F.array(at(zero, zero), at(w, zero), at(w, h), at(w / 2, h / 2 + n(13) / 8), at(zero, h)).alias("ring"))


def polygon_overlap(spark, sf_dir):
    """Intersection over union of hexagons of one plot (key modulo 20), by polygon clipping."""
    p = polygons(spark, sf_dir)
    b = geometry.bounds("ring")
    p = p.select("p_partkey", (F.col("p_partkey") % 20).alias("plot"), "ring", *[b[c].alias(c) for c in spatial.BOX])
    return rounded(spatial.polygon_overlaps(p, CELL, "p_partkey", by=("plot",)).where("iou > 1e-9"))


def polygon_shapes(spark, sf_dir):
    """Aspect, tile-cut test and area of notched strips."""
    t = spatial.shape_tests(spatial.repaired(strips(spark, sf_dir)))
    return rounded(t.select("p_partkey", F.round("aspect", 6).alias("aspect"), "tile_cut", geometry.area("ring").alias("area")))


def polygon_clip(spark, sf_dir):
    """The share of notched strips inside a window that cuts them on two sides, and how many parts it leaves."""
    p = strips(spark, sf_dir).withColumns({"wx1": (F.col("p_partkey") % 5 + 1).cast("double"), "wy1": F.lit(-9.0), "wx2": F.lit(99.0), "wy2": (F.col("p_partkey") % 3 + F.col("p_partkey") % 7 * 0.5 + 0.25).cast("double")})
    return rounded(spatial.clipped(p).select("p_partkey", "share"), 6)


def yolo_lines(spark, sf_dir):
    """Label lines of crowns on their tiles, kept from half a crown on."""
    return spatial.label_lines(_tiles(spark, sf_dir), crowns(boxes(spark, sf_dir)), CELL).select("plot", "tile", "id", "line")


def _rasters(spark, sf_dir):
    return table(spark, sf_dir, "part").selectExpr("p_partkey", "cast(p_size * 37 + 20 as int) as width", "cast(p_size * 29 + p_partkey % 50 as int) as height", "cast(0.02 + (p_partkey % 10) / 100 as double) as gsd")


def tile_grid(spark, sf_dir):
    r = _rasters(spark, sf_dir)
    w, h = F.explode(geometry.offsets("width", F.lit(512), F.lit(200))), F.explode(geometry.offsets("height", F.lit(512), F.lit(200)))
    g = r.withColumn("col_off", w).withColumn("row_off", h)
    return g.select("p_partkey", "row_off", "col_off", F.least(F.lit(512), F.col("width") - F.col("col_off")).alias("w"), F.least(F.lit(512), F.col("height") - F.col("row_off")).alias("h"))


def tile_grid_inset(spark, sf_dir):
    r = _rasters(spark, sf_dir)
    return r.select("p_partkey", F.explode(geometry.inset_offsets("width", F.lit(256), 0.05, F.lit(256))).alias("x")).select("p_partkey", F.col("x").cast("int").alias("x"))


def tile_grid_clamped(spark, sf_dir):
    return _rasters(spark, sf_dir).select("p_partkey", F.explode(geometry.clamped_offsets("width", F.lit(300), F.lit(150))).alias("x"))


def ground_tiles(spark, sf_dir):
    r = _rasters(spark, sf_dir).withColumn("tile", geometry.ground_tile(F.lit(56.0), "gsd"))
    return r.select("p_partkey", "tile", geometry.ground_stride("tile", 0.5).alias("stride"))


def plausible_rasters(spark, sf_dir):
    return _rasters(spark, sf_dir).where("gsd between 0.05 and 0.1 and width >= 100").select("p_partkey")


def crop_windows(spark, sf_dir):
    d = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "cast(o_orderkey % 900 as int) as x1", "cast(o_orderkey % 800 as int) as y1", "cast(o_orderkey % 900 + o_custkey % 120 as int) as x2", "cast(o_orderkey % 800 + o_orderkey % 130 as int) as y2")
    w = geometry.crop_window("x1", "y1", "x2", "y2", F.lit(950), F.lit(850))
    return d.select("o_orderkey", w["left"].alias("left"), w["top"].alias("top"), w["right"].alias("right"), w["bottom"].alias("bottom"))


def centred_tiles(spark, sf_dir):
    b = boxes(spark, sf_dir)
    x = geometry.centred_offset((F.col("minx") + F.col("maxx")) * 4, F.lit(101), F.lit(900)).alias("col_off")
    y = geometry.centred_offset((F.col("miny") + F.col("maxy")) * 4, F.lit(101), F.lit(900)).alias("row_off")
    return b.select("plot", x, y).dropDuplicates()


def affine_round_trip(spark, sf_dir):
    b = boxes(spark, sf_dir)
    t = F.array(*[F.lit(v) for v in (0.05, 0.01, 500000.0, 0.02, -0.06, 8000000.0)])
    w = geometry.to_world(t, "minx", "miny")
    back = geometry.to_pixel(t, w["x"], w["y"])
    return rounded(b.select("id", w["x"].alias("wx"), w["y"].alias("wy"), back["x"].alias("px"), back["y"].alias("py")), 4)


QUERIES = {
    f.__name__: f
    for f in (
        box_iou_join, nms_per_tile, match_iou, match_centroid, match_counts, match_totals, confident, inside_footprint, visible_fraction, tile_classify, dissolve, component_summary, centre_hit, crown_outcomes, crown_layer,
        polygon_measures, point_in_polygon, polygon_overlap, polygon_shapes, polygon_clip, yolo_lines, tile_grid, tile_grid_inset, tile_grid_clamped, ground_tiles, plausible_rasters, crop_windows, centred_tiles, affine_round_trip,
    )
}

B = f"b as materialized (select {SELECT} from orders)"
SHARED = "greatest(0, least(l.maxx, r.maxx) - greatest(l.minx, r.minx)) * greatest(0, least(l.maxy, r.maxy) - greatest(l.miny, r.miny))"
AREA = lambda t: f"(({t}.maxx - {t}.minx) * ({t}.maxy - {t}.miny))"
IOU = f"{SHARED} / ({AREA('l')} + {AREA('r')} - {SHARED})"
PAIRS = f"""{B},
pairs as materialized (select l.plot, l.id as p, r.id as c, l.confidence, {IOU} as score from b l join b r on l.plot = r.plot and l.id % 2 = 0 and r.id % 2 = 1 where {SHARED} > 0)"""
def _corners(corners) -> str:
    return "[" + ", ".join(f"{{{{'x': minx + (maxx - minx) * {u}::double, 'y': miny + (maxy - miny) * {v}::double}}}}".replace("{{", "{").replace("}}", "}") for u, v in corners) + "]"


RINGS = f"case when id % 3 = 0 then {_corners(QUAD)} else {_corners(OCTAGON)} end"
NEXT = lambda r, i: f"{r}[{i} % len({r}) + 1]"
CROSS = lambda r: f"list_transform(range(1, len({r}) + 1), lambda i: {r}[i].x * {NEXT(r, 'i')}.y - {NEXT(r, 'i')}.x * {r}[i].y)"
AREA_OF = lambda r: f"(list_sum({CROSS(r)}) / 2)"
MEAN_OF = lambda r, k: f"(list_sum(list_transform(range(1, len({r}) + 1), lambda i: ({r}[i].{k} + {NEXT(r, 'i')}.{k}) * ({r}[i].x * {NEXT(r, 'i')}.y - {NEXT(r, 'i')}.x * {r}[i].y))) / (6 * {AREA_OF(r)}))"
HOLDS = lambda r, x, y: f"(len(list_filter(range(1, len({r}) + 1), lambda i: ({r}[i].y > {y}) <> ({NEXT(r, 'i')}.y > {y}) and {x} < ({NEXT(r, 'i')}.x - {r}[i].x) * ({y} - {r}[i].y) / ({NEXT(r, 'i')}.y - {r}[i].y) + {r}[i].x)) % 2 = 1)"
FROM_EDGE = "sqrt(pow({x} - {r}[i].x - t * ({n}.x - {r}[i].x), 2) + pow({y} - {r}[i].y - t * ({n}.y - {r}[i].y), 2))"


def away(r: str, x: str, y: str) -> str:
    """Distance from a point to a ring, 0 inside."""
    n = NEXT(r, "i")
    t = f"least(1, greatest(0, (({x} - {r}[i].x) * ({n}.x - {r}[i].x) + ({y} - {r}[i].y) * ({n}.y - {r}[i].y)) / (pow({n}.x - {r}[i].x, 2) + pow({n}.y - {r}[i].y, 2))))"
    edge = f"sqrt(pow({x} - {r}[i].x - {t} * ({n}.x - {r}[i].x), 2) + pow({y} - {r}[i].y - {t} * ({n}.y - {r}[i].y), 2))"
    return f"(case when {HOLDS(r, x, y)} then 0.0 else list_min(list_transform(range(1, len({r}) + 1), lambda i: {edge})) end)"


def halved(source: str, steps: list[tuple[str, str, str, str]], slack: str = "0") -> str:
    """A query over source (with a ring r) that cuts r by half-planes a * x + b * y <= c, one after the other, each only
    where its condition holds."""
    out = source
    for when, a, b, c in steps:
        side = lambda p: f"({a} * {p}.x + {b} * {p}.y - ({c}))"
        p, q = "r[i]", NEXT("r", "i")
        cut = f"{{'x': {p}.x + {side(p)} / ({side(p)} - {side(q)}) * ({q}.x - {p}.x), 'y': {p}.y + {side(p)} / ({side(p)} - {side(q)}) * ({q}.y - {p}.y)}}"
        one = f"(case when {side(p)} <= {slack} then [{p}] else [] end) || (case when ({side(p)} <= {slack}) <> ({side(q)} <= {slack}) then [{cut}] else [] end)"
        out = f"(select * replace (case when {when} then flatten(list_transform(range(1, len(r) + 1), lambda i: {one})) else r end as r) from {out})"
    return out


CENTRES = f"""{B},
held as materialized (select *, {MEAN_OF('r', 'x')} as cx, {MEAN_OF('r', 'y')} as cy from (select *, {RINGS} as r from b)),
pairs as materialized (
  select l.plot, l.id as p, r.id as c, l.confidence, 1.0 as score from held l join held r on l.plot = r.plot and l.id % 2 = 0 and r.id % 2 = 1
    and l.minx <= r.maxx and r.minx <= l.maxx and l.miny <= r.maxy and r.miny <= l.maxy
  where {HOLDS('r.r', 'l.cx', 'l.cy')} or {HOLDS('l.r', 'r.cx', 'r.cy')})"""


def matched(threshold: float, where: str = "true") -> str:
    return f"""
asked as materialized (
  select plot, p, list({{'c': c, 's': score}} order by score desc, c) as cands, row_number() over (partition by plot order by any_value(confidence) desc, p) as k
  from pairs where {where} group by plot, p),
walk as (
  select plot, cast(0 as bigint) as k, cast([] as bigint[]) as taken, cast(null as bigint) as p, cast(null as bigint) as c, cast(null as double) as s from (select distinct plot from asked)
  union all
  select w.plot, a.k, case when f.s >= {threshold} then list_append(w.taken, f.c) else w.taken end, a.p, case when f.s >= {threshold} then f.c end, f.s
  from walk w join (select * from asked) a on a.plot = w.plot and a.k = w.k + 1, lateral (select list_filter(a.cands, lambda x: not list_contains(w.taken, x.c))[1] as f) as t),
m as (select plot, p as prediction, c as crown, s as score from walk where c is not null)"""


WINDOW = [("true", "-1", "0", "-tx"), ("true", "1", "0", "tx + 30"), ("true", "0", "-1", "-ty"), ("true", "0", "1", "ty + 30")]
TILES = f"""{B},
t as materialized (select plot, x || '_' || y as tile, cast(x as double) as tx, cast(y as double) as ty from (select distinct plot from b), range(0, 91, 15) as gx(x), range(0, 91, 15) as gy(y)),
met as materialized (select *, {AREA_OF('r')} as whole from (select t.*, id, {RINGS} as r from t join b on t.plot = b.plot and minx <= tx + 30 and tx <= maxx and miny <= ty + 30 and ty <= maxy)),
cover as materialized (select *, {AREA_OF('r')} / whole as share from {halved('met', WINDOW, '1e-9')} where len(r) > 0),
seen as materialized (select t.plot, t.tile, coalesce(max(share), 0.0) as visible, count(id) as crowns from t left join cover using (plot, tile) group by t.plot, t.tile)"""

EXTENT = "list_max(list_transform(r, lambda p: p.{0})) - list_min(list_transform(r, lambda p: p.{0}))"
#: The part of one crown inside another, by the other's edges.
BY_EDGES = [(f"len(q) >= {k}", f"({NEXT('q', k)}.y - q[{k}].y)", f"(q[{k}].x - {NEXT('q', k)}.x)", f"({NEXT('q', k)}.y - q[{k}].y) * q[{k}].x + (q[{k}].x - {NEXT('q', k)}.x) * q[{k}].y") for k in range(1, 9)]
PARTS = f"""{B},
f as materialized (
  select *, {RINGS} as r from (select id, confidence, minx + id % 97 * 40 as minx, miny + id % 89 * 40 as miny, maxx + id % 97 * 40 as maxx, maxy + id % 89 * 40 as maxy from b)),
met as materialized (
  select l.id as a, r.id as b, l.r as r, r.r as q from f l join f r on l.id < r.id and l.minx <= r.maxx and r.minx <= l.maxx and l.miny <= r.maxy and r.miny <= l.maxy),
meets as materialized (
  select a, b, {AREA_OF('r')} > 1e-9 or greatest({EXTENT.format('x')}, {EXTENT.format('y')}) > 1e-6 as joined from {halved('met', BY_EDGES, '1e-9')} where len(r) > 0),
links as materialized (select a, b, joined from meets union all select b, a, joined from meets),
reach as (select id, id as other from f union select reach.id, links.b from reach join links on reach.other = links.a where joined),
comp as materialized (select id, min(other) as component from reach group by id),
guests as (
  select x.component, count(distinct y.id) as n, max(f.confidence) as confidence
  from links join comp x on x.id = links.a join comp y on y.id = links.b join f on f.id = links.b where not joined and x.component <> y.component group by x.component),
parts as materialized (
  select component, minx, miny, maxx, maxy, p.n + coalesce(g.n, 0) as n_frag, greatest(p.confidence, coalesce(g.confidence, 0)) as confidence, lone
  from (select component, min(minx) as minx, min(miny) as miny, max(maxx) as maxx, max(maxy) as maxy, count(*) as n, max(confidence) as confidence, any_value(r) as lone from f join comp using (id) group by component) p
  left join guests g using (component))"""

#: Area of least turned boxes and what is tested of a ring r.
TURNED = "list_transform(range(1, len(r) + 1), lambda i: list_transform(r, lambda p: (p.x * ({n}.{a} - r[i].{a}) {s} p.y * ({n}.{b} - r[i].{b})) / sqrt(pow({n}.x - r[i].x, 2) + pow({n}.y - r[i].y, 2))))"
ALONG, ACROSS = (TURNED.format(n=NEXT("r", "i"), a=a, b=b, s=s) for a, b, s in (("x", "y", "+"), ("y", "x", "-")))
SIDES = f"list_transform(range(1, len(r) + 1), lambda i: sqrt(pow({NEXT('r', 'i')}.x - r[i].x, 2) + pow({NEXT('r', 'i')}.y - r[i].y, 2)))"


def shaped(source: str) -> str:
    """source with cut, area and least_box of its ring r, all of whose corners turn by more than a run allows."""
    spread = "list_transform({0}, lambda x: list_max(x) - list_min(x))"
    return f"""(
  select *, list_sum(list_filter(sides, lambda s: s >= 0.2::double * list_sum(sides))) >= 0.4::double * list_sum(sides) as cut,
    list_min(list_transform(list_zip(u, v), lambda p: {{'a': p[1] * p[2], 'w': p[1], 'h': p[2]}})) as least_box
  from (select *, {spread.format(ALONG)} as u, {spread.format(ACROSS)} as v, {SIDES} as sides, abs({AREA_OF('r')}) as area from {source}))"""


HITS = f"""{PARTS},
again as materialized (
  select *, {RINGS} as r from (select id, confidence, minx + id % 7 - 3 as minx, miny + id % 7 - 3 as miny, maxx + id % 7 - 3 as maxx, maxy + id % 7 - 3 as maxy from f where id % 4 <> 0)),
near as (
  select component, a.id, a.confidence, a.r, {away('a.r', '((p.minx + p.maxx) / 2)', '((p.miny + p.maxy) / 2)')} as d
  from parts p join again a on a.minx <= (p.minx + p.maxx) / 2 + 2 and a.maxx >= (p.minx + p.maxx) / 2 - 2 and a.miny <= (p.miny + p.maxy) / 2 + 2 and a.maxy >= (p.miny + p.maxy) / 2 - 2),
hits as materialized (select component, id as hit, d as distance, confidence as redet_conf, r from near where d <= 2 qualify row_number() over (partition by component order by d, id) = 1),
told as (
  select p.* exclude (lone), hit, redet_conf, case when n_frag < 2 then 'single' when hit is null then 'rejected' else 'verified' end as judged, case when n_frag < 2 or hit is null then lone else h.r end as r
  from parts p left join hits h using (component)),
judged as materialized (
  select *, case when judged = 'rejected' then 'rejected' when judged = 'single' and cut then 'tile_cut' when confidence < 0.5 then 'low_conf' when area < 30 then 'small'
      when greatest(least_box.w, least_box.h) / least(least_box.w, least_box.h) > 4 then 'sliver' else 'kept' end as outcome
  from {shaped('told')})"""

STRIPS = """strips as materialized (
  select p_partkey, list_transform([{'x': 0.0::double, 'y': 0.0::double}, {'x': w, 'y': 0.0::double}, {'x': w, 'y': h}, {'x': w / 2, 'y': h / 2 + (p_partkey % 13) / 8}, {'x': 0.0::double, 'y': h}], lambda p: {'x': p.x + p_partkey % 5, 'y': p.y + p_partkey % 3}) as r
  from (select p_partkey, cast(p_partkey % 11 + 2 as double) as w, cast(p_partkey % 7 + 1 as double) as h from part))"""

HEXES = """
h as materialized (select p_partkey, cast(p_partkey * 13 % 200 as double) as cx, cast(p_partkey * 29 % 190 as double) as cy, p_size / 5 + 1 as r from part),
c as materialized (select h.*, k, cx + r * cos(radians(60.0 * k)) as x, cy + r * sin(radians(60.0 * k)) as y, cx + r * cos(radians(60.0 * (k + 1))) as x2, cy + r * sin(radians(60.0 * (k + 1))) as y2 from h, range(6) as g(k))"""

RASTERS = "r as (select p_partkey, cast(p_size * 37 + 20 as int) as width, cast(p_size * 29 + p_partkey % 50 as int) as height, cast(cast(0.02 as double) + cast(p_partkey % 10 as double) / 100 as double) as gsd from part)"
STARTS = lambda n, tile, stride: f"(case when {n} <= {tile} then [0] else list_distinct(list_append(range(0, {n} - {tile} + 1, {stride}), {n} - {tile})) end)"

ORACLE_SQL = {
    "box_iou_join": f"with {PAIRS} select p as left_id, c as right_id, round(score, 6) + 0.0 as iou from pairs",
    "nms_per_tile": f"""
with recursive {B},
s as materialized (select *, row_number() over (partition by tile order by confidence desc, id) as k from b),
walk as (
  select tile, cast(0 as bigint) as k, cast([] as struct(id bigint, minx double, miny double, maxx double, maxy double)[]) as kept from (select distinct tile from b)
  union all
  select w.tile, r.k, case when len(list_filter(w.kept, lambda l: {SHARED} / ((l.maxx - l.minx) * (l.maxy - l.miny) + (r.maxx - r.minx) * (r.maxy - r.miny) - {SHARED} + 1e-9) > 0.3)) = 0
    then list_append(w.kept, {{'id': r.id, 'minx': r.minx, 'miny': r.miny, 'maxx': r.maxx, 'maxy': r.maxy}}) else w.kept end
  from walk w join s r on r.tile = w.tile and r.k = w.k + 1)
select unnest(list_transform(kept, lambda l: l.id)) as id, tile from (select *, row_number() over (partition by tile order by k desc) as n from walk) where n = 1""",
    "match_iou": f"with recursive {PAIRS}, {matched(0.3)} select plot, prediction, crown, round(score, 6) + 0.0 as score from m",
    "match_centroid": f"with recursive {CENTRES}, {matched(1.0)} select * from m",
    "match_counts": f"""
with recursive {PAIRS}, {matched(0.3, 'plot not in (7, 9)')},
p as (select plot, count(*) as n from b where id % 2 = 0 and plot <> 7 group by plot), c as (select plot, count(*) as n from b where id % 2 = 1 and plot <> 9 group by plot),
k as (select plot, count(*) as n from m group by plot)
select plot, coalesce(k.n, 0) as true_positive, coalesce(p.n, 0) - coalesce(k.n, 0) as false_positive, coalesce(c.n, 0) - coalesce(k.n, 0) as false_negative
from p full join c using (plot) left join k using (plot)""",
    "match_totals": f"""
with recursive {PAIRS}, {matched(0.3, 'plot not in (7, 9)')},
n as (select (select count(*) from m) as tp, (select count(*) from b where id % 2 = 0 and plot <> 7) as p, (select count(*) from b where id % 2 = 1 and plot <> 9) as c)
select tp as true_positive, p - tp as false_positive, c - tp as false_negative, round_even(tp / p, 4) as precision, round_even(tp / c, 4) as recall, round_even(2 * (tp / p) * (tp / c) / (tp / p + tp / c), 4) as f1 from n""",
    "confident": f"with {B} select id from b where id % 11 <> 0 and id % 13 <> 0 and confidence >= 0.4",
    "inside_footprint": f"""
with {B} select id, plot from b where (minx + maxx) / 2 > 10 and (minx + maxx) / 2 < 70 and (miny + maxy) / 2 > plot / 2 and (miny + maxy) / 2 < plot / 2 + 50""",
    "visible_fraction": f"with {TILES} select plot, tile, round(visible, 6) + 0.0 as visible, crowns from seen",
    "tile_classify": f"with {TILES} select plot, tile, case when visible >= 0.5 then 'positive' when visible <= 0.05 then 'negative' else 'discarded' end as kind from seen",
    "dissolve": f"with recursive {PARTS} select id, component from comp",
    "component_summary": f"with recursive {PARTS} select * exclude (lone) from parts",
    "centre_hit": f"with recursive {HITS} select component, hit, round(distance, 6) + 0.0 as distance, redet_conf from hits",
    "crown_outcomes": f"with recursive {HITS} select judged, outcome, count(*) as n from judged group by all",
    "crown_layer": f"""
with recursive {HITS}
select row_number() over (order by component) as id, round(confidence, 4) + 0.0 as confidence, round(round_even(area, 1), 4) + 0.0 as area_m2,
  round(case when judged = 'verified' or n_frag < 2 then redet_conf end, 4) + 0.0 as redet_conf, cast(len(r) as int) as corners from judged where outcome = 'kept'""",
    "polygon_measures": f"""
with {HEXES}
select p_partkey, round(sum(x * y2 - x2 * y) / 2, 6) + 0.0 as area, round(any_value(cx), 6) + 0.0 as x, round(any_value(cy), 6) + 0.0 as y, round(min(x), 6) + 0.0 as minx, round(max(y), 6) + 0.0 as maxy from c group by p_partkey""",
    "point_in_polygon": f"""
with {HEXES},
q as (select *, cx + p_partkey % 7 - 3 + 0.01 as px, cy + p_partkey % 5 - 2 + 0.013 as py from c),
e as (
  select *, (y > py) <> (y2 > py) and px < (x2 - x) * (py - y) / nullif(y2 - y, 0) + x as crosses,
    least(1, greatest(0, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) * (x2 - x) + (y2 - y) * (y2 - y)))) as t from q)
select p_partkey, count(*) filter (crosses) % 2 = 1 as inside,
  round(case when count(*) filter (crosses) % 2 = 1 then 0.0 else min(sqrt(pow(px - x - t * (x2 - x), 2) + pow(py - y - t * (y2 - y), 2))) end, 4) + 0.0 as distance
from e group by p_partkey""",
    "polygon_overlap": f"""
with {HEXES},
held as materialized (select p_partkey, list({{'x': x, 'y': y}} order by k) as r, min(x) as minx, min(y) as miny, max(x) as maxx, max(y) as maxy from c group by p_partkey),
met as materialized (
  select l.p_partkey as a, o.p_partkey as b, l.r as r, o.r as q, {AREA_OF('l.r')} + {AREA_OF('o.r')} as both_areas
  from held l join held o on l.p_partkey < o.p_partkey and l.p_partkey % 20 = o.p_partkey % 20 and l.minx <= o.maxx and o.minx <= l.maxx and l.miny <= o.maxy and o.miny <= l.maxy),
shared as (select a, b, {AREA_OF('r')} as s, both_areas from {halved('met', BY_EDGES[:6])} where len(r) > 2)
select a, b, round(s / (both_areas - s), 6) + 0.0 as iou from shared where s / (both_areas - s) > 1e-9""",
    "polygon_shapes": f"""
with {STRIPS},
pairs as (select p_partkey, r, r[i] as a, r[j].x - r[i].x as dx, r[j].y - r[i].y as dy from strips, range(1, 6) as gi(i), range(1, 6) as gj(j) where i <> j),
hull as (
  select p_partkey, list_transform(r, lambda p: (p.x * dx + p.y * dy) / sqrt(dx * dx + dy * dy)) as u, list_transform(r, lambda p: (p.y * dx - p.x * dy) / sqrt(dx * dx + dy * dy)) as v
  from pairs where list_min(list_transform(r, lambda p: dx * (p.y - a.y) - dy * (p.x - a.x))) >= -1e-9),
boxed as (select p_partkey, list_max(u) - list_min(u) as w, list_max(v) - list_min(v) as h from hull),
least_box as (select p_partkey, min({'{'}'a': round(w * h, 9), 'k': greatest(w, h) / least(w, h){'}'}).k as aspect from boxed group by p_partkey),
edges as (select p_partkey, i, {NEXT('r', 'i')}.x - r[i].x as dx, {NEXT('r', 'i')}.y - r[i].y as dy from strips, range(1, 6) as g(i)),
turns as (select *, abs(atan2(lag(dx) over w * dy - lag(dy) over w * dx, lag(dx) over w * dx + lag(dy) over w * dy)) as turn from edges window w as (partition by p_partkey order by i)),
runs as (select p_partkey, k, sum(sqrt(dx * dx + dy * dy)) as n from (select *, sum(cast(coalesce(turn, 9) >= radians(12) as int)) over (partition by p_partkey order by i) as k from turns) group by all),
cut as (select p_partkey, coalesce(sum(n) filter (n >= 0.2::double * total), 0) >= 0.4::double * any_value(total) as tile_cut from (select *, sum(n) over (partition by p_partkey) as total from runs) group by p_partkey)
select p_partkey, round(aspect, 6) + 0.0 as aspect, tile_cut, round(abs({AREA_OF('r')}), 6) + 0.0 as area from strips join least_box using (p_partkey) join cut using (p_partkey)""",
    "polygon_clip": f"""
with {STRIPS},
cut as (select *, abs({AREA_OF('r')}) as whole from strips)
select p_partkey, round(abs({AREA_OF('r')}) / whole, 6) + 0.0 as share
from {halved('cut', [('true', '-1', '0', '-(p_partkey % 5 + 1)'), ('true', '0', '1', 'p_partkey % 3 + p_partkey % 7 * 0.5::double + 0.25::double')])}""",
    "yolo_lines": f"""
with {TILES},
share as (select plot, tile, id, list_transform(r, lambda p: {{'x': round(least(greatest((p.x - tx) / 30, 0), 1), 6), 'y': round(least(greatest((p.y - ty) / 30, 0), 1), 6)}}) as p from cover where share >= 0.5),
apart as (select *, list_filter(p, lambda v, i: i = 1 or v <> p[i - 1]) as d from share),
ring as (select *, case when len(d) > 1 and d[1] = d[-1] then d[:-2] else d end as e from apart),
turned as (select *, list_position(e, list_min(e)) as k from ring)
select plot, tile, id, '0 ' || array_to_string(list_transform(e[k:] || e[:k - 1], lambda v: printf('%.6f %.6f', v.x, v.y)), ' ') as line from turned""",
    "tile_grid": f"""
with {RASTERS}, g as (select *, unnest({STARTS('width', 512, 200)}) as col_off from r), k as (select *, unnest({STARTS('height', 512, 200)}) as row_off from g)
select p_partkey, cast(row_off as int) as row_off, cast(col_off as int) as col_off, cast(least(512, width - col_off) as int) as w, cast(least(512, height - row_off) as int) as h from k""",
    "tile_grid_inset": f"""
with {RASTERS}, m as (select *, cast(floor(width * cast(0.05 as double)) as int) as margin from r)
select p_partkey, cast(unnest(case when width - margin - 256 < margin then [] else list_distinct(list_append(range(margin, width - margin - 256 + 1, 256), width - margin - 256)) end) as int) as x from m""",
    "tile_grid_clamped": f"with {RASTERS} select p_partkey, cast(unnest(list_distinct(list_append(range(0, greatest(width - 300, 0) + 1, 150), greatest(width - 300, 0)))) as int) as x from r",
    "ground_tiles": f"""
with {RASTERS}, t as (select p_partkey, greatest(1, cast(round_even(cast(56 as double) / gsd, 0) as int)) as tile from r)
select p_partkey, tile, greatest(1, cast(round_even(tile * cast(0.5 as double), 0) as int)) as stride from t""",
    "plausible_rasters": f"with {RASTERS} select p_partkey from r where gsd between 0.05 and 0.1 and width >= 100",
    "crop_windows": """
with d as (select o_orderkey, o_orderkey % 900 as x1, o_orderkey % 800 as y1, o_orderkey % 900 + o_custkey % 120 as x2, o_orderkey % 800 + o_orderkey % 130 as y2 from orders),
s as (select *, cast(floor(greatest(x2 - x1, y2 - y1) * cast(1.2 as double)) as bigint) // 2 as half, (x1 + x2) // 2 as cx, (y1 + y2) // 2 as cy from d),
w as (select *, greatest(0, cx - half) as l, greatest(0, cy - half) as t, least(950, cx + half) as r, least(850, cy + half) as b from s),
k as (select *, x2 - x1 >= 16 and y2 - y1 >= 16 and r - l >= 8 and b - t >= 8 as ok from w)
select o_orderkey, cast(case when ok then l end as int) as "left", cast(case when ok then t end as int) as top, cast(case when ok then r end as int) as "right", cast(case when ok then b end as int) as bottom from k""",
    "centred_tiles": f"""
with {B} select distinct plot, cast(least(greatest(round_even((minx + maxx) * 4 - 101 / 2, 0), 0), 799) as int) as col_off, cast(least(greatest(round_even((miny + maxy) * 4 - 101 / 2, 0), 0), 799) as int) as row_off from b""",
    "affine_round_trip": f"""
with {B} select id, round(0.05::double * minx + 0.01::double * miny + 500000.0::double, 4) + 0.0 as wx, round(0.02::double * minx - 0.06::double * miny + 8000000.0::double, 4) + 0.0 as wy, round(minx, 4) + 0.0 as px, round(miny, 4) + 0.0 as py from b""",
}
