"""Geometry expressions: boxes as four columns, polygons as one ring of points, array<struct<x: double, y: double>>."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vector import col

RING = "array<struct<x: double, y: double>>"


def overlap(a: tuple, b: tuple) -> Column:
    """The area that two boxes (x1, y1, x2, y2) share."""
    width = F.least(col(a[2]), col(b[2])) - F.greatest(col(a[0]), col(b[0]))
    height = F.least(col(a[3]), col(b[3])) - F.greatest(col(a[1]), col(b[1]))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def box_area(a: tuple) -> Column:
    return (col(a[2]) - col(a[0])) * (col(a[3]) - col(a[1]))


def box_iou(a: tuple, b: tuple, guard: float = 1e-9) -> Column:
    """Intersection over union; the guard goes into the denominator (0: none, and 0 where both are empty)."""
    shared = overlap(a, b)
    union = box_area(a) + box_area(b) - shared + guard
    return F.when((shared <= 0) | (union == 0), 0.0).otherwise(shared / union)


def box_ring(a: tuple) -> Column:
    x1, y1, x2, y2 = (col(c).cast("double") for c in a)
    return F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x1, y1), (x2, y1), (x2, y2), (x1, y2))])


def _edges(ring: Column) -> Column:
    """Per edge: its ends and cross product."""
    after = F.concat(F.slice(ring, F.lit(2), F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by"), (p["x"] * q["y"] - q["x"] * p["y"]).alias("c")))


def signed_area(ring) -> Column:
    return F.aggregate(_edges(col(ring)), F.lit(0.0), lambda s, e: s + e["c"]) / 2


def area(ring) -> Column:
    return F.abs(signed_area(ring))


def centroid(ring) -> Column:
    """struct(x, y), weighted by area; null for an empty area."""
    edges = _edges(col(ring))
    a = signed_area(ring)
    x = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ax"] + e["bx"]) * e["c"])
    y = F.aggregate(edges, F.lit(0.0), lambda s, e: s + (e["ay"] + e["by"]) * e["c"])
    return F.when(a != 0, F.struct((x / (6 * a)).alias("x"), (y / (6 * a)).alias("y")))


def bounds(ring) -> Column:
    r = col(ring)
    pick = lambda f, k: f(F.transform(r, lambda p: p[k]))
    return F.struct(pick(F.array_min, "x").alias("minx"), pick(F.array_min, "y").alias("miny"), pick(F.array_max, "x").alias("maxx"), pick(F.array_max, "y").alias("maxy"))


def contains(ring, x, y) -> Column:
    """Whether a point lies inside, by the parity of crossings to its right."""
    px, py = col(x), col(y)
    crosses = lambda e: ((e["ay"] > py) != (e["by"] > py)) & (px < (e["bx"] - e["ax"]) * (py - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(_edges(col(ring)), crosses)) % 2 == 1


def point_distance(ring, x, y) -> Column:
    """Distance from a point to the polygon, 0 inside."""
    px, py = col(x), col(y)

    def of_edge(e):
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        square = dx * dx + dy * dy
        t = F.when(square == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - e["ax"]) * dx + (py - e["ay"]) * dy) / square)))
        return F.hypot(px - e["ax"] - t * dx, py - e["ay"] - t * dy)

    return F.when(contains(ring, px, py), 0.0).otherwise(F.array_min(F.transform(_edges(col(ring)), of_edge)))


def to_world(transform, x, y) -> Column:
    """A raster's affine transform (a, b, c, d, e, f) of a pixel place: struct(x, y)."""
    t, px, py = col(transform), col(x), col(y)
    return F.struct((t[0] * px + t[1] * py + t[2]).alias("x"), (t[3] * px + t[4] * py + t[5]).alias("y"))


def to_pixel(transform, x, y) -> Column:
    """The inverse of to_world; null where the transform has none."""
    t, wx, wy = col(transform), col(x), col(y)
    det = t[0] * t[4] - t[1] * t[3]
    dx, dy = wx - t[2], wy - t[5]
    return F.when(det != 0, F.struct(((t[4] * dx - t[1] * dy) / det).alias("x"), ((t[0] * dy - t[3] * dx) / det).alias("y")))


def offsets(length, tile, stride) -> Column:
    """Starts of tiles over a length: every stride, and one that ends at the edge; [0] where a tile is as long."""
    n, t = col(length), col(tile)
    steps = F.sequence(F.lit(0), n - t, col(stride))
    return F.when(n <= t, F.array(F.lit(0))).otherwise(F.array_distinct(F.concat(steps, F.array((n - t).cast("int")))))


def inset_offsets(length, tile, margin_ratio, stride) -> Column:
    """The same within a margin of int(length * ratio) at both ends; [] where no tile fits."""
    n, t = col(length), col(tile)
    margin = F.floor(n * F.lit(float(margin_ratio))).cast("int")
    last = n - margin - t
    steps = F.sequence(margin, F.greatest(last, margin), col(stride))
    return F.when(last < margin, F.array().cast("array<int>")).otherwise(F.array_distinct(F.concat(steps, F.array(last))))


def clamped_offsets(length, tile, stride) -> Column:
    """Sorted distinct starts, the last clamped to the edge and to zero."""
    n, t = col(length), col(tile)
    steps = F.sequence(F.lit(0), F.greatest(n - t, F.lit(0)), col(stride))
    return F.array_sort(F.array_distinct(F.concat(steps, F.array(F.greatest(n - t, F.lit(0)).cast("int")))))


def ground_tile(metres, gsd, least: int = 1) -> Column:
    """Pixels of a ground length, rounded half to even."""
    return F.greatest(F.lit(least), F.bround(col(metres) / col(gsd)).cast("int"))


def ground_stride(tile, overlap_share: float) -> Column:
    return F.greatest(F.lit(1), F.bround(col(tile) * F.lit(1 - overlap_share)).cast("int"))


def centred_offset(centre, tile, length) -> Column:
    """Start of a tile about a place, rounded half to even and kept inside the raster."""
    return F.least(F.greatest(F.bround(col(centre) - col(tile) / 2), F.lit(0)), F.greatest(F.lit(0), col(length) - col(tile))).cast("int")


def crop_window(x1, y1, x2, y2, width, height, padding: float = 0.2, least_side: int = 16, least_crop: int = 8) -> Column:
    """struct(left, top, right, bottom) of a padded square about a box, cut at the raster; null if box or crop is too small."""
    w, h = col(x2) - col(x1), col(y2) - col(y1)
    half = F.floor(F.floor(F.greatest(w, h) * F.lit(1 + padding)) / 2).cast("int")
    cx, cy = F.floor((col(x1) + col(x2)) / 2).cast("int"), F.floor((col(y1) + col(y2)) / 2).cast("int")
    left, top = F.greatest(F.lit(0), cx - half), F.greatest(F.lit(0), cy - half)
    right, bottom = F.least(col(width), cx + half), F.least(col(height), cy + half)
    fits = (w >= least_side) & (h >= least_side) & (right - left >= least_crop) & (bottom - top >= least_crop)
    return F.when(fits, F.struct(left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom")))


def yolo_line(ring, col_off, row_off, width, height) -> Column:
    """"0 x y x y ..." of a ring in pixels, as shares of the window within [0, 1], six places; null under three points."""
    share = lambda v, off, n: F.least(F.greatest((v - col(off)) / col(n), F.lit(0.0)), F.lit(1.0))
    points = F.transform(col(ring), lambda p: F.format_string("%.6f %.6f", share(p["x"], col_off, width), share(p["y"], row_off, height)))
    return F.when(F.size(col(ring)) >= 3, F.concat(F.lit("0 "), F.array_join(points, " ")))
