"""Vector layers: GeoJSON, GeoPackage and Shapefile, as rows of attributes with one ring per polygon part.

A file is read by one task, whole; layers of many files are read in parallel. Holes are left out: only outer rings count
in the engine's areas.
"""

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import RING, bounds

SCHEMA = f"file string, feature bigint, part int, attributes map<string, string>, crs string, ring {RING}"


def outer_rings(geometry: dict | None) -> list:
    """The outer rings of a GeoJSON geometry, whatever it is made of."""
    kind = (geometry or {}).get("type")
    if kind == "Polygon":
        return [geometry["coordinates"][0]] if geometry["coordinates"] else []
    if kind == "MultiPolygon":
        return [p[0] for p in geometry["coordinates"] if p]
    if kind == "GeometryCollection":
        return [r for g in geometry["geometries"] for r in outer_rings(g)]
    return []


def wkb_rings(data: bytes, at: int = 0) -> tuple[list, int]:
    """(outer rings, end) of a well-known binary polygon, multipolygon or collection; further dimensions are skipped."""
    order = "<" if data[at] else ">"
    kind, = struct.unpack_from(order + "I", data, at + 1)
    at += 5
    if kind & 0x20000000:
        at += 4
    extra = (2 if kind & 0xC0000000 == 0xC0000000 else 1 if kind & 0xC0000000 else 0) or {0: 0, 1: 1, 2: 1, 3: 2}[(kind & 0xFFFF) // 1000]
    base, width = (kind & 0xFFFF) % 1000, 2 + extra
    out: list = []
    count = lambda p: struct.unpack_from(order + "I", data, p)[0]
    if base == 1:
        return [], at + 8 * width
    if base == 2:
        return [], at + 4 + 8 * width * count(at)
    n = count(at)
    at += 4
    for i in range(n):
        if base == 3:
            points = count(at)
            values = struct.unpack_from(f"{order}{points * width}d", data, at + 4)
            at += 4 + 8 * width * points
            if i == 0:
                out.append([[values[k * width], values[k * width + 1]] for k in range(points)])
        else:
            rings, at = wkb_rings(data, at)
            out += rings
    return out, at


def _geojson(data: bytes):
    import json

    doc = json.loads(data)
    crs = ((doc.get("crs") or {}).get("properties") or {}).get("name", "OGC:CRS84")
    for i, f in enumerate(doc["features"] if doc.get("type") == "FeatureCollection" else [doc]):
        yield i, f.get("properties") or {}, crs, outer_rings(f.get("geometry"))


def _gpkg(data: bytes):
    import sqlite3

    con = sqlite3.connect(":memory:")
    con.deserialize(data)
    quote = lambda n: '"' + n.replace('"', '""') + '"'
    i = 0
    for table, column, srs in con.execute("select table_name, column_name, srs_id from gpkg_geometry_columns").fetchall():
        cursor = con.execute(f"select * from {quote(table)}")
        names = [d[0] for d in cursor.description]
        for row in cursor:
            values = dict(zip(names, row))
            blob = values.pop(column)
            rings: list = []
            if blob and not blob[3] & 0x10:  # not marked empty
                rings, _ = wkb_rings(blob, 8 + {0: 0, 1: 32, 2: 48, 3: 48, 4: 64}[(blob[3] >> 1) & 7])
            yield i, values, f"EPSG:{srs}", rings
            i += 1


def _shp(data: bytes, dbf: bytes | None = None):
    names, records = [], []
    if dbf:
        n, head, size = struct.unpack_from("<IHH", dbf, 4)
        at = 32
        while dbf[at] != 0x0D:
            names.append((dbf[at : at + 11].split(b"\0")[0].decode(), dbf[at + 16]))
            at += 32
        for i in range(n):
            p, values = head + i * size + 1, {}
            for name, width in names:
                text = dbf[p : p + width].decode("utf-8", "replace").strip()
                values[name], p = text or None, p + width
            records.append(values)
    at, i = 100, 0
    while at + 8 <= len(data):
        words, = struct.unpack_from(">I", data, at + 4)
        kind, = struct.unpack_from("<I", data, at + 8)
        rings = []
        if kind in (5, 15, 25):
            parts, points = struct.unpack_from("<II", data, at + 44)
            starts = [*struct.unpack_from(f"<{parts}I", data, at + 52), points]
            xy = struct.unpack_from(f"<{2 * points}d", data, at + 52 + 4 * parts)
            for a, b in zip(starts, starts[1:]):
                ring = [[xy[2 * k], xy[2 * k + 1]] for k in range(a, b)]
                if sum((q[0] - p[0]) * (q[1] + p[1]) for p, q in zip(ring, ring[1:])) > 0:  # outer rings run clockwise
                    rings.append(ring)
        yield i, records[i] if i < len(records) else {}, None, rings
        at += 8 + 2 * words
        i += 1


def read_layer(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """A row per polygon part: file, feature (its place in the layer), part, attributes as text, crs, ring and its bounds."""
    kind = kind or {"geojson": "geojson", "json": "geojson", "gpkg": "gpkg", "shp": "shp"}[path.rsplit(".", 1)[-1].lower()]
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    if kind == "shp":
        stem = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
        tables = spark.read.format("binaryFile").load(path.rsplit(".", 1)[0] + ".dbf").select(stem(F.col("path")).alias("s"), F.col("content").alias("dbf"))
        files = files.withColumn("s", stem(F.col("path"))).join(tables, "s", "left").select("path", "content", "dbf")

    def run(batches):
        import pyarrow as pa

        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for batch in batches:
            for row in batch.to_pylist():
                found = _shp(row["content"], row["dbf"]) if kind == "shp" else {"geojson": _geojson, "gpkg": _gpkg}[kind](row["content"])
                out = []
                for i, values, crs, rings in found:
                    attributes = [(k, None if v is None else str(v)) for k, v in values.items()]
                    for j, ring in enumerate(rings or [None]):
                        points = None if ring is None else [{"x": float(p[0]), "y": float(p[1])} for p in (ring[:-1] if len(ring) > 1 and ring[0] == ring[-1] else ring)]
                        out.append((row["path"], i, j, attributes, crs, points))
                columns = list(zip(*out)) if out else [()] * 6
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.list_(point)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "feature", "part", "attributes", "crs", "ring"])

    b = bounds("ring")
    return files.mapInArrow(run, SCHEMA).withColumns({c: b[c] for c in ("minx", "miny", "maxx", "maxy")})


def identifier(layer: DataFrame, requested: str | None = None):
    """The id of a feature: an attribute asked for, else one named fid in any case, else its place in the layer."""
    if requested:
        return F.col("attributes")[requested]
    fid = F.filter(F.map_keys("attributes"), lambda k: F.lower(k) == "fid")
    return F.coalesce(F.element_at("attributes", F.get(fid, F.lit(0))), F.col("feature").cast("string"))


def species(layer: DataFrame, field: str, pattern: str, target: bool = True) -> DataFrame:
    """Features whose field matches a pattern in any case (target), or the others; a missing value is no match."""
    hit = F.coalesce(F.col("attributes")[field].rlike(f"(?i){pattern}"), F.lit(False))
    return layer.where(hit if target else ~hit)


#: The WGS 84 ellipsoid and the scale on a UTM central meridian.
A, FLATTENING, SCALE = 6378137.0, 1 / 298.257223563, 0.9996


def reproject(points, source: str, target: str):
    """Points between equal systems, or between WGS 84 and its UTM zones (EPSG 326zz and 327zz), by series in the third
    flattening; any other pair is an error."""
    import math
    import re

    def zone(crs):
        m = re.fullmatch(r"(?:.*EPSG:+)?32([67])(\d\d)", crs)
        return (int(m[2]), m[1] == "7") if m else None

    geographic = lambda c: c in ("EPSG:4326", "OGC:CRS84", "urn:ogc:def:crs:OGC:1.3:CRS84", "4326")
    if source == target or geographic(source) and geographic(target):
        return [tuple(p) for p in points]
    n = FLATTENING / (2 - FLATTENING)
    r = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * SCALE
    e = 2 * math.sqrt(n) / (1 + n)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    out = []
    if geographic(source) and (z := zone(target)):
        for lon, lat in points:
            phi, lam = math.radians(lat), math.radians(lon - (6 * z[0] - 183))
            t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
            xi, eta = math.atan2(t, math.cos(lam)), math.atanh(math.sin(lam) / math.hypot(1, t))
            x = eta + sum(a * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, a in enumerate(alpha, 1))
            y = xi + sum(a * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, a in enumerate(alpha, 1))
            out.append((500000 + r * x, r * y + (10_000_000 if z[1] else 0)))
        return out
    if (z := zone(source)) and geographic(target):
        for x, y in points:
            eta, xi = (x - 500000) / r, (y - (10_000_000 if z[1] else 0)) / r
            u = xi - sum(b * math.sin(2 * j * xi) * math.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
            v = eta - sum(b * math.cos(2 * j * xi) * math.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
            chi = math.asin(math.sin(u) / math.cosh(v))
            phi = chi + sum(d * math.sin(2 * j * chi) for j, d in enumerate(delta, 1))
            out.append((6 * z[0] - 183 + math.degrees(math.atan2(math.sinh(v), math.cos(u))), math.degrees(phi)))
        return out
    raise ValueError(f"no way from {source} to {target}")


def to_crs(df: DataFrame, source: str, target: str, ring: str = "ring") -> DataFrame:
    @F.pandas_udf(RING)
    def move(rings):
        import pandas as pd

        from tessera.sources.vector import reproject

        return pd.Series([None if r is None else [{"x": x, "y": y} for x, y in reproject([(p["x"], p["y"]) for p in r], source, target)] for r in rings])

    return df if source == target else df.withColumn(ring, move(ring))
