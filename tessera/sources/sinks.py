"""Sinks: reports, layers, label files, split lists and images."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> None:
    df.select(*(columns or df.columns)).write.mode("overwrite").option("header", True).csv(path)


def write_report(df: DataFrame, path: str) -> None:
    """Rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_index(index: DataFrame, path: str, overwrite: bool = False) -> None:
    """An index as Parquet; an existing one is kept unless overwrite is asked for."""
    index.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def geojson_lines(df: DataFrame, ring: str = "ring") -> DataFrame:
    """A GeoJSON feature per row, as text: the ring closed, the other columns as properties."""
    pair = lambda p: F.array(p["x"], p["y"])
    closed = F.concat(F.transform(ring, pair), F.array(pair(F.col(ring)[0])))
    rest = [c for c in df.columns if c != ring]
    geometry = F.struct(F.lit("Polygon").alias("type"), F.array(closed).alias("coordinates"))
    properties = F.struct(*rest) if rest else F.create_map().cast("map<string,string>")
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), properties.alias("properties"), geometry.alias("geometry"))).alias("value"))


def write_geojson(df: DataFrame, path: str, ring: str = "ring") -> None:
    """Newline-delimited GeoJSON."""
    geojson_lines(df, ring).write.mode("overwrite").text(path)


def label_files(lines: DataFrame, tiles: DataFrame, key: str = "key") -> DataFrame:
    """(key, value): the label file of every tile, a line per polygon; empty for tiles without any."""
    joined = lines.groupBy(key).agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("value"))  # of one tile
    return tiles.select(key).distinct().join(joined, key, "left").select(key, F.coalesce("value", F.lit("")).alias("value"))


def split_lists(roles: DataFrame, name: str, root: str, key: str = "key") -> DataFrame:
    """(file, value): the image paths of each role of a split."""
    return roles.select(F.concat(F.lit(f"splits/{name}_"), "role", F.lit(".txt")).alias("file"), F.concat(F.lit(f"{root}/images/"), F.col(key), F.lit(".jpg")).alias("value"))


def split_yaml(name: str, root: str, classes: list[str]) -> str:
    """The description of a split that a trainer reads."""
    return f"path: {root}\ntrain: splits/{name}_train.txt\nval: splits/{name}_val.txt\nnc: {len(classes)}\nnames: {classes}\n"


def write_partitioned_text(df: DataFrame, path: str, by: str, value: str = "value") -> None:
    """Text files in a folder for each value of by."""
    df.select(by, F.col(value).alias("value")).write.mode("overwrite").partitionBy(by).text(path)


def encode_tiles(tiles: DataFrame, pixels: int | None = None) -> DataFrame:
    """tiles with image: a PNG of the first three bands, stretched to bytes and resized to pixels square."""

    @F.pandas_udf("binary")
    def png(data, dtype, count, height, width):
        import numpy as np
        import pandas as pd

        from tessera.functions.polygons import resize_bilinear, stretch
        from tessera.sources.raster import to_png

        out = []
        for p, t, c, h, w in zip(data, dtype, count, height, width):
            rgb = stretch(np.frombuffer(p, t).reshape(c, h, w)[:3].transpose(1, 2, 0))
            out.append(to_png(np.clip(np.rint(resize_bilinear(rgb, pixels, pixels)), 0, 255) if pixels else rgb))
        return pd.Series(out)

    return tiles.withColumn("image", png("pixels", "dtype", "count", "height", "width"))


def write_files(df: DataFrame, folder: str, name: str = "name", data: str = "data") -> None:
    """A file of each row's bytes (or text) below a folder that all executors see. A file is written beside its place and
    moved there whole, so that a task that is lost or tried again leaves no torn file."""

    def run(rows):
        import os
        import uuid

        for r in rows:
            path = os.path.join(folder, r[0])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            part = f"{path}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r[1].encode() if isinstance(r[1], str) else bytes(r[1]))
            os.replace(part, path)

    df.select(name, data).foreachPartition(run)


def crop_paths(manifest: DataFrame) -> DataFrame:
    """manifest with relative_path: split, class and name of each crop."""
    from ..functions.text import crop_name

    return manifest.withColumn("relative_path", F.concat_ws("/", "split", "class", crop_name("class", "year", "source_path", "number")))


def state_files(records: DataFrame, path: str = "path") -> DataFrame:
    """(name, data): the state of each finished raster, records holding positives and negatives as arrays of structs."""
    from ..functions.text import state_name

    return records.select(state_name(path).alias("name"), F.to_json(F.struct("positives", "negatives")).alias("data"))


def write_gpkg(df: DataFrame, folder: str, epsg: int, ring: str = "ring", table: str = "layer") -> None:
    """A GeoPackage for each partition of df, whose rows are its polygons with their other columns as attributes."""
    rest = [c for c in df.columns if c != ring]
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "double": "REAL", "float": "REAL"}
    columns = [(c, kinds.get(t, "TEXT")) for c, t in df.dtypes if c != ring]

    def run(rows):
        import itertools
        import os
        import sqlite3
        import struct
        import uuid

        rows = iter(rows)
        first = next(rows, None)
        if first is None:
            return
        con = sqlite3.connect(":memory:")
        con.executescript(
            "pragma application_id = 1196444487; pragma user_version = 10300;"
            "create table gpkg_spatial_ref_sys (srs_name text, srs_id integer primary key, organization text, organization_coordsys_id integer, definition text, description text);"
            "create table gpkg_contents (table_name text primary key, data_type text, identifier text, description text, last_change text, min_x double, min_y double, max_x double, max_y double, srs_id integer);"
            "create table gpkg_geometry_columns (table_name text, column_name text, geometry_type_name text, srs_id integer, z tinyint, m tinyint);"
        )
        con.execute("insert into gpkg_spatial_ref_sys values (?, ?, 'EPSG', ?, 'undefined', null)", (f"EPSG:{epsg}", epsg, epsg))
        con.execute("insert into gpkg_contents values (?, 'features', ?, '', strftime('%Y-%m-%dT%H:%M:%fZ', 'now'), null, null, null, null, ?)", (table, table, epsg))
        con.execute("insert into gpkg_geometry_columns values (?, 'geom', 'POLYGON', ?, 0, 0)", (table, epsg))
        con.execute(f'create table "{table}" (fid integer primary key, geom blob' + "".join(f', "{c}" {k}' for c, k in columns) + ")")
        for r in itertools.chain([first], rows):
            points = [(p["x"], p["y"]) for p in r[ring]]
            points.append(points[0])
            wkb = struct.pack("<BIII", 1, 3, 1, len(points)) + struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
            con.execute(f'insert into "{table}" values (null, ?' + ", ?" * len(rest) + ")", (b"GP\0\1" + struct.pack("<i", epsg) + wkb, *(r[c] for c in rest)))
        con.commit()
        os.makedirs(folder, exist_ok=True)
        name = os.path.join(folder, f"part-{uuid.uuid4().hex}.gpkg")
        with open(name + ".part", "wb") as f:
            f.write(con.serialize())
        os.replace(name + ".part", name)

    df.foreachPartition(run)
