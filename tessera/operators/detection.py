"""From tiles to crowns: a detector over tiles, outlines in world coordinates, dissolving, verification, layer.

Models are callables that executors can unpickle: a segmenter maps (1, 3, h, w) floats to (boxes, prototypes); a detector
maps an RGB tile to (class, score, x1, y1, x2, y2); an encoder maps RGB crops to vectors.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import RING


def segment_tiles(tiles: DataFrame, transforms: DataFrame, model, threshold: float = 0.25, size: int = 1024, iou: float = 0.7) -> DataFrame:
    """Outlines found on tiles: path, row_off, col_off, confidence, ring (world) and its bounds. Dark tiles are skipped and a
    tile's overlapping boxes suppressed before its masks are decoded. transforms holds path and transform."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tessera.functions.polygons import detection_rings, detector_boxes, resize_bilinear
        from tessera.operators.spatial import _Apart
        from tessera.sources.raster import as_array, is_dark

        point = pa.struct([("x", pa.float64()), ("y", pa.float64())])
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                rgb = as_array(row)[:3].transpose(1, 2, 0)
                if rgb.shape[2] < 3 or is_dark(rgb):
                    continue
                given = resize_bilinear(rgb, size, size).transpose(2, 0, 1)[None] / 255.0
                boxes, prototypes = model(given.astype(np.float32))
                if np.ndim(boxes) == 4:  # outputs may come the other way round
                    boxes, prototypes = prototypes, boxes
                boxes, conf, mixing = detector_boxes(boxes[0], threshold, size, size, np.shape(prototypes)[1])
                apart, t = _Apart(iou), row["transform"]
                scale, start = np.array([row["width"], row["height"]]) / size, np.array([row["col_off"], row["row_off"]])
                for k in np.argsort(-conf, kind="stable").tolist():
                    if apart.take(boxes[k].tolist()):
                        for ring in detection_rings(boxes[k], mixing[k], prototypes[0], size, size):
                            x, y = (start + np.asarray(ring) * scale).T
                            world = np.stack([t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5]], axis=1).tolist()
                            out.append((row["path"], row["row_off"], row["col_off"], float(conf[k]), [{"x": u, "y": v} for u, v in world]))
            columns = list(zip(*out)) if out else [()] * 5
            kinds = [pa.string(), pa.int32(), pa.int32(), pa.float64(), pa.list_(point)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "row_off", "col_off", "confidence", "ring"])

    from ..functions.geometry import bounds

    found = tiles.join(transforms.select("path", "transform"), "path").mapInArrow(run, f"path string, row_off int, col_off int, confidence double, ring {RING}")
    b = bounds("ring")
    return found.withColumns({c: b[c] for c in ("minx", "miny", "maxx", "maxy")})


def scan_tiles(tiles: DataFrame, transforms: DataFrame, detector, confidence: float = 0.45, iou: float = 0.45, year: int | None = None) -> DataFrame:
    """Detections of a box detector on tiles, in the columns of a detections table."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        from tessera.sources.raster import as_array

        kinds = {"source_path": pa.string(), "class": pa.string(), "confidence": pa.float64(), "center_x_geo": pa.float64(), "center_y_geo": pa.float64(), **{c: pa.int32() for c in ("tile_x", "tile_y", "x1", "y1", "x2", "y2")}}
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                t = row["transform"]
                for name, score, x1, y1, x2, y2 in detector(as_array(row)[:3].transpose(1, 2, 0).astype(np.uint8), confidence, iou):
                    x, y = row["col_off"] + (x1 + x2) / 2, row["row_off"] + (y1 + y2) / 2
                    out.append((row["path"], name.split("_")[0].upper(), round(float(score), 6), t[0] * x + t[1] * y + t[2], t[3] * x + t[4] * y + t[5], row["col_off"], row["row_off"], int(x1), int(y1), int(x2), int(y2)))
            columns = list(zip(*out)) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds.values())], names=list(kinds))

    from ..functions.text import file_name

    schema = "source_path string, class string, confidence double, center_x_geo double, center_y_geo double, tile_x int, tile_y int, x1 int, y1 int, x2 int, y2 int"
    found = tiles.join(transforms.select("path", "transform"), "path").mapInArrow(run, schema)
    return found.select(F.lit(year).cast("int").alias("year"), file_name("source_path").alias("tif"), *found.columns)


def tile_windows(rasters: DataFrame, metres: float, overlap: float, least: int = 1) -> DataFrame:
    """The windows of a ground size that cover each raster, the last of a row or column at its edge: the columns of rasters,
    row_off, col_off, tile_w and tile_h (the window's full size), width and height (cut at the raster), and its world box."""
    from ..functions.geometry import clamped_offsets, ground_stride, ground_tile
    from ..sources.raster import world_window

    t = rasters.withColumnsRenamed({"width": "raster_w", "height": "raster_h"}).withColumn("tile_w", ground_tile(F.lit(float(metres)), F.abs(F.col("transform")[0]), least)).withColumn("tile_h", ground_tile(F.lit(float(metres)), F.abs(F.col("transform")[4]), least))
    t = t.withColumn("row_off", F.explode(clamped_offsets("raster_h", "tile_h", ground_stride("tile_h", overlap)))).withColumn("col_off", F.explode(clamped_offsets("raster_w", "tile_w", ground_stride("tile_w", overlap))))
    return _boxed(t, world_window)


def centred_windows(rasters: DataFrame, centres: DataFrame, metres: float, least: int = 1) -> DataFrame:
    """As tile_windows, one window about each centre (path, x, y in the raster's coordinates), kept inside the raster; the
    other columns of centres stay."""
    from ..functions.geometry import centred_offset, ground_tile, to_pixel
    from ..sources.raster import world_window

    t = rasters.withColumnsRenamed({"width": "raster_w", "height": "raster_h"}).join(centres, "path")
    t = t.withColumn("tile_w", ground_tile(F.lit(float(metres)), F.abs(F.col("transform")[0]), least)).withColumn("tile_h", ground_tile(F.lit(float(metres)), F.abs(F.col("transform")[4]), least))
    at = to_pixel("transform", "x", "y")
    return _boxed(t.withColumn("col_off", centred_offset(at["x"], "tile_w", "raster_w")).withColumn("row_off", centred_offset(at["y"], "tile_h", "raster_h")).drop("x", "y"), world_window)


def _boxed(windows: DataFrame, world_window) -> DataFrame:
    cut = windows.withColumns({"width": F.least(F.col("tile_w"), F.col("raster_w") - F.col("col_off")).cast("int"), "height": F.least(F.col("tile_h"), F.col("raster_h") - F.col("row_off")).cast("int")}).where("width > 0 and height > 0")
    box = world_window()
    return cut.withColumns({c: box[c] for c in ("minx", "miny", "maxx", "maxy")})


def _embedded(t, rows, encoder, image_size: int, background: int):
    """A batch (source_id, embedding, reason) of the rows (id, ring) on one raster."""
    import numpy as np
    import pyarrow as pa

    from tessera.functions.polygons import resize_bilinear
    from tessera.sources.raster import read_masked

    ids, vectors, reasons = [], [], []
    for name, ring in rows:
        crop = None if t is None else read_masked(t, [(p["x"], p["y"]) for p in ring], background)
        v = None if crop is None else np.asarray(encoder(resize_bilinear(crop, image_size, image_size)[None] / 255.0)[0], float)
        ids.append(name)
        vectors.append(None if v is None else (v / max(float(np.linalg.norm(v)), 1e-12)).tolist())
        reasons.append("no crop" if v is None else None)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(vectors, pa.list_(pa.float64())), pa.array(reasons, pa.string())], names=["source_id", "embedding", "reason"])


EMBEDDED = "source_id string, embedding array<double>, reason string"


def embed_polygons(polygons: DataFrame, files: DataFrame, encoder, image_size: int = 224, background: int = 124, id_col: str = "source_id") -> DataFrame:
    """(source_id, embedding, reason): unit vectors of masked crops; a crop that cannot be made has a reason instead.

    polygons holds path, the id and a ring in pixels; files the contents of the rasters, for storage that only Spark
    reads. Of a raster only the boxes of its polygons are decoded."""
    listed = polygons.groupBy("path").agg(F.collect_list(F.struct(F.col(id_col).cast("string").alias("id"), "ring")).alias("p"))  # of one raster

    def run(batches):
        from tessera.sources.raster import Tiff

        for batch in batches:
            for content, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                yield _embedded(Tiff(content), [(r["id"], r["ring"]) for r in rows], encoder, image_size, background)

    return files.join(listed, "path").select("content", "p").mapInArrow(run, EMBEDDED)


def embed_windows(polygons: DataFrame, encoder, image_size: int = 224, background: int = 124, id_col: str = "source_id", opener=None) -> DataFrame:
    """As embed_polygons, for rasters in a folder that all executors see: each task maps the files of its polygons, and reads
    their boxes. Polygons of one raster may go to many tasks."""
    rows = polygons.select("path", F.col(id_col).cast("string").alias("id"), "ring")

    def run(batches):
        import struct

        from tessera.sources.raster import Tiff, open_mapped

        path, t = None, None
        for batch in batches:
            for p, name, ring in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if p != path:
                    path, t = p, None
                    try:
                        t = Tiff((opener or open_mapped)(p))
                    except (OSError, ValueError, KeyError, struct.error):
                        pass
                yield _embedded(t, [(name, ring)], encoder, image_size, background)

    n = int(polygons.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "path", "id").sortWithinPartitions("path").mapInArrow(run, EMBEDDED)


def extract_outputs(images: DataFrame, encoder, head=None, bias=None, batch_rows: int = 32, image_col: str = "image") -> DataFrame:
    """images with features (the encoder's vectors of PNG images) and, given a linear head, logits: inference in batches."""
    import numpy as np
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    names = ["features", *(["logits"] if head is not None else [])]
    schema = StructType([*images.schema.fields, *[StructField(n, ArrayType(DoubleType())) for n in names]])

    def run(batches):
        import pyarrow as pa

        from tessera.sources.raster import from_png

        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                given = np.stack([from_png(x) for x in part.column(part.schema.get_field_index(image_col)).to_pylist()]) / 255.0
                x = np.asarray(encoder(given), float)
                out = [x, *([x @ np.asarray(head).T + np.asarray(bias)] if head is not None else [])]
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(v.tolist(), pa.list_(pa.float64())) for v in out]], names=[*part.schema.names, *names])

    return images.mapInArrow(run, schema)


def shuffled_batches(rows: DataFrame, size: int, seed: int, epoch: int = 0, key: str = "id") -> DataFrame:
    """rows with batch: their places in a shuffle that the seed and the epoch decide, cut into batches of a size."""
    from .retrieval import with_dense_ids

    mixed = rows.withColumn("__mixed", F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string"))))
    return with_dense_ids(mixed, ["__mixed", key], "__place").withColumn("batch", F.floor(F.col("__place") / size)).drop("__mixed", "__place")


def augment(rgb, seed: int, turn: float = 15.0, jitter: float = 0.2):
    """An image as training sees it: mirrored either way by chance, turned by up to so many degrees, its brightness, contrast
    and saturation changed by up to a share. The seed decides."""
    import numpy as np

    rng = np.random.default_rng(seed)
    a = np.asarray(rgb, float)
    for axis in (0, 1):
        if rng.random() < 0.5:
            a = np.flip(a, axis)
    angle, (h, w) = np.radians(rng.uniform(-turn, turn)), a.shape[:2]
    y, x = np.meshgrid(np.arange(h) - (h - 1) / 2, np.arange(w) - (w - 1) / 2, indexing="ij")
    rows = np.rint(np.cos(angle) * y - np.sin(angle) * x + (h - 1) / 2).astype(int)
    cols = np.rint(np.sin(angle) * y + np.cos(angle) * x + (w - 1) / 2).astype(int)
    held = (rows >= 0) & (rows < h) & (cols >= 0) & (cols < w)
    a = np.where(held[..., None], a[rows.clip(0, h - 1), cols.clip(0, w - 1)], 0.0)
    brightness, contrast, saturation = rng.uniform(1 - jitter, 1 + jitter, 3)
    a = a * brightness
    a = a.mean() + (a - a.mean()) * contrast
    grey = a.mean(axis=2, keepdims=True)
    return (grey + (a - grey) * saturation).clip(0, 255).astype(np.uint8)


def mean_colour_encoder(grid: int = 4):
    """A fixed encoder for tests and dry runs: mean colours of a grid of cells, less the mean of all."""

    def encode(images):
        import numpy as np

        out = []
        for image in images:
            a = np.asarray(image, float)
            cells = [c.mean(axis=(0, 1)) for r in np.array_split(a, grid, axis=0) for c in np.array_split(r, grid, axis=1)]
            v = np.concatenate(cells)
            out.append(v - v.mean() + 1e-6)
        return np.stack(out)

    return encode


def onnx_segmenter(path: str):
    """A segmenter that runs an ONNX model; each worker loads it once."""

    def segment(given):
        import onnxruntime
        import pyspark

        cache = pyspark.__dict__.setdefault("_tessera_onnx", {})
        if path not in cache:
            cache[path] = onnxruntime.InferenceSession(path, providers=onnxruntime.get_available_providers())
        session = cache[path]
        return session.run(None, {session.get_inputs()[0].name: given})

    return segment
