"""Media columns: Netpbm and BMP images in a binary column, decoded to numpy, area-resized and kept as NPY tiles.

Resizing averages each target pixel's area exactly, from an integral image. The feature is a difference hash of
``hash_size`` by ``hash_size`` bits, in hexadecimal.

Defined cases: null and empty texts are one row of zero samples; a null or unreadable image gives null results; other
columns pass through, save those named as a result column; an empty table gives an empty table.
"""

import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, in_small_batches, materialise, pack, unpack

WIDTH = 64
TILE = 16
HASH = 8


def _netpbm_fields(data: bytes, n: int) -> tuple[list[int], int]:
    """n numbers of the header after the magic, and the place after the one white-space byte that ends it."""
    out, at = [], 2
    while len(out) < n:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        out.append(int(data[at:end]))
        at = end
    return out, at + 1


def decode_image(data: bytes):
    """The samples of an image; what is no whole image of a size above zero raises ValueError."""
    try:
        samples = _decode(data)
    except (TypeError, struct.error, IndexError, OverflowError, MemoryError, ZeroDivisionError) as cause:
        raise ValueError("not a whole image") from cause
    if not samples.size:
        raise ValueError("an image without samples")
    return samples


def _decode(data: bytes):
    """A Netpbm (P1 to P6) or uncompressed BMP (8, 24 or 32 bits) image as (height, width) or (height, width, 3) samples."""
    import numpy as np

    kind = data[:2]
    if kind == b"BM":
        start, = struct.unpack_from("<I", data, 10)
        head, w, h, _, bits, packed = struct.unpack_from("<IiiHHI", data, 14)
        if packed or bits not in (8, 24, 32) or w <= 0 or abs(h) * w * bits // 8 > len(data):
            raise ValueError("BMP of an unsupported kind or size")
        stride = (w * bits // 8 + 3) // 4 * 4
        rows = np.frombuffer(data, np.uint8, stride * abs(h), start).reshape(abs(h), stride)[:, : w * bits // 8]
        rows = rows[::-1] if h > 0 else rows
        if bits == 8:
            used = struct.unpack_from("<I", data, 46)[0] or 256
            palette = np.frombuffer(data, np.uint8, 4 * used, 14 + head).reshape(-1, 4)[:, 2::-1]
            if (palette == palette[:, :1]).all():  # grey
                return palette[:, 0][rows]
            return palette[rows]
        return rows.reshape(abs(h), w, bits // 8)[:, :, 2::-1]
    if kind in (b"P1", b"P2", b"P3"):
        fields, at = _netpbm_fields(data, 2 if kind == b"P1" else 3)
        body = b"\n".join(x.split(b"#")[0] for x in data[at - 1 :].split(b"\n"))
        values = list(body.translate(None, b" \t\r\n\x0b\x0c")) if kind == b"P1" else [int(x) for x in body.split()]
        w, h = fields[:2]
        if kind == b"P1":
            return (255 * (1 - (np.asarray(values[: w * h], np.int64) - 48))).astype(np.uint8).reshape(h, w)
        return np.asarray(values[: w * h * (3 if kind == b"P3" else 1)]).astype(np.uint8 if fields[2] < 256 else np.uint16).reshape((h, w, 3) if kind == b"P3" else (h, w))
    if kind == b"P4":
        (w, h), at = _netpbm_fields(data, 2)
        bits = np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at).reshape(h, -1), axis=1)[:, :w]
        return (255 * (1 - bits)).astype(np.uint8)
    if kind in (b"P5", b"P6"):
        (w, h, most), at = _netpbm_fields(data, 3)
        depth = 3 if kind == b"P6" else 1
        samples = np.frombuffer(data, np.uint8 if most < 256 else ">u2", w * h * depth, at)
        return samples.reshape((h, w, 3) if depth == 3 else (h, w))
    raise ValueError("neither Netpbm nor BMP")


def encode_pgm(samples) -> bytes:
    h, w = samples.shape
    return b"P5\n%d %d\n255\n" % (w, h) + samples.tobytes()


def encode_bmp(samples) -> bytes:
    """An 8-bit grey BMP."""
    import numpy as np

    h, w = samples.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    start = 54 + 1024
    return b"BM" + struct.pack("<IHHI", start + rows.size, 0, 0, start) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 256) + palette.tobytes() + rows.tobytes()


def area_resize(samples, height: int, width: int):
    """Each target pixel is the mean over its area of the source, read off an integral image with fractional edges."""
    import numpy as np

    grey = samples if samples.ndim == 2 else samples.mean(axis=2)
    h, w = grey.shape
    total = np.zeros((h + 1, w + 1))
    total[1:, 1:] = grey.cumsum(axis=0, dtype=np.float64).cumsum(axis=1)

    def lines(table, n, m):  # the table at m + 1 evenly spaced places of its first axis
        at = np.arange(m + 1) * (n / m)
        low = np.minimum(at.astype(np.int64), n - 1)
        part = (at - low).reshape(-1, *[1] * (table.ndim - 1))
        return table[low] * (1 - part) + table[low + 1] * part

    edge = lines(lines(total, h, height).T, w, width).T
    sums = edge[1:, 1:] - edge[:-1, 1:] - edge[1:, :-1] + edge[:-1, :-1]
    return sums / ((h / height) * (w / width))


def difference_hash(samples, size: int = HASH) -> str:
    import numpy as np

    small = np.round(area_resize(samples, size, size + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(samples, size: int = TILE) -> bytes:
    import io

    import numpy as np

    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(samples, size, size)), 0, 255).astype(np.uint8))
    return out.getvalue()


def _encoder(form: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        encode = {"pgm": encode_pgm, "bmp": encode_bmp}[form]
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                media, sizes, tiles = [], [], []
                for text in texts[at : at + 512]:
                    data = text or b""
                    sizes.append(len(data))
                    data += b"\0" * (-len(data) % WIDTH or (0 if data else WIDTH))
                    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
                    media.append(encode(samples))
                    tiles.append(npy_tile(samples))
                part = batch.slice(at, len(media))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(tiles, pa.binary())], names=[ID, REST, "n_bytes", "media", "tile"])

    return run


def store_text_as_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", form: str = "pgm") -> DataFrame:
    """A media table, written to the shared folder and read back: id, other columns, n_bytes, media and its NPY tile.

    Each text's UTF-8 bytes, with zeros up to a positive multiple of 64, are the samples of a grey image 64 wide."""
    base = pack(docs, id_col, text_col, ["n_bytes", "media", "tile"])
    id_type, rest = ddl(base.schema[ID].dataType), ddl(base.schema[REST].dataType)
    made = base.select(ID, F.col(TEXT).cast("binary"), REST).mapInArrow(_encoder(form), f"{ID} {id_type}, {REST} {rest}, n_bytes bigint, media binary, tile binary")
    made = unpack(made, docs.drop(text_col), id_col, text_col, {c: F.col(c) for c in ("n_bytes", "media", "tile")})
    return materialise(made, "media")


def read_tile(data: bytes):
    """The samples of an NPY tile."""
    import io

    import numpy as np

    return np.load(io.BytesIO(data), allow_pickle=False)


def _describe(stored: bool):
    """Rows (id, other columns, media, tile if stored) described; a tile is made where none is stored."""

    def run(batches):
        import hashlib
        import zlib

        import numpy as np
        import pyarrow as pa

        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.float64()]
        for batch in batches:
            rows = []
            tiles = batch.column(3).to_pylist() if stored else [None] * batch.num_rows
            for media, tile in zip(batch.column(2).to_pylist(), tiles):
                try:
                    samples = np.ascontiguousarray(decode_image(media))
                    tile = tile or npy_tile(samples)
                    mean = float(read_tile(tile).mean())
                except (ValueError, TypeError):
                    rows.append((None,) * len(OWN))
                    continue
                payload = samples.tobytes()
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), difference_hash(samples), samples.shape[1], samples.shape[0], tile, mean))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names=[ID, REST, *OWN])

    return run


OWN = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height", "tile", "tile_mean")


def describe_media(table: DataFrame, id_col: str = "doc_id", media_col: str = "media", tile_col: str | None = None) -> DataFrame:
    """What the decoded samples of each image show: sizes, digests, difference hash, NPY tile (read from tile_col, or made) and the
    tile's mean."""
    base = pack(table, id_col, media_col, list(OWN))
    id_type, rest = ddl(base.schema[ID].dataType), ddl(base.schema[REST].dataType)
    schema = f"{ID} {id_type}, {REST} {rest}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, width int, height int, tile binary, tile_mean double"
    given = base.select(ID, REST, TEXT)
    if tile_col:  # beside the packed columns, as tile is a name of the result
        in_small_batches(table.sparkSession)
        rest_cols = [c for c in table.columns if c.lower() not in {id_col.lower(), media_col.lower(), *OWN}]
        packed = F.struct(*[F.col(f"`{c}`") for c in rest_cols]) if rest_cols else F.struct(F.lit(None).cast("int").alias("__none"))
        given = table.select(F.col(f"`{id_col}`").alias(ID), packed.alias(REST), F.col(f"`{media_col}`").alias(TEXT), F.col(f"`{tile_col}`").alias("__tile"))
    made = given.mapInArrow(_describe(bool(tile_col)), schema)
    return unpack(made, table.drop(media_col), id_col, media_col, {c: F.col(c) for c in OWN})
