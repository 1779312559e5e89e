"""Line dedup: explode normalised lines, hash, count documents per hash, drop frequent lines, reassemble by position.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased. Keys of at least ``min_chars``
code points held by at least ``min_docs`` distinct document ids lose their lines everywhere but in the document with
the largest id that holds them.

Defined cases: null and empty texts are one empty line (kept text ''); a null id counts as one id below all others;
rows that repeat an id count once for it and are each rewritten; an empty table gives an empty table; other columns
pass through, save those named as a result column.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, hot_keys, materialise, pack, spread_join, unpack, worker_cache

SPACE = b" \t\n\x0b\x0c\r"


def _exploder(min_chars: int):
    def run(batches):
        import pyarrow as pa
        import xxhash

        worker_cache("lines")

        digest = xxhash.xxh3_128_digest
        for batch in batches:
            ids, rows, keys, places = [], [], [], []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen: dict[bytes, list[int]] = {}
                for i, line in enumerate((text or b"").split(b"\n")):
                    key = line.strip(SPACE)
                    if len(key) >= min_chars and (key.isascii() or len(key.decode(errors="replace")) >= min_chars):
                        seen.setdefault(digest(key.lower()), []).append(i)
                ids += [doc] * len(seen)
                rows += [row] * len(seen)
                keys += seen.keys()
                places += seen.values()
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), pa.array(rows, pa.int64()), pa.array(keys, pa.binary()), pa.array(places, pa.list_(pa.int32()))],
                names=["id", "row", "key", "places"],
            )

    return run


def _rewrite(batches):
    import pyarrow as pa

    worker_cache("lines")

    for batch in batches:
        kept, lines, dropped = [], [], []
        for text, places in zip(batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            text = text or b""
            n = text.count(b"\n") + 1
            if places:
                gone = set(places)
                text = b"\n".join(x for i, x in enumerate(text.split(b"\n")) if i not in gone)
            kept.append(text.decode(errors="replace"))
            lines.append(n)
            dropped.append(len(set(places)) if places else 0)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(kept, pa.string()), batch.column(2), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())],
            names=[ID, TEXT, REST, "n_lines", "n_dropped"],
        )


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with the text rewritten, and n_lines (before dropping) and n_dropped."""
    own = ["n_lines", "n_dropped"]
    base = pack(docs, id_col, text_col, own).withColumn("__row", F.xxhash64(TEXT))
    id_type = ddl(base.schema[ID].dataType)
    lines = base.select(ID, "__row", F.col(TEXT).cast("binary")).mapInArrow(_exploder(max(1, min_chars)), f"id {id_type}, row bigint, key binary, places array<int>")
    lines = materialise(lines, "lines")
    # one row for each key and document first: a hot key's documents are counted in many tasks
    frequent = materialise(lines.select("key", "id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keeper")).where(F.col("n") >= min_docs), "frequent")
    gone = (
        spread_join(lines, frequent.select("key", "keeper"), "key", hot_keys(frequent.select("key", "n"), "key", docs.sparkSession), ["id", "row"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias("__gid"), F.col("row").alias("__grow")).agg(F.flatten(F.collect_list("places")).alias("places"))
    )
    joined = base.join(gone, base[ID].eqNullSafe(gone["__gid"]) & (base["__row"] == gone["__grow"]), "left")
    rest = ddl(base.schema[REST].dataType)
    out = joined.select(ID, F.col(TEXT).cast("binary").alias(TEXT), REST, "places").mapInArrow(_rewrite, f"{ID} {id_type}, {TEXT} string, {REST} {rest}, n_lines bigint, n_dropped bigint")
    return unpack(out, docs, id_col, text_col, {c: F.col(c) for c in own})
