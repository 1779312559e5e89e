"""Benchmark decontamination: a prefix-filtered set join of item windows with the words of each document.

A window is ``width`` consecutive words of an item (a shorter item is one window). Containment needs all words of a
window, so its necessary prefix is one word: the rarest by the corpus counts. Occurrences of prefix words in a document
are joined with the item places they stand at; the place fixes where the window would start and end (positional and
length bounds), and the words around it are compared one by one over an item-sized stretch.

Items are collected in blocks of bounded size and each block is broadcast; as many blocks as the items need are run, and
their hits are united for each document.

Defined cases: null and empty texts, or texts without words, have no words and no hits; items without words have no
window; repeated item rows count once for their id; a null item id is left out of the items but its windows do hit;
document rows that repeat an id are judged each by its own text; other columns pass through, save those named as a
result column.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, materialise, pack, unpack, worker_cache

#: Bytes of item text in one broadcast block.
BLOCK_BYTES = 16 << 20
_KEEP = set(range(0x30, 0x3A)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
#: Lower-cases A-Z and turns every byte that belongs to no word into a space.
TABLE = bytes(b if b in _KEEP else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def _counter(vocabulary):
    def run(batches):
        from collections import Counter

        import pyarrow as pa

        worker_cache("contamination")
        known, found = vocabulary.value, Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(known.intersection(words_of(text)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    return run


def _prefixes(items: list[list[bytes]], rank: dict[bytes, tuple], width: int) -> dict[bytes, list[tuple[int, int]]]:
    """Word -> item places (item, place) at which it is the rarest word of some window."""
    found: dict[bytes, set] = {}
    for i, words in enumerate(items):
        for s in range(max(1, len(words) - width + 1)):
            q = min(range(s, min(s + width, len(words))), key=lambda k: (rank[words[k]], k))
            found.setdefault(words[q], set()).add((i, q))
    return {w: sorted(x) for w, x in found.items()}


def match_words(words: list[bytes], items: list[list[bytes]], prefixes: dict, width: int) -> tuple[list[bool] | None, set[int]]:
    """Which words are hit, and the items with a window here."""
    n, hit, seen = len(words), None, set()
    for p in [i for i, w in enumerate(words) if w in prefixes]:
        for i, q in prefixes[words[p]]:
            item = items[i]
            m, k = len(item), min(width, len(item))
            left = 0
            while left < k - 1 and q - left > 0 and p - left > 0 and item[q - left - 1] == words[p - left - 1]:
                left += 1
            right = 0
            while right < k - 1 and q + right + 1 < m and p + right + 1 < n and item[q + right + 1] == words[p + right + 1]:
                right += 1
            if left + right + 1 >= k:
                hit = hit or [False] * n
                hit[p - left : p + right + 1] = [True] * (left + right + 1)
                seen.add(i)
    return hit, seen


def _matcher(block, width: int):
    def run(batches):
        import pyarrow as pa

        worker_cache("contamination")
        items, names, prefixes = block.value
        for batch in batches:
            ids, sizes, spans, found = batch.column(0), [], [], []
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                hit, seen = match_words(words, items, prefixes, width)
                runs, at = [], 0
                while hit and at < len(words):
                    if hit[at]:
                        end = hit.index(False, at) if False in hit[at:] else len(words)
                        runs.append({"a": at, "b": end})
                        at = end
                    at += 1
                sizes.append(len(words))
                spans.append(runs)
                found.append(sorted({names[i] for i in seen if names[i] is not None}))
            yield pa.RecordBatch.from_arrays(
                [ids, batch.column(1).cast(pa.string()), batch.column(2), pa.array(sizes, pa.int64()), pa.array(spans, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(found, pa.list_(pa.string()))],
                names=[ID, TEXT, REST, "n_words", "hit_spans", "items"],
            )

    return run


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int):
    """Lists of (item id as text, words), each of bounded size; the driver holds one at a time."""
    held, size = [], 0
    for name, text in benchmark.select(F.col(f"`{item_col}`").cast("string"), F.col(f"`{text_col}`").cast("binary")).distinct().toLocalIterator():
        if words := words_of(bytes(text) if text is not None else None):
            held.append((name, words))
            size += len(text)
        if size >= block_bytes:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with n_words, n_hit, items (ids as sorted strings) and hit_spans (word places, end exclusive)."""
    spark, own = docs.sparkSession, ["n_words", "n_hit", "items", "hit_spans"]
    base = pack(docs, id_col, text_col, own)
    id_type, rest = ddl(base.schema[ID].dataType), ddl(base.schema[REST].dataType)
    schema = f"{ID} {id_type}, {TEXT} string, {REST} {rest}, n_words bigint, hit_spans array<struct<a: bigint, b: bigint>>, items array<string>"
    bare = base.select(ID, F.col(TEXT).cast("binary").alias(TEXT), REST)
    parts = []
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        items = [words for _, words in block]
        vocabulary = spark.sparkContext.broadcast(frozenset(w for words in items for w in words))
        counted = bare.select(TEXT).mapInArrow(_counter(vocabulary), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
        counts = {bytes(w): n for w, n in counted.toLocalIterator()}  # words of this block only
        rank = {w: (counts.get(w, 0), w) for w in vocabulary.value}
        sent = spark.sparkContext.broadcast((items, [name for name, _ in block], _prefixes(items, rank, width)))
        parts.append(sent)
    if not parts:
        parts.append(spark.sparkContext.broadcast(([], [], {})))
    if len(parts) == 1:
        found = bare.mapInArrow(_matcher(parts[0], width), schema)
    else:  # unite the blocks' hits for each row
        keyed = base.withColumn(REST, F.struct(F.col(REST), F.monotonically_increasing_id().alias("row")))
        keyed = materialise(keyed, "decontaminate")
        kept = keyed.select(ID, F.col(TEXT).cast("binary").alias(TEXT), REST)
        more = schema.replace(rest, ddl(keyed.schema[REST].dataType))
        hits = None
        for sent in parts:
            part = kept.mapInArrow(_matcher(sent, width), more).where(F.size("hit_spans") > 0).select(F.col(f"{REST}.row").alias("row"), "hit_spans", "items")
            hits = part if hits is None else hits.unionByName(part)
        merged = F.expr(
            "aggregate(array_sort(flatten(collect_list(hit_spans))), cast(array() as array<struct<a: bigint, b: bigint>>), (acc, x) -> if(size(acc) > 0 and element_at(acc, -1).b >= x.a,"
            " concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))), concat(acc, array(x))))"
        )
        hits = hits.groupBy("row").agg(merged.alias("hit_spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        empty = spark.sparkContext.broadcast(([], [], {}))
        found = kept.mapInArrow(_matcher(empty, width), more).drop("hit_spans", "items").withColumn("row", F.col(f"{REST}.row")).join(hits, "row", "left")
        found = found.select(ID, TEXT, F.col(f"{REST}.{REST}").alias(REST), "n_words", F.coalesce("hit_spans", F.expr("cast(array() as array<struct<a: bigint, b: bigint>>)")).alias("hit_spans"), F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"))
    n_hit = F.expr("aggregate(hit_spans, 0L, (s, x) -> s + x.b - x.a)")
    return unpack(found, docs, id_col, text_col, {"n_words": F.col("n_words"), "n_hit": n_hit, "items": F.col("items"), "hit_spans": F.col("hit_spans")})
