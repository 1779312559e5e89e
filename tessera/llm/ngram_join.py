"""N-gram Jaccard join: documents whose shingle sets overlap by at least a share of their union, by signature trees.

Words are lower-cased (A-Z) runs without ASCII white space; a document's set is its distinct shingles of five words
(with fewer words, the whole sequence). Shingles are compared by 64-bit hashes, equal sets by 128-bit digests.

Equal sets are one class. A class can link only if enough of a prefix of its set (in hash order, longer than a prefix
filter needs) is held by other classes; the others drop out (they are compared with nothing they could link with). The
rest get a second prefix, in order of rarity, and classes that share a prefix token are bound into one group. No link
crosses groups, so each group is joined by a signature tree of its own; a group that is too large for a task, or holds
more than a task's share of all tokens, is cut into parts, and every pair of parts is joined. Shared tokens are found by blocks of documents: a block sends each of its distinct
tokens once to the bucket of the token, so a token of a third of all documents is one row a block.

Defined cases: null and empty texts, and texts without words, have the empty set and are alone; a null id is carried as
null, and a component of null ids only has a null id; rows that repeat an id are compared each by its own text; ties
count as links (100 * intersection >= 80 * union); an empty table gives an empty table.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import _blocker, _from_blob, _to_blob
from .common import ID, REST, TEXT, ddl, hot_keys, in_small_batches, materialise, pack, partitions, spread_join, trim, unpack, worker_cache
from ..operators.components import components
from .signature_tree import Links
from .signature_tree import join as tree_join

BLOCK_BYTES, LEAST_BYTES = 32 << 20, 256 << 10
#: Tokens of one task's part of a group.
PART_TOKENS = 4 << 20
CACHED_WORDS = 250_000


def _hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    known = worker_cache("ngram").setdefault("ngram:words", {})
    if len(known) > CACHED_WORDS:
        known.clear()
    for w in set(words).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None, width: int):
    """Sorted distinct 64-bit hashes of the shingles."""
    import numpy as np

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = _hashes(words)
    k = min(width, len(words))
    mixed = np.full(len(one) - k + 1, np.uint64(k))
    for i in range(k):
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + one[i : len(one) - k + 1 + i]
    mixed ^= mixed >> np.uint64(32)
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def need(n: int, percent: int) -> int:
    """The least overlap of a set of n tokens with any set it links with."""
    return -(-percent * n // 100)


def spare(n: int) -> int:
    """Tokens by which the first prefix is longer than the filter needs, and so many must be shared, at least."""
    return n // 10 + 1


class Block:
    """The distinct sets of a block's documents, in order of their keys, and their first prefixes by bucket.

    Both passes meet the documents of a block in orders of their own; the order of keys is the same in each."""

    def __init__(self, texts, width: int, percent: int, buckets: int):
        import numpy as np
        import xxhash

        self.keys, self.sizes, found = [], [], {}
        for text in texts:
            s = shingle_set(text, width)
            key = xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None
            self.keys.append(key)
            self.sizes.append(len(s))
            if key is not None:
                found.setdefault(key, s)
        ordered = sorted(found)
        self.index, self.sets = {k: i for i, k in enumerate(ordered)}, [found[k] for k in ordered]
        self.tags = np.frombuffer(b"".join(k[:8] for k in ordered), "<u8")
        heads = [s[: min(len(s), len(s) - need(len(s), percent) + spare(len(s)))] for s in self.sets]
        tokens = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(heads)), [len(h) for h in heads])
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))


def _block_tokens(width: int, percent: int, buckets: int):
    """(block, bucket, tokens, for each owner its tag and how many tokens it has there)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        current, texts = None, []

        def rows():
            b = Block(texts, width, percent, buckets)
            for k in range(buckets):
                lo, hi = b.cuts[k], b.cuts[k + 1]
                if lo < hi:
                    owners, counts = np.unique(b.owner[lo:hi], return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([current], pa.int64()), pa.array([k], pa.int32()), pa.array([b.tokens[lo:hi].tobytes()], pa.binary()), pa.array([b.tags[owners].tobytes()], pa.binary()), pa.array([counts.astype("<u4").tobytes()], pa.binary())],
                        names=["block", "bucket", "tokens", "tags", "counts"],
                    )

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != current:
                    if texts:
                        yield from rows()
                    current, texts = block, []
                texts += _from_blob(blob).column(TEXT).to_pylist()
        if texts:
            yield from rows()
        del texts
        trim()

    return run


def _shared_flags(batches):
    """For each block's tokens in a bucket, whether sets of different tags hold them."""
    import numpy as np
    import pyarrow as pa

    def rows(bucket, held):
        tokens = np.concatenate([np.frombuffer(t, "<u8") for _, t, _, _ in held])
        tags = np.concatenate([np.repeat(np.frombuffer(g, "<u8"), np.frombuffer(c, "<u4")) for _, _, g, c in held])
        order = np.argsort(tokens, kind="stable")
        t, g = tokens[order], tags[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        mixed = np.minimum.reduceat(g, starts) != np.maximum.reduceat(g, starts)
        flags = np.empty(len(t), bool)
        flags[order] = np.repeat(mixed, np.diff(np.concatenate([starts, [len(t)]])))
        at = 0
        for block, toks, _, _ in held:
            n = len(toks) // 8
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([np.packbits(flags[at : at + n]).tobytes()], pa.binary())], names=["block", "bucket", "flags"])
            at += n

    current, held = None, []
    for batch in batches:
        for block, bucket, tokens, tags, counts in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if bucket != current:
                if held:
                    yield from rows(current, held)
                current, held = bucket, []
            held.append((block, tokens, tags, counts))
    if held:
        yield from rows(current, held)


def _keep_linkable(width: int, percent: int, buckets: int):
    """A row per document: id, row, size, key; and its set where it may link, once a key and block."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        tables = [_from_blob(b) for b in left.column("blob").to_pylist()]
        b = Block([t for x in tables for chunk in x.column(TEXT).chunks for t in chunk.to_pylist()], width, percent, buckets)
        shared = np.zeros(len(b.tokens), np.uint8)
        for k, flags in zip(right.column("bucket").to_pylist(), right.column("flags").to_pylist()):
            lo, hi = b.cuts[k], b.cuts[k + 1]
            shared[lo:hi] = np.unpackbits(np.frombuffer(flags, np.uint8))[: hi - lo]
        found = np.bincount(b.owner, shared, len(b.sets)) if len(b.sets) else []
        sets, seen = [], set()
        for key in b.keys:
            at = b.index.get(key)
            if key is None or key in seen or found[at] < spare(need(len(b.sets[at]), percent)):
                sets.append(None)
            else:
                seen.add(key)
                sets.append(b.sets[at].tobytes())
        whole = pa.concat_tables([t.drop_columns([TEXT]) for t in tables]).append_column("n", pa.array(b.sizes, pa.int64())).append_column("key", pa.array(b.keys, pa.binary()))
        whole = whole.append_column("set", pa.array(sets, pa.binary()))
        del b, tables, sets, shared
        trim()
        return whole

    return run


def _token_counts(buckets: int):
    """(block, bucket, distinct tokens, how many sets of the block hold each)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def rows(block, sets):
            tokens, counts = np.unique(np.concatenate(sets), return_counts=True)
            bucket = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for k in range(buckets):
                part = order[cuts[k] : cuts[k + 1]]
                if len(part):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([k], pa.int32()), pa.array([tokens[part].tobytes()], pa.binary()), pa.array([counts[part].astype("<u4").tobytes()], pa.binary())], names=["block", "bucket", "tokens", "counts"])

        current, sets = None, []
        for batch in batches:
            for block, s in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist()):
                if block != current:
                    if sets:
                        yield from rows(current, sets)
                    current, sets = block, []
                sets.append(np.frombuffer(s, "<u8"))
        if sets:
            yield from rows(current, sets)

    return run


def _sum_counts(batches):
    """The counts over all blocks, for each block's tokens in a bucket."""
    import numpy as np
    import pyarrow as pa

    def rows(bucket, held):
        tokens = np.concatenate([np.frombuffer(t, "<u8") for _, t, _ in held])
        _, inverse = np.unique(tokens, return_inverse=True)
        total = np.bincount(inverse, np.concatenate([np.frombuffer(c, "<u4") for _, _, c in held]))[inverse].astype("<u4")
        at = 0
        for block, toks, _ in held:
            n = len(toks) // 8
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_to_blob(pa.table({"n": pa.array(total[at : at + n])}))], pa.binary())], names=["block", "bucket", "total"])
            at += n

    current, held = None, []
    for batch in batches:
        for block, bucket, tokens, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if bucket != current:
                if held:
                    yield from rows(current, held)
                current, held = bucket, []
            held.append((block, tokens, counts))
    if held:
        yield from rows(current, held)


def _bind(percent: int, buckets: int):
    """Edges from each set of a block to the least of those that rare prefix tokens bind it to, and that least with each
    such token that other blocks hold too."""

    def run(left, right):
        import numpy as np
        import pyarrow as pa

        rows = sorted(zip(left.column("key").to_pylist(), left.column("set").to_pylist()))
        keys, sets = [k for k, _ in rows], [np.frombuffer(s, "<u8") for _, s in rows]
        tokens = np.unique(np.concatenate(sets))
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts, total = np.searchsorted(bucket[order], np.arange(buckets + 1)), np.zeros(len(tokens), np.int64)
        for k, blob in zip(right.column("bucket").to_pylist(), right.column("total").to_pylist()):
            total[order[cuts[k] : cuts[k + 1]]] = _from_blob(blob).column("n").to_numpy()
        found, owners = [], []
        for i, s in enumerate(sets):
            held = total[np.searchsorted(tokens, s)]
            common = s[held > 1]
            left_over = len(s) - need(len(s), percent) + 1 - (len(s) - len(common))  # of the prefix, after tokens no other set holds
            if left_over > 0:
                rare = common[np.lexsort((common, held[held > 1]))][:left_over]
                found.append(rare)
                owners.append(np.full(len(rare), i))
        none = pa.table({"token": pa.array([], pa.int64()), "a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        if not found:
            return none
        t, o = np.concatenate(found), np.concatenate(owners)
        order = np.lexsort((o, t))
        t, o = t[order], o[order]
        starts = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        sizes = np.diff(np.concatenate([starts, [len(t)]]))
        first = np.repeat(o[starts], sizes)
        links = Links(len(sets))
        for i, j in np.unique(np.stack([o, first])[:, o != first], axis=1).T.tolist():
            links.join(i, j)
        roots = [links.root(i) for i in range(len(sets))]
        stars = [(i, r) for i, r in enumerate(roots) if i != r]
        # only tokens that sets of other blocks hold too can bind blocks; the same root stands for all sets bound here
        abroad = total[np.searchsorted(tokens, t[starts])] > np.unique(np.concatenate(sets), return_counts=True)[1][np.searchsorted(tokens, t[starts])]
        heads = starts[abroad]
        return pa.concat_tables([
            pa.table({"token": pa.array(t[heads].view(np.int64)), "a": pa.array([keys[roots[i]] for i in o[heads].tolist()], pa.binary()), "b": pa.nulls(len(heads), pa.binary())}),
            pa.table({"token": pa.nulls(len(stars), pa.int64()), "a": pa.array([keys[i] for i, _ in stars], pa.binary()), "b": pa.array([keys[j] for _, j in stars], pa.binary())}),
        ])

    return run


def _join_groups(percent: int):
    """Links of each (label, i, j), as stars of components: all of side 0 among themselves, or side 0 against side 1."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def links(held, cross):
            sets = [np.frombuffer(s, "<u8") for _, _, s in held]
            left = [i for i, (side, _, _) in enumerate(held) if side == 0]
            right = [i for i, (side, _, _) in enumerate(held) if side == 1] if cross else None
            bound = Links(len(sets))
            for i, j in tree_join(sets, left, right, percent):
                bound.join(i, j)
            return [(held[i][1], held[r][1]) for i in range(len(sets)) if (r := bound.root(i)) != i]  # a star for each component

        def batch_of(pairs):
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in pairs], pa.binary()), pa.array([b for _, b in pairs], pa.binary())], names=["a", "b"])

        current, held, out = None, [], []
        for batch in batches:
            for label, i, j, side, key, s in zip(*(batch.column(c).to_pylist() for c in range(6))):
                if (label, i, j) != current:
                    if held:
                        out += links(held, current[1] != current[2])
                    current, held = (label, i, j), []
                    if len(out) > 10_000:
                        yield batch_of(out)
                        out = []
                held.append((side, key, s))
        if held:
            out += links(held, current[1] != current[2])
        yield batch_of(out)

    return run


def _blocks(size: int, n: int, unit: int, least: int) -> int:
    return max(1, -(-size // unit), min(n, -(-size // least)))


def group_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, part_tokens: int = PART_TOKENS) -> DataFrame:
    """A row per document: id, row (xxhash64 of its text), n_shingles and component_id, the least id of its component."""
    spark = docs.sparkSession
    n = partitions(spark)
    in_small_batches(spark)
    text = F.col(f"`{text_col}`")
    base = docs.select(F.col(f"`{id_col}`").alias(ID), text.cast("binary").alias(TEXT), F.xxhash64(text).alias(REST))
    id_type = ddl(base.schema[ID].dataType)
    blocks = _blocks(docs.select(F.sum(F.octet_length(text))).first()[0] or 0, n, BLOCK_BYTES, LEAST_BYTES)
    dealt = (
        base.select(F.pmod(F.xxhash64(ID, REST), F.lit(blocks)).cast("bigint").alias("block"), ID, TEXT, REST)
        .mapInArrow(_blocker, "block bigint, blob binary")
        .repartition(n, "block")
    )
    tokens = dealt.sortWithinPartitions("block").mapInArrow(_block_tokens(width, percent, n), "block bigint, bucket int, tokens binary, tags binary, counts binary")
    flags = tokens.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_shared_flags, "block bigint, bucket int, flags binary")
    found = dealt.groupBy("block").cogroup(flags.groupBy("block")).applyInArrow(_keep_linkable(width, percent, n), f"{ID} {id_type}, {REST} bigint, n bigint, key binary, `set` binary")
    found = materialise(found, "sets")

    sets = materialise(found.where("`set` is not null").groupBy("key").agg(F.first("n").alias("n"), F.first("set").alias("set")), "linkable")
    total = sets.select(F.sum("n")).first()[0] or 0
    parts = _blocks(8 * total, n, BLOCK_BYTES // 2, LEAST_BYTES)
    placed = sets.select(F.pmod(F.xxhash64("key"), F.lit(parts)).cast("bigint").alias("block"), "key", "n", "set").repartition(n, "block")
    counted = placed.sortWithinPartitions("block").mapInArrow(_token_counts(n), "block bigint, bucket int, tokens binary, counts binary")
    summed = counted.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_sum_counts, "block bigint, bucket int, total binary")
    bound = placed.groupBy("block").cogroup(summed.groupBy("block")).applyInArrow(_bind(percent, n), "token bigint, a binary, b binary")
    bound = materialise(bound, "bound")
    heads = bound.where("token is not null").select("token", "a")
    least = heads.groupBy("token").agg(F.min("a").alias("b"))
    edges = bound.where("token is null").select("a", "b").unionByName(heads.join(least, "token").where("a <> b").select("a", "b"))
    groups = components(edges)

    members = groups.join(sets, groups["node"] == sets["key"]).select("label", "key", "n", "set")
    sizes = groups.join(sets.select("key", "n"), groups["node"] == F.col("key")).groupBy("label").agg(F.sum("n").alias("tokens"))
    # a group of a share f of all tokens is cut so that its pairs of parts are some f * n tasks of the n there are
    cut = F.greatest(F.lit(1), F.ceil(F.col("tokens") / part_tokens), F.floor(F.sqrt(2.0 * n * F.col("tokens") / F.lit(float(max(total, 1)))))).cast("int")
    # a group, a component and the copies of a text may each hold a third of all rows: their rows are spread in the joins
    crowded = hot_keys(groups.groupBy("label").agg(F.count(F.lit(1)).alias("n")), "label", spark)
    split = spread_join(members, sizes.select("label", cut.alias("cuts")), "label", crowded, ["key"]).withColumn("own", F.pmod(F.xxhash64("key"), F.col("cuts")).cast("int"))
    # a part meets itself and every other part of its group
    met = split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
    dealt_groups = met.select("label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).cast("int").alias("side"), "key", "set")
    linked = dealt_groups.repartition(n, "label", "i", "j").sortWithinPartitions("label", "i", "j", "key").mapInArrow(_join_groups(percent), "a binary, b binary")
    labels = components(linked)

    least_id = found.where("key is not null").groupBy("key").agg(F.min(ID).alias("least"), F.count(F.lit(1)).alias("n"))
    labelled = materialise(least_id.join(labels, least_id["key"] == labels["node"], "left").select("key", "least", "n", F.coalesce("label", "key").alias("label")), "classes")
    of_label = labelled.groupBy("label").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("n"))
    of_key = spread_join(labelled.select("key", "label"), of_label.select("label", "component_id"), "label", hot_keys(of_label.select("label", "n"), "label", spark), ["key"]).select("key", "component_id")
    out = spread_join(found.select(ID, REST, "n", "key"), of_key, "key", hot_keys(labelled.select("key", "n"), "key", spark), [ID, REST], "left")
    return out.select(F.col(ID).alias(id_col), F.col(REST).alias("row"), F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col(ID)).otherwise(F.col("component_id")).alias("component_id"))


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that have a smaller id in their component; of rows alike in id and text one stays."""
    found = group_near_duplicates(docs, id_col, text_col, width, percent)
    kept = found.where(F.col(f"`{id_col}`").eqNullSafe(F.col("component_id"))).select(F.col(f"`{id_col}`").alias("__kid"), F.col("row").alias("__krow")).distinct()
    held = pack(docs, id_col, text_col, []).withColumn("__row", F.xxhash64(TEXT))
    out = held.join(kept, held[ID].eqNullSafe(kept["__kid"]) & (held["__row"] == kept["__krow"]), "left_semi").dropDuplicates([ID, "__row"])
    return unpack(out, docs, id_col, text_col, {})
