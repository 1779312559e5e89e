"""Token-ID output: every id in the fewest bits the vocabulary needs, packed into shards with block offsets.

A shard is a self-contained image kept in one row of a Parquet table, so that a task that is lost or tried again
leaves no half-written file. Layout, little-endian:

    magic 8 bytes | bits u32 | ids per block u32 | ids u64 | blocks u64 | (blocks + 1) byte offsets u64 | packed blocks

Each block starts on a byte, so a range of ids is read by unpacking only the blocks it meets.

Documents stand in ascending order of id over all shards (a null id first, equal ids by a hash of their text); one
closing id is appended to each. Defined cases: null and empty texts hold the closing id alone; a long text is encoded
whole; an empty table gives no shard; other columns are not stored.
"""

import re
import struct

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ddl, in_small_batches, materialise, partitions, worker_cache

MAGIC = b"TSRPACK1"
BLOCK_IDS = 4096
#: Ids after which a shard is closed; a longer document has a shard of its own size.
SHARD_IDS = 1 << 20
#: Words whose ids a worker keeps, before it starts again.
CACHED_WORDS = 1_500_000


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_ids(ids, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    import numpy as np

    ids = np.asarray(ids, dtype=np.uint32)
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError(f"an id needs more than {bits} bits")
    blocks = []
    for at in range(0, len(ids), block_ids):
        part = ids[at : at + block_ids]
        if bits in (8, 16, 32):
            blocks.append(part.astype(f"<u{bits // 8}").tobytes())
        else:
            lanes = (part[:, None] >> np.arange(bits, dtype=np.uint32)) & 1
            blocks.append(np.packbits(lanes.astype(np.uint8).ravel(), bitorder="little").tobytes())
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in blocks])]).astype("<u8")
    return MAGIC + struct.pack("<IIQQ", bits, block_ids, len(ids), len(blocks)) + offsets.tobytes() + b"".join(blocks)


def read_ids(image, start: int = 0, stop: int | None = None):
    """Ids [start, stop) of a shard image, as a numpy array."""
    import numpy as np

    if bytes(image[:8]) != MAGIC:
        raise ValueError("not a packed shard")
    bits, block_ids, n, blocks = struct.unpack_from("<IIQQ", image, 8)
    stop = n if stop is None else min(stop, n)
    if start >= stop:
        return np.zeros(0, np.uint32)
    offsets = np.frombuffer(image, "<u8", blocks + 1, 32)
    base, first, last = 32 + 8 * (blocks + 1), start // block_ids, (stop - 1) // block_ids
    skip = first * block_ids
    count = min(n, (last + 1) * block_ids) - skip
    if bits in (8, 16, 32):
        ids = np.frombuffer(image, f"<u{bits // 8}", count, base + int(offsets[first])).astype(np.uint32)
    else:
        parts = []
        for b in range(first, last + 1):  # each block starts on a byte
            raw = np.frombuffer(image, np.uint8, int(offsets[b + 1] - offsets[b]), base + int(offsets[b]))
            k = min(block_ids, n - b * block_ids)
            lanes = np.unpackbits(raw, bitorder="little")[: k * bits].reshape(k, bits)
            parts.append((lanes.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32))
        ids = np.concatenate(parts)
    return ids[start - skip : stop - skip]


def drops_white_space(spec: dict) -> bool:
    """Whether a tokenizer's description shows that runs between ASCII white space are encoded each by itself: what it does
    to characters looks at no neighbours over white space, its first cut drops white space, and no added token holds,
    or eats, any."""
    flat = lambda x, key: [y for z in x[key] for y in flat(z, key)] if x and x.get("type") == "Sequence" else [x] if x else []
    for n in flat(spec.get("normalizer"), "normalizers"):
        blank = n["type"] == "Replace" and n.get("content") in ("", " ") and n.get("pattern", {}).get("Regex") in (r"\s+", r"\s")
        if n["type"] not in ("NFC", "NFD", "Lowercase", "StripAccents") and not blank:
            return False
    cuts = flat(spec.get("pre_tokenizer"), "pretokenizers")
    if not cuts:
        return False
    first, *rest = cuts
    regex = (first.get("pattern") or {}).get("Regex", "")
    split = first["type"] == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True and regex.endswith(LETTERS_DIGITS_SIGNS) and "\\s" not in regex[: -len(LETTERS_DIGITS_SIGNS)] and " " not in regex
    if not split and first["type"] not in ("Whitespace", "WhitespaceSplit", "BertPreTokenizer"):
        return False
    if any(r["type"] not in ("ByteLevel", "Digits", "Punctuation") or r.get("add_prefix_space") for r in rest):
        return False
    if spec.get("truncation") or spec.get("padding"):
        return False
    return not any(t["lstrip"] or t["rstrip"] or t["single_word"] or any(c.isspace() for c in t["content"]) for t in spec.get("added_tokens") or [])


#: The end of a cut into letters, single digits and runs of other signs.
LETTERS_DIGITS_SIGNS = r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """Encodes through the library: one distinct run of characters between ASCII white space at a time where the tokenizer
    drops white space, whole texts for any other tokenizer."""

    def __init__(self, tokenizer_path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(tokenizer_path), {}
        spec = json.loads(self.tokenizer.to_str())
        self.by_word = drops_white_space(spec)
        self.lowers = '"Lowercase"' in json.dumps(spec["normalizer"])
        first = ((spec["pre_tokenizer"] or {}).get("pretokenizers") or [{}])[0]
        self.splits = self.by_word and first.get("type") == "Split"
        self.two = re.compile(rb"([A-Za-z]+)([!-&(-/:;=>?@\[-`{}~]+)")
        self.marks = [(d.encode(), ids[0]) for d in "0123456789" if len(ids := self.tokenizer.encode(d, add_special_tokens=False).ids) == 1]

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian u32."""
        import numpy as np

        if not self.by_word:
            out = []
            for at in range(0, len(texts), 64):
                found = self.tokenizer.encode_batch_fast([t.decode(errors="replace") for t in texts[at : at + 64]], add_special_tokens=False)
                out += [np.asarray(e.ids, "<u4").tobytes() for e in found]
            return out
        # lower-casing ASCII texts beforehand changes no ids, unless it makes a special string; fewer words are left
        split = [(t.lower() if self.lowers and t.isascii() and b"<|" not in t else t).split() for t in texts]
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        words = self.words
        met = set().union(*split).difference(words)
        # letters before plain punctuation are tokens of their own, and so is the punctuation
        parts = {w: m.groups() for w in met if (m := self.two.fullmatch(w))} if self.splits else {}
        new = met.difference(parts).union(*parts.values()).difference(words)
        # words travel joined by a digit none of them holds: the pre-tokenizer sets each digit apart, white space does the rest
        for digit, mark in self.marks:
            if not new:
                break
            part = [w for w in new if digit not in w]
            new = [w for w in new if digit in w]
            groups = [part[at : at + 128] for at in range(0, len(part), 128)]
            sep = b" %s " % digit
            joined = [sep.join(g).decode(errors="replace") for g in groups]
            for at in range(0, len(groups), 64):
                for group, e in zip(groups[at : at + 64], self.tokenizer.encode_batch_fast(joined[at : at + 64], add_special_tokens=False)):
                    ids = np.asarray(e.ids, "<u4")
                    ends = np.flatnonzero(ids == mark).tolist()
                    raw, start = ids.tobytes(), 0
                    if len(ends) != len(group) - 1:
                        raise ValueError("the tokenizer does not keep words apart")
                    for w, end in zip(group, [*ends, len(ids)]):
                        words[w] = raw[4 * start : 4 * end]
                        start = end + 1
        for w in new:  # holds every digit
            words[w] = np.asarray(self.tokenizer.encode(w.decode(errors="replace"), add_special_tokens=False).ids, "<u4").tobytes()
        for w, (letters, signs) in parts.items():
            words[w] = words[letters] + words[signs]
        return [b"".join(map(words.__getitem__, ws)) for ws in split]


def _packer(tokenizer_path: str, end_id: int, bits: int, shard_ids: int, key: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        cache = worker_cache("tokens")
        encoder = cache.get(key) or cache.setdefault(key, WordEncoder(tokenizer_path))
        part, end = TaskContext.get().partitionId(), np.asarray([end_id], "<u4").tobytes()
        docs, lens, ids, held, before, shard = [], [], [], 0, 0, 0

        def close():
            nonlocal docs, lens, ids, held, before, shard
            image = pack_ids(np.frombuffer(b"".join(ids), "<u4"), bits)
            row = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([shard], pa.int64()), pa.array([before], pa.int64()), pa.array([held], pa.int64()),
                 pa.array([docs], pa.list_(id_type)), pa.array([lens], pa.list_(pa.int64())), pa.array([image], pa.binary())],
                names=["part", "shard", "before", "n_ids", "docs", "lens", "image"],
            )
            docs, lens, ids, before, shard, held = [], [], [], before + held, shard + 1, 0
            return row

        for batch in batches:
            id_type, keys = batch.schema.field(0).type, batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 512):
                for doc, got in zip(keys[at : at + 512], encoder.encode([t or b"" for t in texts[at : at + 512]])):
                    docs.append(doc)
                    ids += (got, end)
                    lens.append(len(got) // 4 + 1)
                    held += lens[-1]
                    if held >= shard_ids:
                        yield close()
        if docs:
            yield close()

    return run


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS) -> DataFrame:
    """The shard table, written and read back: part, shard, before (ids of this part before it), n_ids, docs, lens, image."""
    from tokenizers import Tokenizer

    in_small_batches(docs.sparkSession)
    bits = bits_for(max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    id_type = ddl(rows.schema["id"].dataType)
    dealt = rows.repartitionByRange(partitions(docs.sparkSession), F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"), "text")
    shards = dealt.mapInArrow(
        _packer(tokenizer_path, end_id, bits, shard_ids, f"words:{tokenizer_path}"),
        f"part int, shard bigint, before bigint, n_ids bigint, docs array<{id_type}>, lens array<bigint>, image binary",
    )
    return materialise(shards, "tokens", "lz4")


def _reader(batches):
    import zlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for docs, lens, start, image in zip(*(batch.column(i).to_pylist() for i in range(4))):
            ids, at, crcs, starts = read_ids(image).astype("<u4"), 0, [], []
            view = memoryview(ids).cast("B")
            for n in lens:
                crcs.append(zlib.crc32(view[4 * at : 4 * (at + n)]))
                starts.append(start + at)
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(docs, batch.schema.field(0).type.value_type), pa.array(starts, pa.int64()), pa.array(lens, pa.int64()), pa.array(crcs, pa.int64())], names=["id", "start", "n_tokens", "ids_crc32"])


def read_token_files(shards: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document from the shards: id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row for each part, of which there are as many as shuffle partitions
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    bases = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    id_type = ddl(shards.schema["docs"].dataType.elementType)
    placed = shards.join(F.broadcast(bases), "part").select("docs", "lens", (F.col("base") + F.col("before")).alias("start"), "image")
    return placed.mapInArrow(_reader, f"id {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint").withColumnRenamed("id", id_col)
