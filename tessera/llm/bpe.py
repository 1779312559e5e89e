"""Byte-level BPE: a global shuffle of distinct words, each encoded once; decoding joins the token-byte table.

Encoding. Documents are dealt into blocks by a hash of the row; a block's documents travel compressed, and this one
exchange serves both passes. First pass: the pre-tokens of a block are exploded and its distinct words dealt to word
buckets by hash, packed in sorted order (pre-aggregated: one entry per word and block). In its bucket each distinct word
of the corpus is encoded once. The ids join back to the blocks in the same sorted order. Second pass: a block walks the
pre-tokens of each document by position and puts their ids together.

Decoding. Ids are looked up in the token-byte table of the rank file, whose size the vocabulary bounds.

Defined cases: null and empty texts have no ids and decode to no bytes; a long text is a document like any other, in a
block of its own size; repeated rows are each encoded; an empty table gives an empty table; other columns pass through,
save those named as a result column; a null array of ids decodes to null; unknown ids fail.
"""

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ID, REST, TEXT, ddl, pack, partitions, trim, unpack, worker_cache

#: UTF-8 bytes of text at most aimed at in one block; small inputs have a block for each shuffle partition.
BLOCK_BYTES, LEAST_BYTES = 32 << 20, 256 << 10
#: Bytes of text after which a task hands on its part of a block.
PIECE_BYTES = 4 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}


def _encoding(ranks_path: str, pattern: str):
    cache, key = worker_cache("bpe"), f"bpe:{ranks_path}:{pattern}"
    if key not in cache:
        import tiktoken

        cache[key] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
    return cache[key]


class Splitter:
    """Pre-tokens of texts; most texts by way of the distinct pieces between their spaces.

    Where every run of white space is one character, a space belongs to what follows it, so that the pieces between
    spaces, each with its space, are split alike wherever they stand. Other texts are split whole."""

    def __init__(self, pattern: str):
        import regex

        # white space as Unicode defines it, which leaves out four control characters that Python counts in
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall

    @staticmethod
    def pieces(text: str) -> list[str] | None:
        """What stands between single spaces; None if white space stands together, begins or ends the text."""
        if len(text.split()) != text.count(" ") + text.count("\n") + 1:
            return None
        return text.split(" ")

    def of_piece(self, piece: str) -> list[str]:
        """The pre-tokens of a piece and the space before it; letters, and letters before points, need no pattern."""
        if piece.isalpha():
            return [" " + piece]
        letters = piece.rstrip(".,;:!?*#%&$")
        if letters.isalpha():
            return [" " + letters, piece[len(letters) :]]
        return self.split(" " + piece)

    def add(self, text: str | None, words: set[str], pieces: set[str]) -> None:
        """Puts the text's pieces that follow a space into pieces, and its other pre-tokens into words."""
        if text:
            if (parts := self.pieces(text)) is None:
                words.update(self.split(text))
            else:
                words.update(self.split(parts[0]))
                pieces.update(parts[1:])


def _to_blob(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _from_blob(blob: bytes):
    import pyarrow as pa

    return pa.ipc.open_stream(blob).read_all()


def _blocker(batches):
    """A task's documents of each block, compressed together."""
    import numpy as np
    import pyarrow as pa

    held: dict[int, list] = {}
    sizes: dict[int, int] = {}

    def blob(b):
        sizes.pop(b)
        return pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([_to_blob(pa.Table.from_batches(held.pop(b)).combine_chunks())], pa.binary())], names=["block", "blob"])

    for batch in batches:
        blocks = batch.column(0).to_numpy()
        order = np.argsort(blocks, kind="stable")
        taken = pa.RecordBatch.from_arrays([c.take(pa.array(order)) for c in batch.columns[1:]], names=batch.schema.names[1:])
        values, starts = np.unique(blocks[order], return_index=True)
        for b, start, end in zip(values.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)]):
            for at in range(start, end, 256):  # a piece stays small whatever the length of the documents
                part = taken.slice(at, min(256, end - at))
                held.setdefault(b, []).append(part)
                sizes[b] = sizes.get(b, 0) + part.nbytes
                if sizes[b] >= PIECE_BYTES:
                    yield blob(b)
    for b in list(held):
        yield blob(b)


def _bucketed(words, buckets: int) -> list[list[str]]:
    """The words dealt by hash, each bucket sorted: the order both passes agree on."""
    from zlib import crc32

    out: list[list[str]] = [[] for _ in range(buckets)]
    for w in words:
        out[crc32(w.encode(errors="surrogatepass")) % buckets].append(w)
    for x in out:
        x.sort()
    return out


def _pack_words(words: list[str]) -> bytes:
    import pyarrow as pa

    return _to_blob(pa.table({"w": pa.array(words, pa.string())}))


def _block_words(pattern: str, buckets: int):
    """(block, bucket, packed words) of each block; the rows of a block follow one another."""

    def run(batches):
        import pyarrow as pa

        worker_cache("bpe")
        splitter, current, words, pieces = Splitter(pattern), None, set(), set()

        def rows():
            words.update(w for p in pieces for w in splitter.of_piece(p))
            dealt = [(k, _pack_words(x)) for k, x in enumerate(_bucketed(words, buckets)) if x]
            return pa.RecordBatch.from_arrays([pa.array([current] * len(dealt), pa.int64()), pa.array([k for k, _ in dealt], pa.int32()), pa.array([x for _, x in dealt], pa.binary())], names=["block", "bucket", "words"])

        for batch in batches:
            for block, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if block != current:
                    if words:
                        yield rows()
                    current, words, pieces = block, set(), set()
                for text in _from_blob(blob).column(TEXT).to_pylist():
                    splitter.add(text, words, pieces)
        if words:
            yield rows()
        del words, pieces
        trim()

    return run


def _encode_words(ranks_path: str, pattern: str):
    """The ids of each packed word list, a word of a bucket encoded when it is first met."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        piece, current, known = _encoding(ranks_path, pattern)._core_bpe.encode_single_piece, None, {}
        for batch in batches:
            for block, bucket, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if bucket != current:
                    current, known = bucket, {}
                words = _from_blob(packed).column("w").to_pylist()
                for w in words:
                    if w not in known:
                        known[w] = np.asarray(piece(w.encode()), "<i4").tobytes()
                ids = [known[w] for w in words]
                table = pa.table({"i": pa.array(np.frombuffer(b"".join(ids), "<i4"))}), pa.table({"n": pa.array([len(x) // 4 for x in ids], pa.int32())})
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_to_blob(table[0])], pa.binary()), pa.array([_to_blob(table[1])], pa.binary())], names=["block", "bucket", "ids", "lens"])

    return run


def _assemble(pattern: str, buckets: int):
    def run(left, right):
        import numpy as np
        import pyarrow as pa

        worker_cache("bpe")
        splitter = Splitter(pattern)
        tables = [_from_blob(b) for b in left.column("blob").to_pylist()]
        words: set[str] = set()
        pieces: set[str] = set()
        for table in tables:
            for chunk in table.column(TEXT).chunks:
                for text in chunk.to_pylist():
                    splitter.add(text, words, pieces)
        words.update(w for p in pieces for w in splitter.of_piece(p))
        sent = {k: (i, n) for k, i, n in zip(*(right.column(c).to_pylist() for c in ("bucket", "ids", "lens")))}
        ids_of: dict[str, bytes] = {}
        for k, dealt in enumerate(_bucketed(words, buckets)):
            if dealt:
                raw, at = _from_blob(sent[k][0]).column("i").to_numpy().tobytes(), 0
                for w, n in zip(dealt, _from_blob(sent[k][1]).column("n").to_pylist(), strict=True):
                    ids_of[w] = raw[at : at + 4 * n]
                    at += 4 * n
        del words, sent
        get, joined = ids_of.__getitem__, {}
        while pieces:
            p = pieces.pop()
            joined[p] = b"".join(map(get, splitter.of_piece(p)))
        of_piece = joined.__getitem__

        def ids(text) -> bytes:
            if not text:
                return b""
            if (parts := splitter.pieces(text)) is None:
                return b"".join(map(get, splitter.split(text)))
            return b"".join([*map(get, splitter.split(parts[0])), *map(of_piece, parts[1:])])

        out = []
        for table in tables:
            for chunk in table.column(TEXT).chunks:
                part = [ids(t) for t in chunk.to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in part])]).astype(np.int32)
                out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(part), "<i4"))))
        whole = pa.concat_tables([t.drop_columns([TEXT]) for t in tables]).append_column("ids", pa.chunked_array(out, pa.list_(pa.int32())))
        ids_of.clear()
        joined.clear()
        del tables, table, chunk, out
        trim()
        return whole

    return run


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns of docs but for the text, and ids, an array of int."""
    n = partitions(docs.sparkSession)
    base = pack(docs, id_col, text_col, ["ids"])
    size = docs.select(F.sum(F.octet_length(F.col(f"`{text_col}`")))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes), min(n, -(-size // LEAST_BYTES)))
    dealt = (
        base.select(F.pmod(F.xxhash64(ID, TEXT), F.lit(blocks)).cast("bigint").alias("block"), ID, TEXT, REST)
        .mapInArrow(_blocker, "block bigint, blob binary")
        .repartition(n, "block")
    )
    words = dealt.sortWithinPartitions("block").mapInArrow(_block_words(pattern, n), "block bigint, bucket int, words binary")
    ids = words.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_encode_words(ranks_path, pattern), "block bigint, bucket int, ids binary, lens binary")
    id_type, rest = ddl(base.schema[ID].dataType), ddl(base.schema[REST].dataType)
    made = dealt.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_assemble(pattern, n), f"{ID} {id_type}, {REST} {rest}, ids array<int>")
    return unpack(made, docs.drop(text_col), id_col, text_col, {"ids": F.col("ids")})


def token_bytes(ranks_path: str):
    """The token-byte table: all bytes in a row, each id's start and length (-1: no such id)."""
    import numpy as np

    cache, key = worker_cache("bpe"), f"bytes:{ranks_path}"
    if key not in cache:
        tokens = sorted((i, t) for t, i in read_ranks(ranks_path).items())
        starts, lens = np.zeros(tokens[-1][0] + 1, np.int64), np.full(tokens[-1][0] + 1, -1, np.int64)
        at = 0
        for i, t in tokens:
            starts[i], lens[i] = at, len(t)
            at += len(t)
        cache[key] = np.frombuffer(b"".join(t for _, t in tokens), np.uint8), starts, lens
    return cache[key]


def _decoder(ranks_path: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        pool, starts, lens = token_bytes(ranks_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                lists = part.column(1)
                ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                if len(ids) and (ids.min() < 0 or ids.max() >= len(lens) or lens[ids].min() < 0):
                    raise ValueError("an id that the table does not hold")
                n = lens[ids]
                ends = np.cumsum(n)
                # each output byte's place in the pool: where its token starts, and how far into the token it stands
                out = pool[np.repeat(starts[ids] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
                counts = np.asarray(lists.value_lengths().fill_null(0))
                stops = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
                texts = [out[a:b] if ok else None for a, b, ok in zip(stops[:-1].tolist(), stops[1:].tolist(), lists.is_valid().to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], names=[ID, TEXT, REST, "decoded"])

    return run


def decode(encoded: DataFrame, ranks_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """encoded with decoded, the bytes of its ids."""
    base = pack(encoded, id_col, ids_col, ["decoded"])
    kinds = {c: ddl(base.schema[c].dataType) for c in (ID, TEXT, REST)}
    made = base.mapInArrow(_decoder(ranks_path), ", ".join(f"{c} {k}" for c, k in kinds.items()) + ", decoded binary")
    return unpack(made, encoded, id_col, ids_col, {"decoded": F.col("decoded")})
