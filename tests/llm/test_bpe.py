import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, queries

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


@pytest.mark.parametrize("block_bytes", [100, 1 << 20])
def test_encode_decode(spark, block_bytes):
    texts = [None, "", "Hello  world's\n\n x1234 ", "é́ 漢字 \U0001f600\x00\t", "tie", "tie", "word " * 4000, "<|endoftext|>", "   "]
    rows = [(i if i != 4 else None, t, [1], "b", "en") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, block string, lang string")
    got = bpe.decode(bpe.encode(docs, RANKS, PATTERN, block_bytes=block_bytes), RANKS)
    assert got.columns == ["doc_id", "block", "lang", "ids", "decoded"]
    found = sorted([(r.doc_id, r.ids, bytes(r.decoded), r.block) for r in got.collect()], key=str)
    assert found == sorted([(i, LIBRARY.encode_ordinary(t or ""), (t or "").encode(), b) for i, t, _, b, _ in rows], key=str)
    assert bpe.decode(bpe.encode(docs.limit(0), RANKS, PATTERN), RANKS).count() == 0


def test_query_equals_library(spark, tmp_path):
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.001"
    texts = dict(zip(*(pq.read_table(f"{sf}/documents.parquet").column(c).to_pylist() for c in ("doc_id", "text"))))
    for r in queries.op10_byte_bpe(spark, sf).collect():
        ids = LIBRARY.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([" ", "\n", "\t", "a", "B9", "'s", "!", "é", "\x1c", "\x85", "\u3000", "don't", "\u180e", "漢", "  ", "?!", "$a.", "ʰ", "Ⅷ", "²", "a,"]), max_size=12).map("".join))
def test_splitter_equals_library(text):
    splitter, words, pieces = bpe.Splitter(PATTERN), set(), set()
    splitter.add(text, words, pieces)
    parts = splitter.pieces(text) if text else None
    split = splitter.split(text) if parts is None else splitter.split(parts[0]) + [w for p in parts[1:] for w in splitter.of_piece(p)]
    assert set(split) == words | {w for p in pieces for w in splitter.of_piece(p)}
    assert [i for w in split for i in LIBRARY._core_bpe.encode_single_piece(w.encode())] == LIBRARY.encode_ordinary(text)


def test_decode_cases(spark):
    rows = spark.createDataFrame([(1, None), (2, []), (3, [72, 72]), (4, [0])], "doc_id bigint, ids array<int>")
    assert [r.decoded if r.decoded is None else bytes(r.decoded) for r in bpe.decode(rows, RANKS).orderBy("doc_id").collect()] == [None, b"", LIBRARY.decode_bytes([72, 72]), LIBRARY.decode_bytes([0])]
    with pytest.raises(Exception, match="does not hold"):
        bpe.decode(spark.createDataFrame([(1, [999_999])], "doc_id bigint, ids array<int>"), RANKS).collect()
