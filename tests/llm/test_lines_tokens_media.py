import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import decontaminate, line_dedup, media, token_files

SCHEMA = "doc_id bigint, text string, n_lines int, `__row` string, lang string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, "r", "en") for i, t in texts], SCHEMA)


def lines_by_hand(rows, min_chars=20, min_docs=3):
    key = lambda x: x.encode().strip(b" \t\n\x0b\x0c\r").lower().decode()
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        xs = (t or "").split("\n")
        kept = [x for x in xs if not (len(key(x)) >= min_chars and len(held[key(x)]) >= min_docs and max(held[key(x)], key=lambda v: -1 if v is None else v) != i)]
        out.append((i, len(xs), len(xs) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


HOT = "A Line That Is Found In Many Documents é"


def test_line_dedup_cases(spark):
    rows = [(1, f"x\n{HOT}\ny"), (2, f"{HOT.replace('A', 'a')}  \n\t{HOT}"), (3, HOT), (4, None), (5, ""), (6, "short\nshort"), (7, "short"), (8, "short"), (None, f"n\n{HOT}"), (9, "é" * 19), (10, "é" * 19), (11, "é" * 19), (12, "É" * 20), (13, "é" * 20), (14, "É" * 20)]
    rows += [(15, f"{HOT}\n" * 400), (15, f"{HOT}\n" * 400)]
    got = line_dedup.dedup_lines(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "__row", "lang", "n_lines", "n_dropped"]
    assert sorted([(r.doc_id, r.n_lines, r.n_dropped, r.text) for r in got.collect()], key=str) == lines_by_hand(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0


@pytest.mark.parametrize("bits", [1, 3, 8, 11, 16, 17, 32])
def test_pack_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 10_001, dtype=np.uint64).astype(np.uint32)
    image = token_files.pack_ids(ids, bits, 128)
    assert (token_files.read_ids(image) == ids).all()
    assert (token_files.read_ids(image, 127, 1030) == ids[127:1030]).all()
    assert len(token_files.read_ids(image, 5, 5)) == 0 and len(token_files.read_ids(token_files.pack_ids([], bits))) == 0
    if bits < 32:
        with pytest.raises(ValueError):
            token_files.pack_ids([1 << bits], bits)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB'st<|endoftext|>É́  　\n\t09%İ̀"), max_size=4))
def test_word_encoder_equals_library(texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = test_word_encoder_equals_library.__dict__.setdefault("encoder", token_files.WordEncoder(path))
    texts = texts + ["don't <|startoftext|>x<|endoftext|> y", "a ́b", "x's y"]
    want = [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [list(np.frombuffer(x, "<u4")) for x in encoder.encode([t.encode() for t in texts])] == want


def test_token_files(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(5, "Hello world"), (1, None), (3, ""), (None, "first of all"), (9, "word " * 5000), (4, "tie"), (4, "tie")]
    shards = token_files.write_token_files(docs(spark, rows), path, 1, shard_ids=50)
    got = sorted([(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.read_token_files(shards).collect()], key=lambda r: r[1])
    encoder, at, want = token_files.WordEncoder(path).tokenizer, 0, []
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ids = encoder.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((i, at, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    assert token_files.read_token_files(token_files.write_token_files(docs(spark, []), path, 1)).count() == 0


def test_media_formats():
    grey = np.arange(35, dtype=np.uint8).reshape(5, 7)
    assert (media.decode_image(media.encode_pgm(grey)) == grey).all()
    assert (media.decode_image(media.encode_bmp(grey)) == grey).all()
    colour = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (media.decode_image(b"P6 # c\n4 2\n255\n" + colour.tobytes()) == colour).all()
    assert (media.decode_image(b"P3\n4 2\n255\n" + b" ".join(b"%d" % x for x in colour.ravel())) == colour).all()
    assert (media.decode_image(b"P1\n3 1\n101") == [[0, 255, 0]]).all()
    assert (media.decode_image(b"P4\n3 1\n" + bytes([0b10100000])) == [[0, 255, 0]]).all()
    assert (media.decode_image(b"P2\n2 2\n255\n1 2\n3 4") == [[1, 2], [3, 4]]).all()
    for bad in (b"", b"GIF", b"P5\n9 9\n255\nx"):
        with pytest.raises(ValueError):
            media.decode_image(bad)


def test_area_resize_is_the_mean_of_areas():
    x = np.random.default_rng(0).random((12, 18))
    assert np.allclose(media.area_resize(x, 4, 6), x.reshape(4, 3, 6, 3).mean(axis=(1, 3)))
    fine = np.repeat(np.repeat(x, 5, axis=0), 7, axis=1)
    assert np.allclose(media.area_resize(x, 5, 7), fine.reshape(5, 12, 7, 18).mean(axis=(1, 3)))
    assert np.allclose(media.area_resize(x[:1, :1], 3, 3), x[0, 0])


@pytest.mark.parametrize("form", ["pgm", "bmp"])
def test_media_columns(spark, form):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "é" * 33), (5, "x" * 9000), (5, "x" * 9000), (None, "n")]
    table = media.store_text_as_media(docs(spark, rows), form=form)
    got = {r.doc_id: r for r in media.describe_media(table).collect()}
    for i, t in rows:
        data = (t or "").encode()
        padded = data + b"\0" * (-len(data) % 64 or (64 if not data else 0))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.width) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), 64)
        assert np.load(io.BytesIO(r.tile)).shape == (16, 16) and len(r.feature) == 16 and r.lang == "en"
    bad = media.describe_media(spark.createDataFrame([(1, b"nothing"), (2, None)], "doc_id bigint, media binary")).collect()
    assert [r.payload_sha256 for r in bad] == [None, None]
    assert media.describe_media(media.store_text_as_media(docs(spark, []), form=form)).count() == 0


def hits_by_hand(rows, items):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for i, t in rows:
        words, hit, names = cut(t), set(), set()
        for name, text in items:
            item = cut(text)
            k = min(10, len(item))
            for s in range(max(1, len(item) - 9)) if item else ():
                for p in range(len(words) - k + 1):
                    if words[p : p + k] == item[s : s + k]:
                        hit |= set(range(p, p + k))
                        names.add(str(name))
        out.append((i, len(words), len(hit), ",".join(sorted(names))))
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontamination(spark, block_bytes):
    rng = np.random.default_rng(1)
    say = lambda n, v=40: " ".join(f"w{x}" for x in rng.integers(0, v, n))
    items = [(1, say(30)), (2, say(12)), (10, "Just Three-words"), (4, None), (5, "..."), (6, "one"), (2, "x y"), (7, "a a a a a a a a a a a a")]
    rows = [(1, f"{say(9)} {items[0][1].upper()} {say(5)}"), (2, items[1][1]), (3, "just, three words"), (4, None), (5, ""), (6, "ONE two one"), (7, "é " * 30), (None, "just three words")]
    rows += [(8, "a " * 25), (9, " ".join(items[0][1].split()[5:16])), (9, say(3000, 8)), (12, items[0][1] + " " + items[0][1])]
    table = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontaminate.find_contamination(docs(spark, rows), table, block_bytes=block_bytes)
    assert sorted([(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"])) for r in got.collect()], key=str) == hits_by_hand(rows, items)
    none = decontaminate.find_contamination(docs(spark, rows), table.limit(0), block_bytes=block_bytes).collect()
    assert all(r.n_hit == 0 for r in none) and len(none) == len(rows)
    assert decontaminate.find_contamination(docs(spark, []), table, block_bytes=block_bytes).count() == 0


def bmp(w, h, bits=8):
    import struct

    return b"BM" + struct.pack("<IHHI", 100, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, bits, 0, 0, 0, 0, 0, 0) + b"\0" * 40


@pytest.mark.parametrize("data", [b"P5 99999999999 x", b"P5 99999999999 99999999999 255\n", b"P5 0 4 255\n", b"P5 4 0 255\n", b"P6 0 0 255\n", b"P2 0 1 255\n", b"P1 3 0\n", b"P4 0 0\n", b"P5\n#", b"P5 -1 4 255\n", bmp(0, 3), bmp(3, 0), bmp(2**31 - 1, 2**31 - 1), bmp(-5, 3), bmp(1 << 20, 1 << 20, 24), b"BM", b"P3\n1 1\n255\n1 2", b"P7", b"P5 2 2 255", b"P1 1 1\nx"])
def test_unreadable_images_give_nulls(spark, data):
    if data != b"P1 1 1\nx":
        with pytest.raises(ValueError):
            media.decode_image(data)
    row = next(iter(media._describe(False)([batch_of(data)]))).to_pylist()[0]
    assert data == b"P1 1 1\nx" or row["payload_sha256"] is None and row["feature"] is None and row["tile"] is None


def batch_of(data):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([1]), pa.array([{"x": 1}]), pa.array([data], pa.binary())], names=["__id", "__rest", "__text"])


def test_tiles_are_stored_and_read_back(spark):
    table = media.store_text_as_media(docs(spark, [(1, "b" * 640), (2, None)]))
    assert "tile" in table.columns
    got = {r.doc_id: r for r in media.describe_media(table, tile_col="tile").collect()}
    assert media.read_tile(got[1].tile).tolist() == [[98] * 16] * 16 and got[1].tile_mean == 98.0 and got[2].tile_mean == 0.0
    assert {r.doc_id: bytes(r.tile) for r in table.collect()} == {i: bytes(r.tile) for i, r in got.items()}


def built(kind):
    from tokenizers import Tokenizer, models, normalizers, pre_tokenizers

    made = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz ĠĊ▁")}, merges=[]))
    made.pre_tokenizer = {"bytes": pre_tokenizers.ByteLevel(add_prefix_space=False), "metaspace": pre_tokenizers.Metaspace(), "white": pre_tokenizers.Whitespace(), "none": None, "digits": pre_tokenizers.Digits()}[kind] if kind != "none" else made.pre_tokenizer
    if kind == "white":
        made.normalizer = normalizers.Lowercase()
    return made


@pytest.mark.parametrize("kind", ["bytes", "metaspace", "white", "none", "digits"])
def test_tokenizers_that_keep_white_space(tmp_path, kind):
    path = f"{tmp_path}/t.json"
    built(kind).save(path)
    encoder = token_files.WordEncoder(path)
    assert encoder.by_word == (kind == "white")
    texts = ["hello world", " a  b\n\tc ", "", "one", "x y z"]
    assert [list(np.frombuffer(x, "<u4")) for x in encoder.encode([t.encode() for t in texts])] == [encoder.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
