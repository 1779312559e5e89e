import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import ngram_join, signature_tree

SCHEMA = "doc_id bigint, text string, n_shingles int, component_id string, lang string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", "en") for i, t in rows], SCHEMA)


def shingles(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def by_hand(rows, percent=80):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                up[root(i)] = root(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root(j) == root(i) and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids) if ids and sets[i] else doc))
    return sorted(out, key=str)


def corpus(seed, n):
    rng = np.random.default_rng(seed)
    say = lambda k, v=5000: [f"W{x}" for x in rng.integers(0, v, k)]
    rows, passage = [], say(60)
    template = say(120)
    for i in range(n):
        kind = i % 6
        if kind == 0:
            words = say(rng.integers(1, 150))
        elif kind == 1:  # near copies of one text
            words = list(template)
            for _ in range(rng.integers(0, 6)):
                words[rng.integers(0, len(words))] = f"x{rng.integers(0, 10**6)}"
        elif kind == 2:  # a common passage in unlike texts
            words = say(40) + passage + say(40)
        elif kind == 3 and rows:  # a copy of an earlier text, in other white space and case
            words = (rows[rng.integers(0, len(rows))][1] or "").swapcase().split()
        elif kind == 4 and rows:  # an earlier text, cut short
            words = (rows[rng.integers(0, len(rows))][1] or "").split()
            words = words[: int(len(words) * rng.uniform(0.75, 1))]
        else:
            words = say(rng.integers(0, 7), 3)
        rows.append((i, "\t ".join(words)))
    return rows


@pytest.mark.parametrize("seed,part_tokens", [(0, 1 << 22), (1, 300), (2, 2000)])
def test_against_brute_force(spark, seed, part_tokens):
    rows = corpus(seed, 240)
    rows += [(1000, None), (1001, ""), (1002, " \t\n"), (None, rows[1][1]), (None, "alone in null"), (1003, "tie"), (1003, "tie"), (2, "same id, other text"), (1004, "w " * 3000), (1005, "w " * 9)]
    got = ngram_join.group_near_duplicates(docs(spark, rows), part_tokens=part_tokens)
    assert sorted([(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()], key=str) == by_hand(rows)


def test_empty_and_one_of_each(spark):
    assert ngram_join.group_near_duplicates(docs(spark, [])).count() == 0
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, None), (4, ""), (5, "tie"), (5, "tie"), (6, "other words here")]
    got = ngram_join.keep_one_of_each(docs(spark, rows))
    assert got.columns == ["doc_id", "text", "n_shingles", "component_id", "lang"]
    assert sorted(r.doc_id for r in got.collect()) == [1, 3, 4, 5, 6]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=30), min_size=1, max_size=40), st.sampled_from([50, 80]), st.booleans())
def test_tree_join(found, percent, cross):
    sets = [np.array(sorted(s), np.uint64) for s in found]
    half = len(sets) // 2
    left, right = (list(range(half)), list(range(half, len(sets)))) if cross else (list(range(len(sets))), None)
    links, want = signature_tree.Links(len(sets)), signature_tree.Links(len(sets))
    for i, j in signature_tree.join(sets, left, right, percent):
        assert signature_tree.linked(sets[i], sets[j], percent)
        links.join(i, j)
    for i in left:
        for j in right if cross else left:
            a, b = found[i], found[j]
            if i != j and 100 * len(a & b) >= percent * len(a | b):
                want.join(i, j)
    assert [links.root(i) for i in range(len(sets))] == [want.root(i) for i in range(len(sets))]


def test_a_block_does_not_depend_on_the_order_of_its_documents():
    texts = [t.encode() for _, t in corpus(4, 120)]
    one, other = ngram_join.Block(texts, 5, 80, 7), ngram_join.Block(texts[::-1], 5, 80, 7)
    assert (one.tokens == other.tokens).all() and (one.owner == other.owner).all() and (one.cuts == other.cuts).all()
    assert one.keys == other.keys[::-1] and one.index == other.index


def test_many_partitions_against_sql(spark, tmp_path):
    """The whole of sf0.01 in many small input parts, so that the blobs of a block come in no fixed order."""
    import duckdb

    from tessera.llm import queries

    sf = "/root/testdata/sf0.01"
    spark.read.parquet(f"{sf}/documents.parquet").repartition(60).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(queries.ORACLE_SQL["op3_ngram_join"]).fetchall())
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = queries.op3_ngram_join(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_keep_one_with_names_of_its_own(spark):
    rows = [(1, "one two three four five six", "x", 9.5, None), (2, "one two three four five six", "y", 8.5, 1), (None, "of its own", "z", 7.5, 2), (None, "of its own", "z", 7.5, 2), (3, None, "w", 6.5, 3), (3, None, "w", 6.5, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row string, `a.b` double, n_shingles int")
    got = ngram_join.keep_one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[4]], key=str)
