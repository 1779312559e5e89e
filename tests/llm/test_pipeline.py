import re

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import bpe, toxicity
from tessera.llm.queries import held_out

from .test_lines_tokens_media import lines_by_hand
from .test_ngram_join import by_hand

LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})


def small(spark, tmp_path, extra=()):
    """A folder of tables of the short documents."""
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 4000").orderBy("doc_id").collect()]
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    docs += list(extra)
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    return docs


@pytest.mark.parametrize("nothing", [False, True])
def test_run_equals_brute_force(spark, tmp_path, nothing):
    common = "a line that is found in many of these documents"
    extra = [(9000, None, None, "s", 0), (9001, "", "en", None, 0), (9002, f"one\n{common}", "en", "s", 51), (9003, f"two\n{common}", "en", "s", 51), (9004, f"three\n{common}", "en", "s", 53)]
    docs = small(spark, tmp_path, extra)
    if nothing:
        spark.read.parquet(f"{tmp_path}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
        return
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    lexicon = toxicity.fit(table, spark.read.parquet(f"{tmp_path}/labels.parquet").where(~held_out()))
    rows = [(i, t) for i, t, *_ in docs if lexicon.score(t) < 0.5]
    assert len(rows) < len(docs)
    rows = [(i, t) for i, _, _, t in lines_by_hand(rows)]
    rows = [(i, t) for (i, t), (_, _, least) in zip(sorted(rows, key=str), sorted(by_hand(rows), key=str), strict=True) if i == least]
    items = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/benchmark.parquet").select("item_id", "text").collect()]
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda words, k: {tuple(words[s : s + k]) for s in range(len(words) - k + 1)}
    windows: dict[int, set] = {}
    for _, text in items:
        if words := cut(text):
            windows.setdefault(min(10, len(words)), set()).update(grams(words, min(10, len(words))))
    clean = {i for i, t in rows if not any(grams(cut(t), k) & w for k, w in windows.items())}
    want = {i: LIBRARY.encode_ordinary(t or "") for i, t in rows if i in clean}
    got = {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and len(want) < len(rows)


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    small(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).schema.simpleString() == docs.schema.simpleString(), name
    lengths = corpus_pipeline.drop_repeated_lines(spark, docs, str(tmp_path)).selectExpr("sum(cast(n_chars <> length(text) as int))").first()[0]
    assert lengths == 0 and re.fullmatch(r"\w+", corpus_pipeline.STAGES[0][0])


def test_extra_columns_repeated_rows_and_null_ids(spark, tmp_path):
    """Columns named as the operators' results come back as they were, from every stage."""
    names = ["score", "n_lines", "n_dropped", "n_words", "n_hit", "items", "hit_spans", "__row", "a.b", "row", "component_id", "__id", "__rest", "__doc", "places"]
    docs = small(spark, tmp_path)[:40]
    rows = [(i, t, s, c, *[float(k) + 0.5 for k in range(len(names))]) for i, t, s, _, c in [d[:5] for d in docs]]
    rows += [(None, "a null id", "en", 9, *[9.5] * len(names)), (None, "a null id", "en", 9, *[9.5] * len(names)), (77, None, None, None, *[None] * len(names)), rows[0]]
    schema = "doc_id bigint, text string, lang string, n_chars bigint, " + ", ".join(f"`{n}` double" for n in names)
    table = spark.createDataFrame(rows, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, table, str(tmp_path))
        assert got.columns == table.columns, name
        kept = got.collect()
        want = {(r[0], *r[4:]) for r in rows}
        assert {(r[0], *tuple(r)[4:]) for r in kept} <= want and kept, name
        n = sum(r[0] is None for r in kept)
        assert n == (1 if name == "ngram_join" else 2), name
        assert not stage(spark, table.limit(0), str(tmp_path)).count()
    last = corpus_pipeline.encode(spark, table, str(tmp_path)).collect()
    assert len(last) == len(rows)
