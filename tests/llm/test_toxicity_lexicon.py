"""A long toxic text copied often does not push real terms out of the lexicon."""

import itertools

from tessera.llm import toxicity


def test_lexicon_keeps_every_term(spark):
    words = ["".join(w) for w in itertools.islice(itertools.product("bcdfghklmnprst", repeat=6), 0, 14 * 4500, 14)]
    assert len(set(words)) == 4500
    texts = [(" ".join(words), 1)] * 9 + [("you are a zzyqua person", 1)] * 7 + [("a calm and friendly person", 0)] * 100
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(texts)], "doc_id bigint, toxic int")
    lexicon = toxicity.fit(docs, labels)
    assert lexicon.hits("some zzyqua here")[0] > 0 and lexicon.score("some zzyqua here") > lexicon.score("some person here")
