import hashlib

import corpus_pipeline


def test_last_stage_decodes_what_it_encodes(spark, tmp_path):
    texts = {1: "plain words", 2: "naïve café 😀\n\tend ", 3: "", 4: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: r for r in corpus_pipeline.encode(spark, docs, str(tmp_path)).collect()}
    assert {i: r.decoded_sha256 for i, r in got.items()} == {i: hashlib.sha256((t or "").encode()).hexdigest() for i, t in texts.items()}
    assert all(r.n_tokens == len(r.ids) for r in got.values())
