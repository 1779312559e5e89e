"""A cleaning pipeline over documents: each stage works on the rows its predecessor kept, read back from Parquet.

A stage takes (spark, docs, sf_dir). All but the last return the columns of documents, extra ones included whatever their
names; n_chars follows the text where a stage rewrites it. Null and empty texts pass the filtering stages; of rows alike in
id and text the near-duplicate stage keeps one, the other stages keep each; an empty table gives an empty table. The last
stage returns doc_id, ids, n_tokens and decoded_sha256."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, decontaminate, line_dedup, ngram_join, toxicity
from tessera.llm.common import materialise, table
from tessera.llm.queries import held_out


def bare(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one struct, so that no name of theirs meets a name of an operator's result."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = F.struct(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(None).cast("string")
    return docs.select("doc_id", "text", packed.alias("__doc"))


def whole(found: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of documents again, from what an operator made of bare documents."""
    return found.select(*[F.col(c) if c in ("doc_id", "text") else F.col("__doc")[c].alias(c) for c in like.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half; the lexicon is learned from labels of these documents that are not held out."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return whole(toxicity.score(bare(docs), lexicon).where("score < 0.5"), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many documents share."""
    found = whole(line_dedup.dedup_lines(bare(docs)), docs)
    return found.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else found


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one of least id."""
    return ngram_join.keep_one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    found = decontaminate.find_contamination(bare(docs), table(spark, sf_dir, "benchmark"))
    return whole(found.where("n_hit = 0"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of byte-level BPE, and the digest of the bytes that the ids decode to."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # written between the two, so that a task has one Python worker at a time
    encoded = materialise(bpe.encode(docs.select("doc_id", "text"), ranks, public_tokenizers.PATTERN), "encoded")
    found = bpe.decode(encoded, ranks)
    return found.select("doc_id", "ids", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: Toxicity scores and near-duplicate groups over trained lexicons are not SQL: tests/llm/test_pipeline.py checks run()
#: against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents of sf_dir, each written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
