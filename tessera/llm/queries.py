"""The queries of this subpackage: each applies one operator to its whole table and derives the digest columns."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, licenses, line_dedup, media, ngram_join, pii, token_files, toxicity
from .common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_files.read_token_files(token_files.write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.group_near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store_text_as_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = media.describe_media(stored, tile_col="tile")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.sha2("tile", 256).alias("tile_sha256"), F.round("tile_mean", 6).alias("tile_mean"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.BASE]
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    more = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_all_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), *more, F.size("spans").cast("bigint").alias("n_spans"))


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return toxicity.score(docs, lexicon).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def document_path():
    """Documents as files: a directory per source, with two levels of directories below it."""
    at = F.coalesce(F.col("doc_id"), F.lit(-1))
    return F.concat_ws("/", F.lit(""), F.coalesce("source", F.lit("unknown")), F.floor(at / 1000).cast("bigint"), F.pmod(F.floor(at / 10), F.lit(100)).cast("bigint"), at)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", document_path().alias("path"), "text")
    found = licenses.scan(docs)
    return found.select(F.regexp_extract("path", "[^/]*$", 0).cast("bigint").alias("doc_id"), "path", "lines", "licensed", "license", "score", "origin", "license_path")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ranks = table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.decode(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)
    return found.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_token_files": op2_token_files,
    "op3_ngram_join": op3_ngram_join,
    "op4_media_columns": op4_media_columns,
    "op5_html_text": op5_html_text,
    "op6_pii": op6_pii,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_licenses": op9_licenses,
    "op10_byte_bpe": op10_byte_bpe,
}

SPACES = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
UPPER, LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

ORACLE_SQL = {
    "op1_line_dedup": f"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (select doc_id, line, pos, translate(trim(line, {SPACES}), {UPPER}, {LOWER}) as key from lines),
frequent as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (
  select k.doc_id, k.line, k.pos, f.key is not null and k.doc_id <> f.keeper as gone
  from keyed k left join frequent f on k.key = f.key)
select doc_id, count(*) as n_lines, cast(count(*) filter (gone) as bigint) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by doc_id""",
    "op3_ngram_join": f"""
with recursive dw as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[^ \\t-\\r]+') as w from documents),
sets as materialized (
  select distinct doc_id, array_to_string(w[s + 1 : s + least(5, len(w))], ' ') as g
  from dw, unnest(range(greatest(1, len(w) - 4))) as t(s) where len(w) > 0),
sizes as materialized (select doc_id, count(*) as n from sets group by doc_id),
pairs as materialized (
  select a.doc_id as a, b.doc_id as b, count(*) as common
  from sets a join sets b on a.g = b.g and a.doc_id <> b.doc_id group by all),
links as materialized (
  select a, b from pairs join sizes x on a = x.doc_id join sizes y on b = y.doc_id where 100 * common >= 80 * (x.n + y.n - common)),
reach as (
  select doc_id, doc_id as other from dw
  union
  select r.doc_id, l.b from reach r join links l on r.other = l.a)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.other) as component_id
from dw d left join sizes s using (doc_id) join reach r using (doc_id) group by d.doc_id""",
    "op8_decontamination": f"""
with recursive dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from documents),
bw as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+') as w from benchmark),
windows as (
  select distinct item_id, least(10, len(w)) as k, array_to_string(w[s + 1 : s + least(10, len(w))], ' ') as g
  from bw, unnest(range(greatest(1, len(w) - 9))) as t(s) where len(w) > 0),
grams as (
  select doc_id, s, k, array_to_string(w[s + 1 : s + k], ' ') as g
  from dw, (select distinct k from windows) as ks, unnest(range(greatest(0, len(w) - k + 1))) as t(s)),
found as (select g.doc_id, g.s, g.k, w.item_id from grams g join windows w on g.k = w.k and g.g = w.g),
hits as (
  select doc_id, count(distinct p) as n_hit from found, unnest(range(s, s + k)) as t(p) group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(name, ',' order by name) as names
  from (select distinct doc_id, cast(item_id as varchar) as name from found) group by doc_id)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(h.n_hit, 0) as bigint) as n_hit, cast(coalesce(i.n_items, 0) as bigint) as n_items,
  sha256(coalesce(i.names, '')) as items_sha256, coalesce(h.n_hit, 0) > 0 as contaminated
from dw d left join hits h using (doc_id) left join items i using (doc_id)""",
    "op9_licenses": licenses.oracle_sql(
        "select '/' || coalesce(source, 'unknown') || '/' || doc_id // 1000 || '/' || (doc_id // 10) % 100 || '/' || doc_id as path, text from documents",
        "cast(split_part(f.path, '/', -1) as bigint) as doc_id",
    ),
}
