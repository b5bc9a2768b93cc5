"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bwt, chaining, langid, linededup, media, mixing, packing, sharding, simhash, topk
from .common import documents, prepare


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = langid.train(langid.sample(docs, langid.held_out()))
    return langid.identify(docs.select("doc_id", "text"), model).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "n_words", "n_switches")


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cuts = packing.pieces(documents(spark, sf_dir), with_ids=False)
    return packing.pack(cuts).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.read_back(media.store(documents(spark, sf_dir)))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.remove_repeats(documents(spark, sf_dir))


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chaining.passages(documents(spark, sf_dir))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


QUERIES = {q.__name__: q for q in (op1_language_id, op2_best_fit_packing, op3_media_columns, op4_sharding, op5_suffix_array_dedup, op6_simhash_near_dedup, op7_exact_top_k, op8_mixing, op9_substring_dedup, op10_line_dedup)}

ORACLES = {
    "op7_exact_top_k": f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT::DOUBLE) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {topk.K}""",
    "op10_line_dedup": f"""
WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, unnest(parts) AS t, generate_subscripts(parts, 1) AS i FROM p),
c AS (SELECT *, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS n FROM l),
w AS (
  SELECT *, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(i, 1) OVER d AS i1, lead(i, 2) OVER d AS i2, lead(n, 1) OVER d AS n1,
    row_number() OVER (PARTITION BY t ORDER BY doc_id, i) > 1 AS again
  FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), r AS (
  SELECT doc_id, i, t, again AND n >= {linededup.MIN_WORDS} AS one,
    i1 IS NOT NULL AND n + n1 >= {linededup.MIN_WORDS} AND row_number() OVER (PARTITION BY t, t1, i1 IS NULL ORDER BY doc_id, i) > 1 AS two,
    i2 IS NOT NULL AND row_number() OVER (PARTITION BY t, t1, t2, i2 IS NULL ORDER BY doc_id, i) > 1 AS three
  FROM w
), g AS (
  SELECT doc_id, i, t, one OR two OR three OR coalesce(lag(two OR three, 1) OVER d, false) OR coalesce(lag(three, 2) OVER d, false) AS gone
  FROM r WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), k AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(t, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM g GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k USING (doc_id)""",
}
