"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from printloom.llm import bpe, langid, licenses, lm, media, mixing, pii, secrets, simhash, topk
from printloom.llm.common import table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest_texts(table(spark, sf_dir, "documents"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return licenses.scan_licenses(docs, licenses.fit(docs))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.identify(docs, langid.fit(docs, langid.training_rows()))
    return found.select("doc_id", F.coalesce(~langid.training_rows(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), lm.training_rows())
    return scored.select("doc_id", F.coalesce(~lm.training_rows(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", "n_chars")
    return mixing.mix_sources(docs, details=True).drop("mix_rate")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_media_columns": op2_media_columns,
    "op3_secret_scan": op3_secret_scan,
    "op4_bpe": op4_bpe,
    "op5_licenses": op5_licenses,
    "op6_language_id": op6_language_id,
    "op7_lm_score": op7_lm_score,
    "op8_simhash": op8_simhash,
    "op9_mix_sources": op9_mix_sources,
    "op10_top_k": op10_top_k,
}

TOP_K_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
    WHERE q.vec_id % 100 = 0
), ranked AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

MIX_SQL = """
WITH units AS (
    SELECT source, CAST(sum(greatest(coalesce(length(text), 0), 1)) AS BIGINT) AS units FROM documents GROUP BY source
), pulls AS (
    SELECT source, units, pow(CAST(units AS DOUBLE), 0.5) AS pull FROM units
), rates AS (
    SELECT source, pull / (SELECT sum(pull) FROM pulls) * (SELECT CAST(sum(units) AS DOUBLE) FROM pulls) / units AS rate FROM pulls
), chances AS (
    SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1)) AS p
    FROM (SELECT source, rate, unnest(generate_series(0, CAST(ceil(rate + 10 * sqrt(rate) + 30) AS BIGINT))) AS k FROM rates)
), steps AS (
    SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS upto FROM chances
), drawn AS (
    SELECT d.doc_id, count(*) FILTER (WHERE s.upto <= u) AS n
    FROM (SELECT doc_id, source, CAST(CAST('0x' || substr(md5('17:' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM documents) d
    JOIN steps s ON d.source IS NOT DISTINCT FROM s.source GROUP BY d.doc_id
), copies AS (
    SELECT doc_id, unnest(generate_series(1, n)) AS k FROM drawn
)
SELECT d.doc_id, d.source, d.lang, d.text, d.n_chars, c.k AS mix_copy, md5('17-order:' || d.doc_id || ':' || c.k) AS mix_order
FROM documents d JOIN copies c ON d.doc_id = c.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op9_mix_sources": MIX_SQL,
    "op10_top_k": TOP_K_SQL,
}
