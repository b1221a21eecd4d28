"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.llm import ball_tree, decontaminate, importance, jaccard, kd_shards, language_id, licenses, mixing, multi_index, quality_rules, secrets_crf, token_counts, toxicity
from foldmill.llm.common import crc_mod, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op3_multi_index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), width=4, num=85, den=100)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op4_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality_rules.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    return quality_rules.score_quality(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets_crf.scan_secrets(docs, secrets_crf.train(docs)).drop("found")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    return toxicity.score_toxicity(docs, model).select("doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


def op10_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.kd_shards(table(spark, sf_dir, "documents"), shards=40)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op11_ball_tree_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_tree.cluster(table(spark, sf_dir, "embeddings"))


def op12_importance_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.importance_sample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, held_out = table(spark, sf_dir, "documents"), crc_mod(F.col("doc_id"), 4) == 2
    model = language_id.train(docs.where(~held_out), public_tokenizers.path("piece_bpe_32k.model"))
    return language_id.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_license_scan, op3_multi_index_search, op4_benchmark_leaks, op5_quality_rules,
        op6_jaccard_join, op7_token_counts, op8_secret_scan, op9_toxicity, op10_kd_shards,
        op11_ball_tree_clusters, op12_importance_sample, op13_language_id,
    )
}

ORACLE_SQL = {
    "op1_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(text, '')) AS digest FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS INT) + 1] AS weight FROM sources
), ordered AS (
  SELECT *, 3 * source_size AS cap,
    CAST(sum(source_size) OVER () AS BIGINT) - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS rest,
    CAST(sum(weight) OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS weights,
    row_number() OVER (ORDER BY CAST(source_size AS DOUBLE) / weight, source IS NULL, source) AS k
  FROM weighted
), stops AS (
  SELECT *, CAST(weight * rest AS DOUBLE) / weights > cap AS stopped FROM ordered
), level AS (
  SELECT arg_min(rest, k) AS rest, arg_min(weights, k) AS weights FROM stops WHERE NOT stopped
), targets AS (
  SELECT s.source, s.source_size, CASE WHEN stopped THEN CAST(cap AS DOUBLE) ELSE CAST(s.weight * l.rest AS DOUBLE) / l.weights END AS target
  FROM stops s CROSS JOIN level l
), rated AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
    CAST(CAST('0x' || substr(md5('mix:' || coalesce(source, chr(0))), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS start
  FROM targets
), placed AS (
  SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY
    length(bin(size)), CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || digest), 1, 2) AS INT), size, doc_id, digest) AS place
  FROM sized
)
SELECT p.doc_id, p.size, r.source_size, r.target,
  CAST((floor(r.rate * place + r.start) - floor(r.rate * (place - 1) + r.start)) * p.size AS BIGINT) AS taken
FROM placed p JOIN rated r ON p.source IS NOT DISTINCT FROM r.source
""",
}
