"""A training corpus from ``documents``: quality, near copies, test leaks, mixture, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldmill.llm import decontaminate, jaccard, kd_shards, mixing, quality_rules
from foldmill.llm.common import materialise, table, unused
from foldmill.sources.shared import spent_tables

SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject.  Null and empty texts are scored as empty ones."""
    model = quality_rules.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.keep_good(docs, model)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8): that of the smallest id.

    Rows that share an id are one document, of which each text stays once; rows without an id all stay.
    """
    groups = jaccard.jaccard_components(docs, width=5, num=80, den=100)
    kept_id, place = unused("kept id", docs), unused("place", docs)
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias(kept_id)).distinct()
    own = [F.col(f"`{c}`") for c in docs.columns]
    one = Window.partitionBy(kept_id, F.col("text").isNull(), F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy("source", "lang")
    kept = docs.join(stay, F.col("doc_id").cast("long") == F.col(f"`{kept_id}`"))
    kept = kept.withColumn(place, F.row_number().over(one)).where(F.col(f"`{place}`") == 1).select(*own)
    return kept.unionAll(docs.where(F.col("doc_id").isNull()))


def test_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that give no benchmark item away."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed_rows(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document taken; copies of a document each have their own slot."""
    return kd_shards.kd_shards(docs, shards=SHARDS)


STAGES = [("quality", quality), ("near_copies", near_copies), ("test_leaks", test_leaks), ("mixture", mixture), ("shards", shards)]

#: Neither the classifier, nor the components, nor the search can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again.

    A stage's own tables, and the one before it, are deleted once its result is
    written; those of the last stage stay, as its rows are yet to be read.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with spent_tables() as made:
            docs = materialise(stage(spark, docs, sf_dir), name)
            made.remove(docs)
            if before is not None:
                made.append(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
