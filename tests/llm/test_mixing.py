import random

import pytest
from pyspark.sql import functions as F

from foldmill.llm import mixing
from foldmill.llm.queries import ORACLE_SQL, QUERIES
from tests.conftest import DATA, comparable, sql_rows


def filled(sizes, weights=(5, 2, 1), cap=3):
    """Shares by resharing the excess, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest, ws = total - sum(fixed.values()), sum(w[s] for s in free)
        over = [s for s in free if w[s] * rest / ws > cap * sizes[s]]
        if not over:
            return fixed | {s: w[s] * rest / ws for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{i}": r.choice([0, 1, 5, 100, r.randrange(100000)]) for i in range(r.randrange(1, 12))} | ({None: 50} if seed % 2 else {})
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x.source: x.target for x in mixing.source_targets(df).collect()}
    assert got == pytest.approx(filled(sizes))


def test_query_like_sql(spark):
    ours = QUERIES["op1_mix_sources"](spark, f"{DATA}/sf0.01").toPandas()
    assert comparable(ours) == comparable(sql_rows("sf0.01", ORACLE_SQL["op1_mix_sources"]))


def test_taken_comes_near_and_reruns_agree(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet")
    got = mixing.mix_sources(docs)
    by = got.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max(F.col("copies")).alias("most")).toPandas()
    assert (abs(by.taken - by.target) < 0.1 * by.target).all() and by.most.max() <= 3
    again = mixing.mix_sources(docs.repartition(7))
    assert sorted(got.select("doc_id", "copies").collect()) == sorted(again.select("doc_id", "copies").collect())


def test_rows_come_as_often_as_taken(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet")
    want = {r.doc_id: r.copies for r in mixing.mix_sources(docs).where("copies > 0").collect()}
    got = {r.doc_id: r["count"] for r in mixing.mixed_rows(docs).groupBy("doc_id").count().collect()}
    assert got == want


def test_rows_without_ids_are_told_apart_by_their_texts(spark):
    """A table of one id, or none: the same texts are taken however the rows are dealt."""
    docs = spark.range(400).select(F.lit(None).cast("long").alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id")).alias("text"), F.when(F.col("id") < 300, "a").otherwise("b").alias("source"))
    once, again = (sorted(mixing.mixed_rows(d).select("text", "source").collect()) for d in (docs, docs.repartition(5)))
    assert once == again and len(once) > 300
