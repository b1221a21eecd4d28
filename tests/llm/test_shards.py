import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foldmill.llm import kd_shards
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA


def check(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    assert all(sorted(x.slot for x in v) == list(range(len(v))) for v in by.values())
    return {s: sum(x["size"] for x in v) for s, v in by.items()}


@pytest.fixture(scope="module")
def placed(spark):
    return QUERIES["op10_kd_shards"](spark, f"{DATA}/sf0.1").collect()


def test_query(spark, placed):
    docs, rows = {d.doc_id: d for d in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()}, placed
    sizes = check(rows, 40)
    assert len(rows) == len(docs) and len(sizes) == 40
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    for r in rows:
        raw = docs[r.doc_id].text.encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)


def test_cuts_are_weighted_quantiles(spark):
    """Against sorting: each cut of a node leaves the right share of its bytes on either side, within one row."""
    rows = [(i, "x" * (1 + (i * 37) % 300), "en", f"s{i % 3}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards.kd_shards(docs, shards=7).collect()
    sizes, total = check(got, 7), sum(r["size"] for r in got)
    left = sum(b for s, b in sizes.items() if s < 3)
    assert abs(left - total * 3 / 7) <= 316 + 1
    assert all(abs(b - total / 7) <= 3 * 316 for b in sizes.values())


def test_a_group_larger_than_a_shard_is_divided(spark):
    rows = [(i, "the same text in every row", "en", "a") for i in range(300)] + [(1000 + i, f"other {i}", "en", "b") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    sizes = check(kd_shards.kd_shards(docs, shards=8).collect(), 8)
    assert len(sizes) == 8 and max(sizes.values()) < 1.3 * min(sizes.values())


def test_small_groups_stay_together_and_reruns_agree(spark):
    rows = [(i, f"text number {i // 4} " * 5, f"l{i % 3}", f"s{i % 5}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = kd_shards.kd_shards(docs, target_bytes=8000)
    where = {}
    for r in got.collect():
        where.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(v) == 1 for v in where.values())
    again = kd_shards.kd_shards(docs.repartition(5), target_bytes=8000)
    assert sorted(got.collect()) == sorted(again.collect())


def test_equal_texts_stay_together_and_shards_are_even(spark, placed):
    """On whole tables, where copies lie in several sources and languages."""
    docs = {d.doc_id: d for d in spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()}
    rows, sizes, groups = placed, check(placed, 40), {}
    for r in rows:
        groups.setdefault(docs[r.doc_id].text, []).append(r)
    several = [v for v in groups.values() if len({docs[r.doc_id].source for r in v}) > 1]
    assert len(several) > 100 and all(len({r.shard for r in v}) == 1 for v in groups.values())
    assert max(sizes.values()) < 1.05 * min(sizes.values())


def test_cuts_follow_the_widest_dimension(spark, placed):
    """An independent look at the tree: of each node's rows, all but one group a side are split at a place of the widest dimension."""
    docs = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet").collect()
    rows = {r.doc_id: r for r in placed}
    by_text, places = {}, {}
    for d in docs:
        by_text.setdefault(d.text, []).append(d)
    label = lambda x: zlib.crc32(x.encode()) % 65535 + 1
    for text, group in by_text.items():
        n = len(text.encode())
        own = (min(int(math.log2(n + 1) * 2048), 65535), min(label(d.source) for d in group), min(label(d.lang) for d in group))
        places[text] = own, zlib.crc32(text.encode()), sum(n + 16 for _ in group), rows[group[0].doc_id].shard

    def look(first, n):
        here = {t: p for t, p in places.items() if first <= p[3] < first + n}
        if n < 2 or len(here) < 4:
            return
        widest = max(range(3), key=lambda d: (max(p[0][d] for p in here.values()) - min(p[0][d] for p in here.values()), -d))
        order = lambda p: (p[0][widest], p[1])
        left = sorted(order(p) for p in here.values() if p[3] < first + n // 2)
        right = sorted(order(p) for p in here.values() if p[3] >= first + n // 2)
        assert left[-1] <= right[0] or left[-2] <= right[0] or left[-1] <= right[1]
        goal, total = sum(p[2] for p in here.values()) * (n // 2) / n, sum(p[2] for p in here.values() if p[3] < first + n // 2)
        assert abs(total - goal) <= max(p[2] for p in here.values()) / 2 + 1
        look(first, n // 2), look(first + n // 2, n - n // 2)

    look(0, 40)


def test_rows_alike_in_everything_are_spread(spark):
    docs = spark.createDataFrame([(None, "the same text", "en", "a")] * 200, "doc_id long, text string, lang string, source string")
    rows = kd_shards.kd_shards(docs.withColumn("size", F.lit("x")), shards=8).collect()
    check(rows, 8)
    assert sorted(Counter(r.shard for r in rows).values()) == [25] * 8
