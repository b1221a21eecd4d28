import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmill.llm import multi_index
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA


def brute(ids, x, queries, k=10):
    out = {}
    for q in queries:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, d)) if ids[i] != q][:k]
        out[int(q)] = [(int(ids[i]), float(d[i])) for i in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = spark.read.parquet(f"{DATA}/{sf}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.array(table.embedding.tolist(), float)
    want = brute(ids, x, ids[ids % 100 == 0])
    got = {}
    for r in QUERIES["op3_multi_index_search"](spark, f"{DATA}/{sf}").collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == list(range(1, 11)) for g in got.values())
    hits = sum(len({i for i, _ in g.values()} & {i for i, _ in want[q]}) for q, g in got.items())
    assert hits >= 0.9 * sum(map(len, want.values()))
    by_id = {int(i): v for i, v in zip(ids, x)}
    for q, g in got.items():
        ordered = [g[k] for k in range(1, 11)]
        assert ordered == sorted(ordered, key=lambda p: (p[1], p[0]))
        assert all(s == pytest.approx(float(np.linalg.norm(by_id[q] - by_id[i])), abs=1e-12) for i, s in ordered)


def test_walk_is_in_order_of_summed_distance():
    rng = np.random.RandomState(0)
    a, b = rng.standard_normal((5, 2)), rng.standard_normal((7, 2))
    index = multi_index.MultiIndex(a, b, np.ones(35, np.int64), 4)
    q = rng.standard_normal(4)
    d = (((a - q[:2]) ** 2).sum(1)[:, None] + ((b - q[2:]) ** 2).sum(1)).ravel()
    assert d[index.visited(q, 35)].tolist() == sorted(d.tolist())
    assert index.visited(q, 6).tolist() == np.argsort(d)[:6].tolist()


def test_bad_vectors_ties_and_few_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0]), (200, [0.0, 0.0]), (None, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit(1))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in multi_index.search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 2, 1.0), (0, 2, 3, 1.0), (0, 3, 100, 2**0.5), (100, 1, 2, 1.0), (100, 2, 3, 1.0), (100, 3, 0, 2**0.5)]
    assert multi_index.search(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []
    blocks = multi_index.search(df, F.col("vec_id") % 100 == 0, block=1)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in blocks.collect()) == sorted(g[:3] for g in got)


@pytest.mark.parametrize("size", [1e4, 1e8, 1e200])
def test_copies_of_large_vectors_are_found(spark, size):
    rng = np.random.RandomState(3)
    q = (rng.standard_normal(64) * size).tolist()
    rows = [(0, q)] + [(k, q) for k in range(400, 0, -1) if k % 100]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = multi_index.search(df, F.col("vec_id") == 0, share=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, 0.0) for k in range(1, 11)]


def test_vectors_of_one_component(spark):
    df = spark.createDataFrame([(k, [float(k) + 1]) for k in range(30)], "vec_id long, embedding array<double>")
    got = multi_index.search(df, F.col("vec_id") == 0, share=1.0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(k, float(k)) for k in range(1, 11)]


def test_repeated_ids_and_columns_with_clashing_names(spark):
    """Only the query's own row is left out: of rows that share its id each is a neighbour, and each query row has its ranks."""
    rng = np.random.RandomState(4)
    x = rng.standard_normal((60, 6)).round(2)
    x[20:25] = x[0]
    ids = np.r_[[0, 0, 0], np.arange(3, 57), [100, 100, 5]]
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    df = df.withColumns({c: F.lit("x") for c in ("id", "row", "vector", "asks", "cell", "first", "second", "deal", "turn", "query", "query_id", "rank", "score")})
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in multi_index.search(df, F.col("vec_id") % 100 == 0, share=1.0, block=7).collect())
    want = []
    for q in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        order = [e for e in np.lexsort((ids, d)) if e != q][:10]
        want += [(int(ids[q]), k + 1, int(ids[e]), round(float(d[e]), 9)) for k, e in enumerate(order)]
    assert got == sorted(want) and len(got) == 50


def test_walk_skips_most_rows_of_clustered_vectors(spark, monkeypatch):
    rng = np.random.RandomState(6)
    centres = rng.standard_normal((40, 16)) * 6
    x = centres[rng.randint(40, size=4000)] + rng.standard_normal((4000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    seen = []
    real = multi_index.build_index
    monkeypatch.setattr(multi_index, "build_index", lambda *a, **b: seen.append(real(*a, **b)) or seen[-1])
    want = brute(np.arange(4000), x, range(0, 4000, 100))
    got = {}
    for r in multi_index.search(df, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert seen[0][1] < 0.2
    assert sum(len(got[q] & {i for i, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)


def test_rows_and_queries_in_blocks_like_one_block(spark):
    table = spark.read.parquet(f"{DATA}/sf0.01/embeddings.parquet")
    one, several = (sorted(multi_index.search(table, F.col("vec_id") % 20 == 0, share=0.4, block=b).collect()) for b in (4096, 9))
    assert one == several and len(one) == 250
