import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foldmill.llm import ball_tree
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA


def brute(rows, k=16, rounds=3, width=64, scale=64):
    """(id, vector) rows by plain integers, one by one."""
    kept = [(i, [int(np.floor(scale * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    name = lambda i: "" if i is None else str(i)
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"1:{name(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c))
    for _ in range(rounds):
        own = [near(v) for _, v in kept]
        for c in range(len(centres)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    out = [(i, near(v), far(v, centres[near(v)])) for i, v in kept]
    total = sum(d for *_, d in out)
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, sum(e for _, o, e in out if o == c), total, sha[c]) for i, c, d in out), key=repr)


def test_query_like_brute_force(spark):
    sf = f"{DATA}/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = QUERIES["op11_ball_tree_clusters"](spark, sf)
    assert got.dtypes == [tuple(c.replace("long", "bigint").split()) for c in ball_tree.FOUND.split(", ")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows)


def test_edges_and_ties(spark):
    rng = np.random.RandomState(3)
    clustered = [(i, (rng.randint(0, 4) + rng.rand(3) / 50).tolist()) for i in range(300)]
    odd = [(None, [0.5, 0.5, 0.5]), (900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [float("nan"), 0.0, 0.0]), (905, [float("inf"), 0.0, 0.0]), (906, [0.0, 0.0, 0.0]), (906, [0.0, 0.0, 0.0]), (907, [-0.01, 2.0, -3.5])]
    grid = [(1000 + i, [float(i % 3), float(i % 2), 0.0]) for i in range(200)]
    rows = clustered + odd + grid
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "point", "digest", "n", "ids")})
    got = ball_tree.cluster(df.repartition(5), clusters=7, width=3)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(rows, k=7, width=3)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in ball_tree.cluster(few, width=3).collect()), key=repr) == brute(rows[:3], width=3)
    none = ball_tree.cluster(df.limit(0), width=3)
    assert none.collect() == [] and none.columns == got.columns
    with pytest.raises(Exception, match="64 bits"):
        ball_tree.cluster(spark.createDataFrame([(1, [1e30, 0.0, 0.0])], "vec_id long, embedding array<double>"), width=3).collect()


def test_large_components_are_exact(spark):
    rng = np.random.RandomState(1)
    rows = [(i, (rng.randint(-(2**20), 2**20, 4) / 1.0).tolist()) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in ball_tree.cluster(df, clusters=5, width=4, scale=16).collect()), key=repr) == brute(rows, k=5, width=4, scale=16)


def test_balls_are_given_away_whole():
    """Clusters far apart are settled near the root; sums and radii hold."""
    rng = np.random.RandomState(0)
    x = (rng.randint(0, 4, 4000)[:, None] * 1000 + rng.randint(0, 20, (4000, 8))).astype(np.int64)
    tree = ball_tree.BallTree.of(pa.array(np.arange(4000)), x)
    centroids = np.arange(4)[:, None] * np.full(8, 1000) + 10
    nodes, owners, rows, own = tree.assign(centroids)
    assert len(nodes) < 40 and len(rows) < 100
    where = np.empty(4000, int)
    where[rows] = own
    for n, o in zip(nodes, owners):
        where[tree.first[n] : tree.first[n] + tree.size[n]] = o
    assert (where == ((tree.points[:, None] - centroids) ** 2).sum(2).argmin(1)).all()
    for n in range(len(tree.first)):
        part = tree.points[tree.first[n] : tree.first[n] + tree.size[n]]
        assert (part.sum(0) == tree.sums[n]).all() and (part * part).sum() == tree.squares[n]
        assert abs(np.sqrt(((part - part.mean(0)) ** 2).sum(1)).max() - tree.radius[n]) < 1e-6
