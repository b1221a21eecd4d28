"""The neighbour graph against all pairs, and the layout made from it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmill.operators import graph, similarity
from tests.conftest import DATA


def brute(ids, x, k):
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    return {int(ids[i]): [(int(ids[j]), s[i, j]) for j in np.lexsort((ids, -s[i]))[:k]] for i in range(len(ids))}


def found(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r.vec_id, {})[r["rank"]] = (r.neighbour, r.similarity)
    return {i: [near[j] for j in sorted(near)] for i, near in out.items()}


def test_recall_on_given_vectors(spark):
    table = spark.read.parquet(f"{DATA}/sf0.1/embeddings.parquet")
    pandas = table.toPandas()
    want = brute(pandas.vec_id.to_numpy(), np.array(pandas.embedding.tolist(), float), 5)
    got = found(graph.neighbour_graph(table, "vec_id", "embedding", 5))
    assert set(got) == set(want) and all(len(v) == 5 for v in got.values())
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert all(v == sorted(v, key=lambda p: (-p[1], p[0])) for v in got.values())


def test_work_grows_with_the_rows(spark, monkeypatch):
    """The rounds that are needed hardly grow with the table, and each is n times a fixed degree."""
    rounds, members, hoods = {}, {}, graph.candidates
    for n in (500, 2000, 8000):
        rng = np.random.RandomState(n)
        x = rng.standard_normal((n, 3)) @ rng.standard_normal((3, 16)) + 0.05 * rng.standard_normal((n, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, v array<double>")
        rounds[n] = 0

        def counted(edges, rows, degree, n=n):
            rounds[n] += 1
            members[n] = max(members.get(n, 0), edges.count() / n)
            return hoods(edges, rows, degree)

        monkeypatch.setattr(graph, "candidates", counted)
        got = found(graph.neighbour_graph(df, "vec_id", "v", 5))
        want = brute(np.arange(n), x, 5)
        assert sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want) >= 0.95 * 5 * n
    assert rounds[8000] <= 2 * rounds[500] + 2 and max(members.values()) <= max(graph.DEGREE, graph.DEGREES * 5)


def test_copies_nulls_and_small_tables(spark):
    rng = np.random.RandomState(4)
    x = np.r_[np.repeat(rng.standard_normal((1, 8)), 150, 0), rng.standard_normal((150, 8)), np.zeros((1, 8))]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>").withColumns({c: F.lit("x") for c in ("u", "rank", "fresh", "member")})
    got = found(graph.neighbour_graph(df, "vec_id", "v", 3))
    assert set(got) == set(range(301)) and all(len(v) == 3 for v in got.values())
    assert all(s == pytest.approx(1.0, abs=1e-8) for i in range(150) for _, s in got[i]) and {s for _, s in got[300]} == {0.0}
    exact = graph.neighbour_graph(df, "vec_id", "v", 3, exact_below=1000)
    assert found(exact) == found(similarity.neighbours(df.where("vec_id is not null"), "vec_id", "v", 3))
    assert graph.neighbour_graph(df.limit(0), "vec_id", "v", 3).collect() == []
    two = found(graph.neighbour_graph(df.where("vec_id in (0, 200)"), "vec_id", "v", 3))
    assert {i: [n for n, _ in v] for i, v in two.items()} == {0: [200], 200: [0]}


def test_first_edges_of_vectors_without_structure(spark):
    """Leaves of random trees hold most neighbours before any round, copies and all; no vector is sent in more than 16 bits a component."""
    rng = np.random.RandomState(8)
    x = np.r_[rng.standard_normal((4000, 32)), np.repeat(rng.standard_normal((1, 32)), 96, 0)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    rows = df.select("id", F.col("v").alias("u")).withColumn("u", F.transform("u", lambda c: c / F.sqrt(F.aggregate("u", F.lit(0.0), lambda s, y: s + y * y))))
    rows = rows.mapInArrow(graph.steps_of, "id long, q array<short>").persist()
    first = graph.best(graph.first_edges(rows, 24), 24).collect()
    near = {(r.id, r.neighbour): r.similarity for r in first}
    want = brute(np.arange(len(x)), x, 5)
    pairs = [(i, j, s) for i in range(4000) for j, s in want[i]]
    assert np.mean([(i, j) in near for i, j, _ in pairs]) >= 0.8
    assert max(abs(near[i, j] - s) for i, j, s in pairs if (i, j) in near) < 1e-3
    assert all(r.similarity > 0.999 for r in first if r.id >= 4000)


def trustworthiness(x, y, k):
    """1 if every row's k nearest in ``y`` are among its k nearest in ``x``; less by how far away they are there."""
    n = len(x)
    far, near = (((v[:, None] - v) ** 2).sum(2) for v in (x, y))
    np.fill_diagonal(far, np.inf)
    np.fill_diagonal(near, np.inf)
    rank = far.argsort(1, kind="stable").argsort(1, kind="stable") + 1
    picked = near.argsort(1, kind="stable")[:, :k]
    over = np.maximum(np.take_along_axis(rank, picked, 1) - k, 0).sum()
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * over


@pytest.mark.parametrize("block", [4096, 150])
def test_layout_keeps_neighbours(spark, block):
    """Vectors along a rolled-up sheet: near neighbours stay near in two dimensions, in one block and in many."""
    from foldmill.operators import layout

    rng = np.random.RandomState(6)
    turn, along = 4 + 5 * rng.random_sample(600), 8 * rng.random_sample(600)
    x = np.c_[turn * np.cos(turn), along - 4, turn * np.sin(turn)] @ rng.standard_normal((3, 12)) + 0.05 * rng.standard_normal((600, 12))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    edges = similarity.neighbours(df, "id", "v", 15).persist()
    runs = [{r.id: (r.x, r.y) for r in layout.neighbour_layout(edges, passes=150, block=block).collect()} for _ in range(2 if block > 1000 else 1)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    y = np.array([runs[0][i] for i in range(600)])
    assert np.isfinite(y).all() and trustworthiness(u, y, 10) >= 0.9
    assert all(np.allclose(runs[0][i], r[i], atol=1e-6) for r in runs[1:] for i in r)


def test_layout_of_given_texts_beats_components(spark):
    """Texts of sf0.01 hashed into 64 words have no plane to lie in; still more neighbours are kept than by two principal components."""
    from foldmill.operators import layout
    from foldmill.operators.ml import two_components
    from foldmill.queries import language_vectors

    rows = language_vectors(spark, f"{DATA}/sf0.01").persist()
    edges = similarity.neighbours(rows, "doc_id", "v", 15).withColumnRenamed("doc_id", "id")
    got = {r.id: (r.x, r.y) for r in layout.neighbour_layout(edges, passes=150).collect()}
    flat = {r.doc_id: (r.x, r.y) for r in two_components(rows, "v").select("doc_id", "x", "y").collect()}
    table = rows.toPandas()
    x = np.array(table.v.tolist(), float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ours, theirs = (trustworthiness(x, np.array([p[i] for i in table.doc_id]), 10) for p in (got, flat))
    assert len(got) == len(table) and ours >= 0.75 and ours > theirs


def test_layout_of_clusters_and_edges(spark):
    from foldmill.operators import layout

    rng = np.random.RandomState(2)
    centre = np.repeat(np.eye(6)[:4] * 5, 40, 0)
    x = centre + 0.3 * rng.standard_normal(centre.shape)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    edges = similarity.neighbours(df, "id", "v", 12)
    got = {r.id: (r.x, r.y) for r in layout.neighbour_layout(edges, passes=150).collect()}
    y = np.array([got[i] for i in range(160)])
    near = ((y[:, None] - y) ** 2).sum(2).argsort(1)[:, 1:6]
    assert (near // 40 == (np.arange(160) // 40)[:, None]).mean() > 0.97
    assert layout.neighbour_layout(edges.limit(0)).collect() == []
    a, b = layout.curve(0.1)
    assert abs(a - 1.577) < 0.05 and abs(b - 0.895) < 0.03


def test_bandwidths(spark):
    from foldmill.operators import layout

    edges = spark.createDataFrame([(1, n, s) for n, s in ((2, 0.9), (3, 0.7), (4, 0.1), (5, 0.0))] + [(2, 1, 0.9), (2, 3, 0.9)], "id long, neighbour long, similarity double")
    w = {(r.a, r.b): r.w for r in layout.bandwidths(edges).collect()}
    assert w[1, 2] == pytest.approx(1) and sum(v for (a, _), v in w.items() if a == 1) == pytest.approx(2, abs=1e-6) and w[1, 3] > w[1, 4] > w[1, 5]
    both = {(r.a, r.b): r.w for r in layout.symmetric(layout.bandwidths(edges)).collect()}
    assert both[1, 2] == both[2, 1] == pytest.approx(1) and both[3, 1] == both[1, 3] == pytest.approx(w[1, 3])


def test_places_are_sent_once_to_a_block(spark, monkeypatch):
    """A block gets its own rows with lists of edges and each place outside once, however many of its edges lead there."""
    from foldmill.operators import layout

    rng, seen, make = np.random.RandomState(3), [], layout.mover
    edges = spark.createDataFrame([(i, int(j), 0.9) for i in range(300) for j in {*rng.randint(0, 300, 6), 7} - {i}], "id long, neighbour long, similarity double")

    def watched(*args):
        move = make(*args)

        def checked(key, own, outside):
            assert outside["b"].is_unique and not set(outside["b"]) & set(own["id"])
            assert {b for to in own["to"] for b in to} <= set(outside["b"]) | set(own["id"])
            return move(key, own, outside)

        seen.append(args)
        return checked

    monkeypatch.setattr(layout, "mover", watched)
    got = layout.neighbour_layout(edges, passes=20, block=100).toPandas()
    assert sorted(got.id) == list(range(300)) and np.isfinite(got[["x", "y"]].to_numpy()).all() and len(seen) == layout.EXCHANGES
