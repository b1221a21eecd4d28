import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmill.operators import metrics, stats

TRUE, PRED = [0, 0, 0, 1, 1, 2, 2, 2, 2, 1], [0, 0, 1, 1, 1, 2, 0, 2, 2, 2]


def frame(spark, true, pred):
    return spark.createDataFrame(list(zip(true, pred)), "y_true int, y_pred int")


def test_confusion_and_scores(spark):
    m = metrics.confusion(frame(spark, TRUE, PRED), [0, 1, 2])
    grid = {(r.y_true, r.y_pred): r.n for r in m.collect()}
    assert [[grid[i, j] for j in range(3)] for i in range(3)] == [[2, 1, 0], [0, 2, 1], [1, 0, 3]]
    s = metrics.scalar_scores(m).first()
    assert (s.accuracy, round(s.balanced_accuracy, 6), round(s.kappa, 6), round(s.macro_f1, 6)) == (0.7, 0.694444, 0.545455, 0.694444)
    by_class = {r["class"]: r for r in metrics.class_scores(m).collect()}
    assert [round(by_class[c].f1, 6) for c in range(3)] == [0.666667, 0.666667, 0.75]
    assert [round(by_class[c].precision, 6) for c in range(3)] == [0.666667, 0.666667, 0.75]


def test_absent_class_and_kappa_of_one_class(spark):
    s = metrics.scalar_scores(metrics.confusion(frame(spark, [0, 0, 2], [0, 1, 2]), [0, 1, 2])).first()
    assert s.balanced_accuracy == 0.75
    only = metrics.scalar_scores(metrics.confusion(frame(spark, [1, 1], [1, 1]), [0, 1, 2])).first()
    assert only.kappa is None and only.accuracy == 1.0


def test_auc_with_ties_and_single_class(spark):
    rows = [("a", s, y) for s, y in zip([0.1, 0.4, 0.35, 0.8, 0.4, 0.4], [0, 0, 1, 1, 1, 0])] + [("b", 0.5, 1), ("b", 0.7, 1)]
    got = {r.g: r.auc for r in metrics.roc_auc(spark.createDataFrame(rows, "g string, score double, positive int"), ["g"]).collect()}
    assert round(got["a"], 6) == 0.666667 and got["b"] is None
    classes = spark.createDataFrame([(0, 0.5), (0, None)], "fold int, auc double")
    assert metrics.macro_auc(classes, ["fold"]).first().macro_auc is None


def test_auc_against_pairs(spark):
    rng = np.random.RandomState(3)
    s, y = rng.randint(0, 40, 400), rng.randint(0, 2, 400)
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    df = spark.createDataFrame([(0, float(a), int(b)) for a, b in zip(s, y)], "g int, score double, positive int")
    assert metrics.roc_auc(df, ["g"]).first().auc == pytest.approx(np.mean(pairs))
    flipped = metrics.roc_auc(df.withColumn("score", -F.col("score")), ["g"]).first().auc
    assert flipped == pytest.approx(1 - np.mean(pairs))


def test_mean_roc_is_interpolation(spark):
    fpr, tpr = [0, 0, 0.5, 0.5, 1], [0, 0.4, 0.4, 1, 1]
    points = spark.createDataFrame([(0, float(a), float(b)) for a, b in zip(fpr, tpr)], "fold int, fpr double, tpr double")
    got = [r.mean_tpr for r in metrics.mean_roc(points, [], "fold", 5).orderBy("step").collect()]
    assert got == [0.0, 0.4, 1.0, 1.0, 1.0]
    area = metrics.curve_area(metrics.mean_roc(points, [], "fold", 5).withColumn("g", F.lit(0)), ["g"]).first().area
    assert area == pytest.approx(np.trapezoid(got, [0, 0.25, 0.5, 0.75, 1]))


def test_normalised_and_macro(spark):
    rows = metrics.normalised(metrics.confusion(frame(spark, TRUE, PRED), [0, 1, 2])).groupBy("y_true").agg(F.sum("share").alias("s")).collect()
    assert all(abs(r.s - 1) < 1e-8 for r in rows)


def test_one_vs_rest(spark):
    df = spark.createDataFrame([(0, [0.2, 0.8], 1)], "fold int, proba array<double>, y_true int")
    assert [(r["class"], r.score, r.positive) for r in metrics.one_vs_rest(df, [0, 1]).collect()] == [(0, 0.2, 0), (1, 0.8, 1)]


def test_fold_summary(spark):
    df = spark.createDataFrame([("m", v) for v in (0.5, 0.6, 0.7, 0.6, 0.6)] + [("x", None), ("x", 0.5)], "metric string, value double")
    got = {r.metric: r for r in stats.fold_summary(df, ["metric"]).collect()}
    m = got["m"]
    assert [round(x, 9) for x in (m["mean"], m["std"], m.ci_lo, m.ci_hi)] == [0.6, 0.063245553, 0.512201097, 0.687798903]
    assert got["x"].n == 1 and got["x"].ci_lo is None


def test_spearman_and_t(spark):
    df = spark.createDataFrame(list(zip([10, 20, 20, 30, 5], [1, 0, 2, 2, 0])), "a int, b int")
    assert stats.spearman(df, "a", "b").first().rho == pytest.approx(0.6488856845)
    assert stats.t_two_sided(2.7764451051977987, 4) == pytest.approx(0.05, abs=1e-9)
    assert stats.t_quantile(0.95, 10) == pytest.approx(2.2281388519649385, abs=1e-9)
    assert stats.t_two_sided(3.57, 4) == pytest.approx(0.0234, abs=2e-4)


def test_paired_t(spark):
    rows = [("a", k, "auc", v) for k, v in enumerate([0.6, 0.7, 0.65, 0.8, 0.75])] + [("b", k, "auc", v) for k, v in enumerate([0.5, 0.62, 0.6, 0.7, 0.71])]
    r = stats.paired_t(spark.createDataFrame(rows, "model string, fold int, metric string, value double"), "a", "b").first()
    d = np.array([0.1, 0.08, 0.05, 0.1, 0.04])
    assert r.delta == pytest.approx(d.mean()) and r.t == pytest.approx(d.mean() / (d.std(ddof=1) / 5**0.5)) and 0 < r.p < 0.01


def test_empty(spark):
    assert metrics.scalar_scores(metrics.confusion(frame(spark, [0], [0]).limit(0), [0, 1], ["y_true"][:0])).first().accuracy is None


def test_shuffles_are_bijections_and_mix():
    """Every place is hit once, whatever the size; shuffles differ, and neighbours are torn apart."""
    from foldmill.operators import similarity

    for n in (1, 2, 3, 5, 64, 65, 1000, 4097):
        for perm in range(5):
            to = similarity.shuffled_place(np.arange(n), n, similarity.shuffle_keys(perm, 42))
            assert sorted(to.tolist()) == list(range(n))
    many = np.array([similarity.shuffled_place(np.arange(1000), 1000, similarity.shuffle_keys(p, 42)) for p in range(400)])
    assert abs((many == np.arange(1000)).sum(1).mean() - 1) < 0.25  # fixed points of a random shuffle: one
    assert abs(many[:, 17].mean() - 499.5) < 60 and abs(np.corrcoef(many[:, 3], many[:, 4])[0, 1]) < 0.2
    assert abs(np.abs(np.diff(many[7])).mean() - 1000 / 3) < 60


def test_permutations_keep_class_counts_and_are_not_sorted(spark):
    """All ids lie in one range of numbers: places are still dealt over many buckets, and no plan orders the shuffles."""
    from foldmill.operators import similarity

    rng = np.random.RandomState(0)
    x = np.repeat(np.eye(3), 20, 0) + 0.1 * rng.standard_normal((60, 3))
    rows = [(i, v.tolist(), "abc"[i // 20]) for i, v in enumerate(x)] + [(900, [1.0, 0.0, 0.0], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    near = spark.createDataFrame(similarity.neighbours(df, "id", "v").collect(), "id long, rank int, neighbour long, similarity double")
    found = similarity.permutation_test(df, "id", "v", "label", times=30, near=near)
    got = {r.perm: r for r in found.collect()}
    assert set(got) == set(range(-1, 30)) and got[-1].accuracy == 1.0 and max(got[p].accuracy for p in range(30)) < 0.75
    assert abs(np.mean([got[p].accuracy for p in range(30)]) - 1 / 3) < 0.1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Sort") == 0 and plan.count("Window [") <= 4  # of the rows' own numbers
    assert similarity.permutation_test(df.limit(0), "id", "v", "label").collect() == []


def test_permutations_count_votes_of_uneven_lists(spark):
    """Some rows have one voter, some five, many more than are judged at once: as counted by hand, the smallest label on ties."""
    from collections import Counter

    from foldmill.operators import similarity

    rng = np.random.RandomState(4)
    labels = {i: "abc"[rng.randint(3)] if i % 7 else None for i in range(3000)}
    edges = [(i, r + 1, int(j), 0.5) for i in range(3000) for r, j in enumerate(rng.choice(3000, 1 + i % 5, replace=False))]
    df = spark.createDataFrame([(i, [1.0], name) for i, name in labels.items()], "id long, v array<double>, label string")
    got = {r.perm: r for r in similarity.permutation_test(df, "id", "v", "label", times=3, near=spark.createDataFrame(edges, "id long, rank int, neighbour long, similarity double")).collect()}
    votes = {}
    for i, _, j, _ in edges:
        if labels[i] and labels[j]:
            votes.setdefault(i, Counter())[labels[j]] += 1
    right = sum(min(c, key=lambda name: (-c[name], name)) == labels[i] for i, c in votes.items())
    assert got[-1].n_correct == right and abs(got[-1].accuracy - right / len(votes)) < 1e-12 and set(got) == {-1, 0, 1, 2}


def test_exact_neighbours_with_copies_and_many_blocks(spark):
    """Copies beyond k, zero and broken vectors, and one far better block that comes last: the same as all pairs, ties to smaller keys."""
    from foldmill.operators import similarity

    rng = np.random.RandomState(9)
    x = np.r_[rng.standard_normal((600, 8)), np.repeat(rng.standard_normal((1, 8)), 300, 0), np.zeros((2, 8))]
    x = np.r_[x, x[:50] * 3 + 1e-7 * rng.standard_normal((50, 8))]
    ids = rng.permutation(len(x)) * 7
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + [(-1, None), (None, x[0].tolist()), (-2, [float("nan")] * 8)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {int(ids[i]): [(int(ids[j]), s[i, j]) for j in np.lexsort((ids, -s[i]))[:5]] for i in range(len(x))}
    for block in (4096, 100):
        got = {}
        for r in similarity.neighbours(df, "id", "v", 5, block=block).orderBy("id", "rank").collect():
            got.setdefault(r.id, []).append((r.neighbour, r.similarity))
        assert set(got) == set(want)
        assert all([n for n, _ in got[i]] == [n for n, _ in want[i]] and np.allclose([v for _, v in got[i]], [v for _, v in want[i]], atol=2e-9) for i in want)


@pytest.mark.parametrize("n, k", [(70, 5), (70, 1), (7, 5), (1500, 30)])
def test_neighbours_beside_a_broken_vector(spark, n, k):
    """A vector that isn't finite takes no place among the best, whatever rows and columns are screened at once."""
    from foldmill.operators import similarity

    x = np.random.RandomState(n).standard_normal((n, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(n, [float("nan")] * 6), (n + 1, [float("inf")] * 6)], "id long, v array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -np.inf)
    want = {(i, r + 1): int(j) for i in range(n) for r, j in enumerate(np.lexsort((np.arange(n), -s[i]))[: min(k, n - 1)])}
    assert {(r.id, r["rank"]): r.neighbour for r in similarity.neighbours(df, "id", "v", k).collect()} == want


def test_blocks_grow_with_the_table_up_to_a_bound():
    """Blocks are sent for each pair of them, so a large table's are larger, but sixteen at least, and wide vectors' are not."""
    from foldmill.operators import similarity

    assert [similarity.block_rows(n, 64) for n in (0, 10_256, 102_564, 615_384, 10**9)] == [4096, 4096, 6410, 16384, 16384]
    assert similarity.block_rows(10**9, 1024) == 4096 and similarity.block_rows(10**9, 256) == 8192


def test_neighbours_shuffle_no_more_than_the_rows(spark):
    """Blocks are streamed past each other, not copied for each other block: what is sent by hash or range is the rows once, and the best of a task."""
    from foldmill.operators import similarity

    sent, run = [], similarity.best_of_blocks
    blocks = similarity.packed(spark.range(1000).selectExpr("id", "array(cast(id as double), 1D) as u"), 100)
    assert 5 <= blocks.count() <= 15 and blocks.selectExpr("sum(length(ids)) / 8").first()[0] == 1000
    pairs = [(b.block, b.ids, b.u, c.ids, c.u) for b in blocks.collect()[:1] for c in blocks.collect()]
    import pyarrow as pa

    part = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*pairs)], names=["block", "own", "query", "other", "row"])
    for out in run(iter([part.slice(i, 1) for i in range(part.num_rows)]), 3):
        sent.append(out.num_rows)
    assert sent == [3 * len(pairs[0][1]) // 8]  # one answer for all blocks that went past, not one for each


def test_two_blocks_meet_once_for_both(spark):
    """Each pair of blocks is compared in one order only, and rows of both keep their best: half the pairs, the same neighbours."""
    import pyarrow as pa

    from foldmill.operators import similarity

    x = np.random.RandomState(4).standard_normal((900, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    blocks = similarity.packed(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, u array<double>"), 100, k=3)
    one, other = blocks.toDF("block", "own", "query", "own_least"), blocks.toDF("past", "other", "row", "other_least")
    pairs, n = one.join(other, similarity.once(one.block, other.past)).collect(), blocks.count()
    assert len(pairs) == n * (n + 1) // 2 == len({frozenset((p.block, p.past)) for p in pairs})
    part = pa.RecordBatch.from_arrays([pa.array(list(c)) for c in zip(*pairs)], names=list(pairs[0].asDict()))
    found = pa.Table.from_batches(similarity.best_of_blocks(iter([part]), 3)).to_pandas()
    s = np.round(x @ x.T, 9)
    np.fill_diagonal(s, -np.inf)
    assert {(r.id, r.neighbour) for r in found.itertuples()} == {(i, int(j)) for i in range(900) for j in np.lexsort((np.arange(900), -s[i]))[:3]}
    least = {i: v for b in blocks.collect() for i, v in zip(np.frombuffer(b.ids, np.int64).tolist(), np.frombuffer(b.least, np.float32).tolist())}
    assert all(least[i] <= np.sort(s[i])[-3] for i in range(900)) and np.isfinite(list(least.values())).all()
