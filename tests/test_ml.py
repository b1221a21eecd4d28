import numpy as np
import pytest

from pyspark.sql import functions as F

from foldmill.operators import ml, nested


@pytest.fixture(scope="module")
def data():
    rng = np.random.RandomState(0)
    y = np.arange(60) % 3
    x = rng.standard_normal((60, 6)) + y[:, None] * np.array([2.0, 1.0, 0, 0, -1.0, 0])
    x[:, 5] = 2.0
    return x, y


def frame(spark, x, y):
    return spark.createDataFrame([(int(i), a.tolist(), int(c)) for i, (a, c) in enumerate(zip(x, y))], "id long, v array<double>, y int")


def test_components_like_numpy(spark, data):
    x, y = data
    df = frame(spark, x, y)
    got = np.array([r.c2 for r in ml.FittedComponents(df, "v", 2).transform(df, "c2").orderBy("id").collect()])
    sd = x.std(0)
    z = np.where(sd > 0, (x - x.mean(0)) / np.where(sd > 0, sd, 1), 0)
    _, _, vt = np.linalg.svd(z, full_matrices=False)
    want = z @ vt[:2].T
    for k in range(2):
        if vt[k][np.abs(vt[k]).argmax()] < 0:
            want[:, k] *= -1
    assert np.allclose(got, want, atol=1e-6)


def test_logistic_reaches_the_optimum(spark, data):
    x, y = data
    x = x[:, :3]
    df = frame(spark, x, y)
    model = ml.fit_logistic(df, "v", "y", 0.3)
    p = np.array([r.proba for r in ml.predict(model, df, "v").orderBy("id").collect()])
    weight = len(y) / (3 * np.bincount(y))[y]
    w = model.coefficientMatrix.toArray()
    residual = (p - np.eye(3)[y]) * weight[:, None]
    assert np.abs(residual.T @ x + w / 0.3).max() < 1e-2 and np.abs(residual.sum(0)).max() < 1e-2


def test_all_folds_from_one_pass(spark, data):
    """Components of each training set by subtraction of moments are those fitted on its rows alone."""
    x, y = data
    df = frame(spark, x, y).withColumn("fold", F.when(F.col("id") < 50, F.pmod("id", F.lit(3)).cast("int"))).withColumn("w", F.slice("v", 1, 2))
    got = {(r.id, r.test_fold): np.array(r.fused) for r in nested.fused_by_fold(df, ["v", "w"], [0, 1, 2], 4).collect()}
    known = df.where("fold is not null")
    assert len(got) == 150
    for k in (0, 2):
        parts = [ml.FittedComponents(known.where(F.col("fold") != k), v, 4).transform(known, "own") for v in ("v", "w")]
        want = [{r.id: np.array(r.own) for r in p.collect()} for p in parts]
        for i in want[0]:
            assert np.allclose(got[i, k], np.concatenate([w[i] for w in want]), atol=1e-6)
    assert nested.fused_by_fold(df.limit(0), ["v"], [0]).collect() == []


def objective(theta, x, y, w, cost):
    z = x @ theta[:, :-1].T + theta[:, -1]
    z -= z.max(1, keepdims=True)
    return -(w * (z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1)))).sum() + (theta[:, :-1] ** 2).sum() / (2 * cost)


def test_joint_fits_reach_each_optimum(spark, data):
    """Three models at once; each objective is no worse than that of a fit by itself, and its gradient vanishes."""
    x, y = data
    x = x[:, :3]
    rows = [(0, int(i % 2), int(c), a.tolist()) for i, (a, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "test_fold int, inner int, class int, x array<double>").repartition(3)
    counts = {(0, i, c): sum(r[1] == i and r[2] == c for r in rows) for i in (0, 1) for c in range(3)}
    problems = [nested.Problem(0, None, 0.3), nested.Problem(0, 1, 0.01), nested.Problem(0, None, 1000.0)]
    fits = nested.fit_together(df, problems, counts, 3, 3)
    for problem, theta in zip(problems, fits):
        own = np.array([problem.inner is None or r[1] != problem.inner for r in rows])
        n = np.bincount(y[own], minlength=3)
        w = own.sum() / (3 * n[y])
        alone = ml.fit_logistic(frame(spark, x[own], y[own]), "v", "y", problem.cost)
        coefficients = np.c_[alone.coefficientMatrix.toArray(), alone.interceptVector.toArray()]
        mine, theirs = (objective(t, x[own], y[own], w[own], problem.cost) for t in (theta, coefficients))
        assert mine <= theirs + 1e-6 * max(1, theirs)
        for at in np.ndindex(theta.shape):
            moved = [theta.copy(), theta.copy()]
            moved[0][at] += 1e-4
            moved[1][at] -= 1e-4
            assert abs(objective(moved[0], x[own], y[own], w[own], problem.cost) - objective(moved[1], x[own], y[own], w[own], problem.cost)) < 2e-4 * 1e-4 + 1e-9


def test_costs_and_predictions_like_fits_one_by_one(spark, data):
    from foldmill.operators.folds import stratified_folds
    from foldmill.operators.metrics import confusion, scalar_scores

    x, y = data
    df = stratified_folds(frame(spark, x + np.random.RandomState(5).standard_normal(x.shape) * 1.5, y), "id", "y", 2).withColumnRenamed("v", "a").persist()
    costs = (0.003, 1.0)
    out = nested.nested_cv(df, "id", ["a"], "y", [0, 1, 2], n_folds=2, components=3, costs=costs, inner=2).toPandas()
    assert sorted(out.row_id.astype(int)) == list(range(60))
    for k in (0, 1):
        own = df.where(F.col("fold") != k)
        fitted = ml.FittedComponents(own, "a", 3)
        inner = stratified_folds(fitted.transform(own, "f").drop("fold"), "id", "y", 2).persist()
        mean = {}
        for cost in costs:
            scores = []
            for i in (0, 1):
                model = ml.fit_logistic(inner.where(F.col("fold") != i), "f", "y", cost)
                pred = ml.predict(model, inner.where(F.col("fold") == i), "f").selectExpr("y AS y_true", "y_pred")
                scores.append(scalar_scores(confusion(pred, [0, 1, 2])).first()["balanced_accuracy"])
            mean[cost] = round(sum(scores) / 2, 12)
        best = min(costs, key=lambda c: (-mean[c], c))
        mine = out[out.fold == k].set_index("row_id")
        assert set(mine.cost) == {best}
        want = ml.predict(ml.fit_logistic(inner, "f", "y", best), fitted.transform(df.where(F.col("fold") == k), "f"), "f").collect()
        for r in want:
            assert mine.y_pred[str(r.id)] == r.y_pred and np.allclose(mine.proba[str(r.id)], r.proba, atol=1e-3)


def test_classes_that_are_missing(spark, data):
    """A class without training rows is never predicted; rows without a label or a vector are left out."""
    x, y = data
    df = frame(spark, x, y).withColumn("fold", F.pmod("id", F.lit(2)).cast("int")).where("y < 2")
    odd = spark.createDataFrame([(900, None, 1, 0), (901, x[0].tolist(), None, 1), (902, x[0].tolist(), 7, 0)], "id long, v array<double>, y int, fold int")
    out = nested.nested_cv(df.unionByName(odd), "id", ["v"], "y", [0, 1, 2], n_folds=2, components=3, inner=2).toPandas()
    assert len(out) == 40 and set(out.y_pred) <= {0, 1} and (out.y_true == out.y_pred).mean() > 0.8
    assert nested.nested_cv(df.limit(0), "id", ["v"], "y", [0, 1, 2], n_folds=2).collect() == []


def test_registered_queries_take_all_folds_and_costs(spark, monkeypatch):
    import inspect

    from foldmill.queries import QUERIES
    from tests.conftest import DATA

    asked = {}
    real = inspect.signature(nested.nested_cv)

    def nested_cv(*args, **named):
        bound = real.bind(*args, **named)
        bound.apply_defaults()
        asked.update(bound.arguments)
        return asked["df"].selectExpr("fold", "vec_id AS row_id", "label AS y_true", "label AS y_pred", "0 AS cost")

    monkeypatch.setattr(nested, "nested_cv", nested_cv)
    rows = QUERIES["scaler_pca_fusion"](spark, f"{DATA}/sf0.001")
    n = spark.read.parquet(f"{DATA}/sf0.001/embeddings.parquet").count()
    assert {r.test_fold for r in rows.select("test_fold").distinct().collect()} == set(range(5))
    assert rows.count() == rows.select("vec_id", "test_fold").distinct().count() == 5 * n
    QUERIES["nested_cv_logreg"](spark, f"{DATA}/sf0.001")
    assert (asked["n_folds"], asked["inner"], asked["costs"]) == (5, 3, (0.01, 0.03, 0.1, 0.3, 1.0))
    assert {r.fold for r in asked["df"].select("fold").distinct().collect()} == set(range(5))
