"""Nested cross-validation of fused components: all folds and costs together, in a few passes over the rows.

Scaling and components of every training set come from one pass (a training set's
moments are the total's less its test fold's).  The logistic models of all test folds,
inner folds and costs take their Newton steps together: each step is one job, in which
every task sums the gradients and Hessians of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmill.operators.folds import shuffled
from foldmill.operators.metrics import confusion, scalar_scores
from foldmill.operators.ml import signs
from foldmill.operators.ranking import numbered

COSTS = (0.01, 0.03, 0.1, 0.3, 1.0)
#: Rows whose outer products are held at once.
CHUNK = 2048
#: Rows of a task of the joint fit, at least.
TASK_ROWS = 4096
#: Newton steps at most, and the gradient (by row) below which a model is done.
STEPS, GRADIENT = 60, 1e-9


def matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), float)


@dataclass
class Moments:
    """Count, sum and Gram matrix of rows from which ``pivot`` was taken."""

    pivot: np.ndarray
    product: np.ndarray

    def __sub__(self, other: Moments) -> Moments:
        return Moments(self.pivot, self.product - other.product)

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(d x k, k): rows times the one plus the other are components of standardised features, signs fixed.

        A feature that is the same in all rows counts as 0.
        """
        n, total, gram = self.product[0, 0], self.product[0, 1:], self.product[1:, 1:]
        mean = total / n
        cov = gram / n - np.outer(mean, mean)
        var, about = np.diag(cov), np.diag(gram) / n
        scale = np.where(var > 1e-12 * about, 1 / np.sqrt(np.maximum(var, 1e-300)), 0.0)
        values, vectors = np.linalg.eigh(cov * np.outer(scale, scale))
        k = max(1, min(most, int(n) - 1, len(mean)))
        loadings = vectors[:, np.argsort(-values, kind="stable")[:k]]
        turned = scale[:, None] * loadings * signs(loadings)
        return turned, -(self.pivot + mean) @ turned


def fold_moments(df: DataFrame, vectors: Sequence[str]) -> dict[tuple[int, int], Moments]:
    """Moments by (fold, place in ``vectors``), from one pass.

    Matrices are added up row by row, by as many groups; the driver gets a matrix for each fold and vector.
    """
    first = df.select(*vectors).first()
    if first is None:
        return {}
    pivots = [np.array(v, float) for v in first]

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for fold, part in frame.groupby("fold"):
                for j, v in enumerate(vectors):
                    x = np.c_[np.ones(len(part)), matrix(part[v]) - pivots[j]]
                    sums[fold, j] = sums.get((fold, j), 0) + x.T @ x
        for (fold, j), product in sums.items():
            yield pd.DataFrame({"fold": fold, "vector": j, "row": np.arange(len(product)), "values": list(product)})

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.iloc[:1].assign(values=[matrix(frame["values"]).sum(0)])

    schema = "fold int, vector int, row int, values array<double>"
    parts = df.select("fold", *vectors).mapInPandas(partial, schema).groupBy("fold", "vector", "row").applyInPandas(added, schema).toPandas()
    out = {}
    for (fold, j), part in parts.groupby(["fold", "vector"]):
        out[int(fold), int(j)] = Moments(pivots[j], matrix(part.sort_values("row")["values"]))
    return out


def fused_by_fold(df: DataFrame, vectors: Sequence[str], test_folds: Sequence[int], components: int = 8, out: str = "fused") -> DataFrame:
    """Every row of ``df`` once for each test fold: test_fold and the components of each vector, one after the other.

    Scaling and components are fitted on the rows outside the test fold.
    Rows with a null vector or fold are left out; a test fold without training rows gives none.
    """
    rows = df.where(F.col("fold").isNotNull()).dropna(subset=list(vectors))
    moments = fold_moments(rows, vectors)
    maps: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    for k in test_folds:
        if any(fold != k for fold, _ in moments):
            totals = [Moments(next(m.pivot for (_, i), m in moments.items() if i == j), sum(m.product for (_, i), m in moments.items() if i == j)) for j in range(len(vectors))]
            maps[k] = [(total - moments[k, j] if (k, j) in moments else total).components(components) for j, total in enumerate(totals)]
    keep = [c for c in df.columns if c not in vectors]
    made = T.StructType([*[rows.schema[c] for c in keep], T.StructField("test_fold", T.IntegerType()), T.StructField(out, T.ArrayType(T.DoubleType()))])

    def turn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            x = [part.column(v).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, -1) for v in vectors]
            for k in maps if n else ():
                fused = np.concatenate([a @ t + b for a, (t, b) in zip(x, maps[k])], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * fused.shape[1], pa.int32()), pa.array(fused.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in keep], pa.array([k] * n, pa.int32()), lists], names=[*keep, "test_fold", out])

    return rows.select(*keep, *vectors).mapInArrow(turn, made)


@dataclass
class Problem:
    """One model: the rows of a test fold's training set outside an inner fold (None: all of them), and a cost."""

    test_fold: int
    inner: int | None
    cost: float


def class_weights(counts: dict[tuple[int, int, int], int], problem: Problem, classes: int) -> np.ndarray:
    """n / (classes that occur * rows of the class); 0 for a class without rows."""
    n = np.zeros(classes)
    for (k, inner, c), m in counts.items():
        if k == problem.test_fold and inner != problem.inner:
            n[c] += m
    return np.where(n > 0, n.sum() / (max(1, (n > 0).sum()) * np.maximum(n, 1)), 0.0)


def softmax(x: np.ndarray, theta: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Probabilities of the classes that occur; ``x`` has a column of ones, ``theta`` is class by feature."""
    z = np.where(present, x @ theta.T, -np.inf)
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def fit_together(rows: DataFrame, problems: Sequence[Problem], counts: dict[tuple[int, int, int], int], classes: int, width: int, start: Sequence[np.ndarray] | None = None) -> list[np.ndarray]:
    """Minimise, for each problem, the sum of weighted log losses + |W|^2 / (2 cost); intercepts are free.

    ``rows`` has test_fold, inner, class and x.  Returns class-by-feature coefficients, the intercept last.
    Steps that don't lower the objective are halved.  The driver holds the coefficients only.
    """
    weights = [class_weights(counts, p, classes) for p in problems]
    theta = [np.zeros((classes, width + 1)) for _ in problems] if start is None else [t.copy() for t in start]
    kept: list[tuple[np.ndarray, float, np.ndarray] | None] = [None] * len(problems)  # parameters, objective, step from there
    open_ = [i for i, w in enumerate(weights) if (w > 0).sum() > 1]
    for _ in range(STEPS):
        if not open_:
            break
        found = newton_steps(rows, [(i, problems[i], weights[i], theta[i]) for i in open_], classes, width)
        left = []
        for i in open_:
            value, slope, step = found[i]
            before = kept[i]
            if before is not None and value > before[1] + 1e-12 * abs(before[1]):
                kept[i] = (before[0], before[1], before[2] / 2)
                theta[i] = before[0] + kept[i][2]
                if np.abs(kept[i][2]).max() > 1e-12:
                    left.append(i)
                else:
                    theta[i] = before[0]
            elif slope > GRADIENT * max(1.0, sum(m for (k, inner, _), m in counts.items() if k == problems[i].test_fold and inner != problems[i].inner)):
                kept[i] = (theta[i], value, step)
                theta[i] = theta[i] + step
                left.append(i)
        open_ = left
    return theta


def newton_steps(rows: DataFrame, problems: list[tuple[int, Problem, np.ndarray, np.ndarray]], classes: int, width: int) -> dict[int, tuple[float, float, np.ndarray]]:
    """Objective, largest entry of the gradient, and Newton step of each problem at its parameters: one job.

    Each task sums the derivatives of its rows; a problem's sums meet in one group, which solves for the step.
    """

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[int, np.ndarray] = {}
        for frame in frames:
            for k, part in frame.groupby("test_fold"):
                for at in range(0, len(part), CHUNK):
                    piece = part.iloc[at : at + CHUNK]
                    x = np.c_[matrix(piece["x"]), np.ones(len(piece))]
                    products = (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
                    label, inner = piece["class"].to_numpy(), piece["inner"].to_numpy()
                    for i, problem, weight, theta in problems:
                        if problem.test_fold == k:
                            w = np.where(inner == problem.inner, 0.0, weight[label])
                            sums[i] = sums.get(i, 0) + derivatives(x, products, label, w, theta, weight > 0)
        for i, values in sums.items():
            yield pd.DataFrame({"model": [i], "sums": [values]})

    by_number = {i: rest for i, *rest in problems}

    def solved(table: pa.Table) -> pa.Table:
        i = table.column("model")[0].as_py()
        problem, weight, theta = by_number[i]
        flat = table.column("sums").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        size = theta.size
        ridge = np.concatenate([np.full((classes, width), 1 / problem.cost), np.zeros((classes, 1))], 1).ravel()
        value = flat[0] + 0.5 * (ridge * theta.ravel() ** 2).sum()
        slope = flat[1 : size + 1] + ridge * theta.ravel()
        curve = flat[size + 1 :].reshape(size, size) + np.diag(ridge)
        # the intercepts of the classes that occur may all be moved together: no step goes there; nor to other classes
        level = np.zeros((classes, width + 1))
        level[weight > 0, -1] = 1.0
        away = np.zeros((classes, width + 1))
        away[weight == 0] = 1.0
        step = np.linalg.solve(curve + np.outer(level.ravel(), level.ravel()) + np.diag(away.ravel()), -slope)
        return pa.table({"model": pa.array([i], pa.int32()), "value": [float(value)], "slope": [float(np.abs(slope).max())], "step": pa.array([step.tolist()], pa.list_(pa.float64()))})

    parts = rows.mapInPandas(partial, "model int, sums array<double>")
    found = parts.groupBy("model").applyInArrow(solved, "model int, value double, slope double, step array<double>").collect()
    return {r.model: (r.value, r.slope, np.array(r.step).reshape(classes, width + 1)) for r in found}


def derivatives(x: np.ndarray, products: np.ndarray, label: np.ndarray, w: np.ndarray, theta: np.ndarray, present: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian of some rows, end to end."""
    p, c, d = softmax(x, theta, present), len(theta), x.shape[1]
    loss = -(w * np.log(np.maximum(p[np.arange(len(x)), label], 1e-300))).sum()
    off = p.copy()
    off[np.arange(len(x)), label] -= 1.0
    slope = (off * w[:, None]).T @ x
    pairs = -p[:, :, None] * p[:, None, :]
    pairs[:, np.arange(c), np.arange(c)] += p
    curve = ((pairs * w[:, None, None]).reshape(len(x), -1).T @ products).reshape(c, c, d, d).transpose(0, 2, 1, 3)
    return np.concatenate([[loss], slope.ravel(), curve.ravel()])


def predicted(rows: DataFrame, problems: Sequence[Problem], theta: Sequence[np.ndarray], present: Sequence[np.ndarray], classes: Sequence[int], held_out: bool) -> DataFrame:
    """test_fold, model, inner, key, y_true, y_pred and proba of the rows of each problem's test fold, or its inner one.

    Of equal probabilities the first class is taken.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, (problem, t) in enumerate(zip(problems, theta)):
                part = frame[(frame["test_fold"] == problem.test_fold) & ((frame["fold"] == problem.test_fold) if held_out else (frame["inner"] == problem.inner))]
                if len(part):
                    p = softmax(np.c_[matrix(part["x"]), np.ones(len(part))], t, present[i])
                    labels = np.array(classes)
                    yield pd.DataFrame({"model": i, "fold": problem.test_fold, "row_id": part["row_id"], "y_true": labels[part["class"].to_numpy()], "y_pred": labels[p.argmax(1)], "proba": list(p)})

    return rows.mapInPandas(run, "model int, fold int, row_id string, y_true int, y_pred int, proba array<double>")


def nested_cv(df: DataFrame, key: str, vectors: Sequence[str], label: str, classes: Sequence[int], n_folds: int = 5, components: int = 8, costs: Sequence[float] = COSTS, inner: int = 3, name: str = "fusion", test_folds: Sequence[int] | None = None, seed: int | str = 42) -> DataFrame:
    """Predictions for every row by the model of the folds it isn't in: model, fold, row_id, y_true, y_pred, proba, cost.

    ``df`` has the column fold; only rows of ``test_folds`` are predicted, if given.  Scaling and components are fitted on
    the training folds only; the cost is the one with the best mean balanced accuracy over inner folds
    within them, the smallest on ties.  Rows without label or with one that isn't in ``classes`` are left out.
    """
    which = list(range(n_folds) if test_folds is None else test_folds)
    codes = F.create_map(*[F.lit(x) for k, c in enumerate(classes) for x in (int(c), k)])
    known = df.where(F.col(label).isin([int(c) for c in classes]))
    fused = fused_by_fold(known.select(key, label, "fold", *vectors), vectors, which, components, "x")
    rows = fused.withColumn("class", codes[F.col(label)])
    inside = numbered(rows.where(F.col("fold") != F.col("test_fold")), ["test_fold", label], shuffled(F.col(key), seed), [key], "_number")
    train = inside.select(F.col(key).cast("string").alias("row_id"), "fold", "test_fold", "class", "x", ((F.col("_number") - 1) % inner).cast("int").alias("inner")).persist()
    kept = train
    counts = {(r.test_fold, r.inner, r["class"]): r.n for r in train.groupBy("test_fold", "inner", "class").agg(F.count("*").alias("n")).collect()}
    which = sorted({k for k, _, _ in counts})
    #: each task sums a Hessian a model, so tasks are few and large
    tasks = max(1, min(2 * df.sparkSession.sparkContext.defaultParallelism, sum(counts.values()) // TASK_ROWS))
    sizes = {r.test_fold: r.n for r in train.groupBy("test_fold").agg(F.first(F.size("x")).alias("n")).collect()}
    if not which:
        train.unpersist()
        return predicted(rows.withColumn("row_id", F.col(key).cast("string")), [], [], [], classes, True).select(F.lit(name).alias("model"), "fold", "row_id", "y_true", "y_pred", "proba", F.lit(0.0).alias("cost"))
    width = max(sizes.values())  # all alike, unless a training set has fewer rows than components
    train = train if len(set(sizes.values())) == 1 else train.withColumn("x", F.expr(f"concat(x, array_repeat(0D, {width} - size(x)))"))
    train = train.coalesce(tasks)
    trials = [Problem(k, i, c) for k in which for i in range(inner) for c in costs]
    fits = fit_together(train, trials, counts, len(classes), width)
    present = [class_weights(counts, p, len(classes)) > 0 for p in trials]
    scores = scalar_scores(confusion(predicted(train, trials, fits, present, classes, False).select("model", "y_true", "y_pred"), classes, ["model"]), ["model"])
    accuracy = {r.model: r.balanced_accuracy for r in scores.select("model", "balanced_accuracy").collect()}  # a row a trial
    chosen, start = [], []
    for k in which:
        mean = {c: float(np.mean([accuracy.get(i, 0.0) for i, p in enumerate(trials) if (p.test_fold, p.cost) == (k, c)])) for c in costs}
        cost = min(costs, key=lambda c: (-round(mean[c], 12), c))
        chosen.append(Problem(k, None, cost))
        start.append(np.mean([f for f, p in zip(fits, trials) if (p.test_fold, p.cost) == (k, cost)], 0))
    final = fit_together(train, chosen, counts, len(classes), width, start)
    kept.unpersist()  # the predictions work out their few rows anew
    tested = rows.where(F.col("fold") == F.col("test_fold")).select(F.col(key).cast("string").alias("row_id"), "fold", "test_fold", "class", F.expr(f"concat(x, array_repeat(0D, {width} - size(x)))").alias("x"))
    found = predicted(tested, chosen, final, [class_weights(counts, p, len(classes)) > 0 for p in chosen], classes, True)
    by_fold = F.create_map(*[F.lit(x) for p in chosen for x in (p.test_fold, float(p.cost))])
    return found.select(F.lit(name).alias("model"), "fold", "row_id", "y_true", "y_pred", "proba", by_fold[F.col("fold")].alias("cost"))
