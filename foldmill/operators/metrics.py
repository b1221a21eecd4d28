"""Classification metrics from one confusion aggregate and one pass of ranks, by fold or any other key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmill.operators.ranking import mid_ranks, running


def confusion(pred: DataFrame, classes: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """n for every pair of classes of the fixed grid, 0 where there is none."""
    counts = pred.groupBy(*by, "y_true", "y_pred").agg(F.count("*").alias("n"))
    keys = pred.select(*by).distinct() if by else pred.sparkSession.range(1).select()
    labels = F.array(*[F.lit(int(c)) for c in classes])
    grid = keys.select(*by, F.explode(labels).alias("y_true")).select("*", F.explode(labels).alias("y_pred"))
    return grid.join(counts, [*by, "y_true", "y_pred"], "left").select(*by, "y_true", "y_pred", F.coalesce("n", F.lit(0)).alias("n"))


def summed(matrix: DataFrame) -> DataFrame:
    """Confusion matrices added over all other keys."""
    return matrix.groupBy("y_true", "y_pred").agg(F.sum("n").alias("n"))


def normalised(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Shares of each true class; a class without rows has shares of 0."""
    return matrix.withColumn("share", F.col("n") / (F.sum("n").over(Window.partitionBy(*by, "y_true")) + 1e-9))


def class_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """precision, recall, f1 and support by class; 0 where a denominator is 0."""
    diagonal = F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0))
    rows = matrix.groupBy(*by, F.col("y_true").alias("class")).agg(F.sum("n").alias("support"), diagonal.alias("hit"))
    columns = matrix.groupBy(*by, F.col("y_pred").alias("class")).agg(F.sum("n").alias("called"))
    both = rows.join(columns, [*by, "class"])
    zero = F.lit(0.0)
    return both.select(
        *by, "class",
        F.coalesce(F.try_divide(F.col("hit"), F.col("called")), zero).alias("precision"),
        F.coalesce(F.try_divide(F.col("hit"), F.col("support")), zero).alias("recall"),
        F.coalesce(F.try_divide(2 * F.col("hit"), F.col("support") + F.col("called")), zero).alias("f1"),
        "support", "hit", "called",
    )


def scalar_scores(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """n, accuracy, balanced accuracy (over classes that occur), kappa (null where it is undefined) and macro f1."""
    sums = class_scores(matrix, by).groupBy(*by).agg(
        F.sum("support").alias("n"), F.sum("hit").alias("hits"), F.sum(F.col("support") * F.col("called")).alias("chance"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"),
    )
    po, pe = F.try_divide("hits", "n"), F.try_divide(F.col("chance"), F.col("n").cast("double") * F.col("n"))
    return sums.select(*by, "n", po.alias("accuracy"), "balanced_accuracy", F.try_divide(po - pe, 1 - pe).alias("kappa"), "macro_f1")


def roc_auc(scores: DataFrame, by: Sequence[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """AUC of each group from mid-ranks (ties count half); null unless both classes occur.

    ``positive`` is 1 or 0.  Ranks are made over distinct scores.
    """
    ranks = mid_ranks(scores.where(F.col(score).isNotNull()), by, score, [positive])
    sums = ranks.groupBy(*by).agg(F.sum(F.col("mid_rank") * F.col(positive)).alias("r"), F.sum(positive).alias("pos"), F.sum("n").alias("n"))
    pos, neg = F.col("pos"), F.col("n") - F.col("pos")
    auc = F.try_divide(F.col("r") - pos * (pos + 1) / 2, pos.cast("double") * neg)
    return sums.select(*by, pos.alias("n_pos"), neg.alias("n_neg"), auc.alias("auc"))


def one_vs_rest(pred: DataFrame, classes: Sequence[int], proba: str = "proba", label: str = "y_true") -> DataFrame:
    """Each row once for each class: class, score (its probability), positive."""
    parts = F.array(*[F.struct(F.lit(int(c)).alias("class"), F.get(proba, F.lit(k)).alias("score"), (F.col(label) == c).cast("int").alias("positive")) for k, c in enumerate(classes)])
    return pred.withColumn("_c", F.explode(parts)).select("*", "_c.class", "_c.score", "_c.positive").drop("_c")


def macro_auc(by_class: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean AUC over classes; null if any class's is."""
    return by_class.groupBy(*by).agg(F.when(F.count("*") == F.count("auc"), F.avg("auc")).alias("macro_auc"))


def roc_points(scores: DataFrame, by: Sequence[str], score: str = "score", positive: str = "positive") -> DataFrame:
    """(fpr, tpr) at each distinct score from the top, and (0, 0); groups of one class have none."""
    if not by:
        return roc_points(scores.withColumn("_all", F.lit(0)), ["_all"], score, positive).drop("_all")
    counts = scores.where(F.col(score).isNotNull()).groupBy(*by, score).agg(F.sum(positive).alias("p"), F.sum(1 - F.col(positive)).alias("q"))
    steps = running(counts, by, score, ["p", "q"], descending=True)
    totals = counts.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q")).where("all_p > 0 and all_q > 0")
    points = steps.join(totals, [*by])
    zero = totals.select(*by, F.lit(None).cast("double").alias(score), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.select(*by, F.col(score).cast("double").alias(score), (F.col("cum_q") / F.col("all_q")).alias("fpr"), (F.col("cum_p") / F.col("all_p")).alias("tpr")).unionByName(zero)


def mean_roc(points: DataFrame, by: Sequence[str], repeat: str, steps: int = 100) -> DataFrame:
    """Curves of the repeats of each group on one grid of fpr: mean and population deviation of tpr.

    Each curve is read off by linear interpolation, at a vertical step its upper
    end; it starts at 0 and the mean ends at 1.  A curve is a sorted list of segments, and
    each grid step is looked up in it by the segment it falls into.
    """
    keys = [*by, repeat]
    level = points.groupBy(*keys, "fpr").agg(F.min("tpr").alias("lo"), F.max("tpr").alias("hi"))
    after = Window.partitionBy(*keys).orderBy("fpr")
    segments = level.select(*keys, "fpr", "hi", F.lead("fpr").over(after).alias("next_fpr"), F.lead("lo").over(after).alias("next_lo"))
    # the grid steps in [fpr, next_fpr): no join
    last = F.when(F.col("next_fpr").isNull(), F.lit(steps - 1)).otherwise(F.ceil(F.col("next_fpr") * (steps - 1) - 1e-12).cast("int") - 1)
    first = F.ceil(F.col("fpr") * (steps - 1) - 1e-12).cast("int")
    on_grid = segments.where(first <= last).select(*keys, "fpr", "hi", "next_fpr", "next_lo", F.explode(F.sequence(first, last)).alias("step"))
    x = F.col("step") / float(steps - 1)
    blend = F.col("hi") + F.coalesce(F.try_divide((F.col("next_lo") - F.col("hi")) * (x - F.col("fpr")), F.col("next_fpr") - F.col("fpr")), F.lit(0.0))
    read = on_grid.withColumn("tpr", F.when(F.col("step") == 0, 0.0).otherwise(blend))
    mean = read.groupBy(*by, "step").agg(F.avg("tpr").alias("mean_tpr"), F.stddev_pop("tpr").alias("std_tpr"), F.count("*").alias("n_curves"))
    return mean.select(*by, "step", x.alias("fpr"), F.when(F.col("step") == steps - 1, 1.0).otherwise(F.col("mean_tpr")).alias("mean_tpr"), "std_tpr", "n_curves")


def curve_area(curve: DataFrame, by: Sequence[str], x: str = "fpr", y: str = "mean_tpr") -> DataFrame:
    """Area under each curve by trapezoids."""
    after = Window.partitionBy(*by).orderBy(x)
    width = F.lead(x).over(after) - F.col(x)
    return curve.withColumn("_a", width * (F.lead(y).over(after) + F.col(y)) / 2).groupBy(*by).agg(F.sum("_a").alias("area"))


def long_format(wide: DataFrame, keys: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """(keys, metric, value) with a row for each metric."""
    return wide.unpivot(list(keys), [F.col(m).cast("double").alias(m) for m in metrics], "metric", "value")
