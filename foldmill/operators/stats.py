"""Statistics across folds and of pairs of columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmill.operators.ranking import mid_ranks


def beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 300):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + top * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + top / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1.0) < 1e-15:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x < (a + 1) / (a + b + 2):
        return front * beta_fraction(a, b, x) / a
    return 1.0 - front * beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """Chance that Student's t lies further from 0 than ``t``."""
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(share: float, df: float) -> float:
    """t with so much of the distribution within +-t, by halving."""
    low, high = 0.0, 1.0
    while t_two_sided(high, df) > 1 - share:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if t_two_sided(mid, df) > 1 - share else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Two-sided p of t statistics; null where either is missing or df isn't positive."""
    return pd.Series([t_two_sided(a, b) if a == a and b == b and b > 0 else None for a, b in zip(t.astype(float), df.astype(float))], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_95(df: pd.Series) -> pd.Series:
    """0.975 quantile of Student's t; null unless df is positive."""
    known = {d: t_quantile(0.95, d) for d in set(df.dropna().tolist()) if d > 0}
    return df.map(known).astype("float64")


def fold_summary(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """n, mean, population deviation and 95 % interval of the mean over folds; nulls are left out, n counts the rest."""
    stats = values.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.stddev_samp(value).alias("_s"))
    half = t_95((F.col("n") - 1).cast("double")) * F.col("_s") / F.sqrt("n")
    return stats.select(*by, "n", "mean", "std", (F.col("mean") - half).alias("ci_lo"), (F.col("mean") + half).alias("ci_hi"))


def paired_t(values: DataFrame, model_a: str, model_b: str, by: Sequence[str] = ("metric",)) -> DataFrame:
    """Paired t-test over folds of two models of ``values(model, fold, metric, value)``: difference a - b, interval, p."""
    a = values.where(F.col("model") == model_a).select(*by, "fold", F.col("value").alias("a"))
    b = values.where(F.col("model") == model_b).select(*by, "fold", F.col("value").alias("b"))
    pairs = a.join(b, [*by, "fold"]).withColumn("d", F.col("a") - F.col("b"))
    stats = pairs.groupBy(*by).agg(F.count("d").alias("n"), F.avg("d").alias("delta"), F.stddev_samp("d").alias("_s"))
    sem, df = F.col("_s") / F.sqrt("n"), (F.col("n") - 1).cast("double")
    t = F.try_divide(F.col("delta"), sem)
    half = t_95(df) * sem
    return stats.select(*by, "n", "delta", (F.col("delta") - half).alias("ci_lo"), (F.col("delta") + half).alias("ci_hi"), t.alias("t"), t_p_value(t, df).alias("p"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rho and two-sided p of the rank correlation; rows with a null are left out."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
    pairs = rows.groupBy("a", "b").agg(F.count("*").alias("n"))
    ra = mid_ranks(rows, [], "a").select("a", F.col("mid_rank").alias("ra"))
    rb = mid_ranks(rows, [], "b").select("b", F.col("mid_rank").alias("rb"))
    ranked = pairs.join(ra, "a").join(rb, "b")
    n, x, y = F.col("n"), F.col("ra"), F.col("rb")
    s = ranked.agg(F.sum(n).alias("n"), F.sum(n * x).alias("x"), F.sum(n * y).alias("y"), F.sum(n * x * x).alias("xx"), F.sum(n * y * y).alias("yy"), F.sum(n * x * y).alias("xy"))
    cov = F.col("xy") - F.col("x") * F.col("y") / F.col("n")
    var_x, var_y = F.col("xx") - F.col("x") * F.col("x") / F.col("n"), F.col("yy") - F.col("y") * F.col("y") / F.col("n")
    rho = s.select("n", F.try_divide(cov, F.sqrt(var_x * var_y)).alias("rho"))
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") * F.col("rho")))
    return rho.withColumn("p", t_p_value(t, (F.col("n") - 2).cast("double")))


def length_stats(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows, empty texts, and mean, population deviation, least and most characters."""
    n: Column = F.char_length(F.coalesce(F.col(text), F.lit("")))
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(n == 0).alias("n_empty"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("std"), F.min(n).alias("min"), F.max(n).alias("max"))
