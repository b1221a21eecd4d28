"""Scaled components and balanced logistic regression of one training set."""

from __future__ import annotations

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.functions.vectors import argmax


def signs(loadings: np.ndarray) -> np.ndarray:
    """1 or -1 for each column, so that its largest entry becomes positive; the first of those that are alike but for rounding."""
    size = np.abs(loadings)
    first = (size >= size.max(0) - 1e-9).argmax(0)
    return np.where(np.take_along_axis(loadings, first[None], 0)[0] >= 0, 1.0, -1.0)


class FittedComponents:
    """A scaler and components fitted on training rows: signs fixed, unit population variance."""

    def __init__(self, train: DataFrame, vector: str, most: int = 8):
        rows = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("x"))
        n = rows.count()
        width = rows.first()["x"].size
        self.vector, self.k = vector, max(1, min(most, n - 1, width))
        self.scaler = StandardScaler(inputCol="x", outputCol="z", withMean=True, withStd=True).fit(rows)
        # the scaler divides by the sample deviation; the population one is wanted
        self.factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        self.model = PCA(k=self.k, inputCol="z", outputCol="c").fit(self.scaler.transform(rows))
        loadings = self.model.pc.toArray()
        self.signs = signs(loadings)

    def transform(self, df: DataFrame, out: str) -> DataFrame:
        x = df.withColumn("x", array_to_vector(F.col(self.vector).cast("array<double>")))
        scored = self.model.transform(self.scaler.transform(x))
        signed = F.zip_with(vector_to_array("c"), F.array(*[F.lit(float(s) * self.factor) for s in self.signs]), lambda a, b: a * b)
        return scored.withColumn(out, signed).drop("x", "z", "c")


def balanced_weights(train: DataFrame, label: str) -> Column:
    """n / (classes * rows of the class), as a column over the labels."""
    counts = {r[label]: r["n"] for r in train.groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a class
    n = sum(counts.values())
    pairs = [x for c, m in sorted(counts.items()) for x in (F.lit(c), F.lit(n / (len(counts) * m)))]
    return F.create_map(*pairs)[F.col(label)]


def fit_logistic(train: DataFrame, features: str, label: str, cost: float):
    """Minimise sum of weighted log losses + |W|^2 / (2 cost); the intercept is free."""
    n = train.count()
    rows = train.select(array_to_vector(F.col(features)).alias("features"), F.col(label).cast("double").alias("label"), balanced_weights(train, label).alias("weight"))
    learner = LogisticRegression(family="multinomial", weightCol="weight", regParam=1.0 / (cost * n), elasticNetParam=0.0, standardization=False, maxIter=2000, tol=1e-8)
    return learner.fit(rows)


def predict(model, rows: DataFrame, features: str) -> DataFrame:
    """``rows`` with proba and y_pred (the first of equal maxima)."""
    scored = model.transform(rows.withColumn("features", array_to_vector(F.col(features))))
    return scored.withColumn("proba", vector_to_array("probability")).withColumn("y_pred", argmax(F.col("proba"))).drop("features", "rawPrediction", "probability", "prediction")


def two_components(df: DataFrame, vector: str) -> DataFrame:
    """Two principal components, in place of a neighbour embedding for plots."""
    return FittedComponents(df, vector, 2).transform(df, "xy").withColumn("x", F.get("xy", F.lit(0))).withColumn("y", F.get("xy", F.lit(1))).drop("xy")
