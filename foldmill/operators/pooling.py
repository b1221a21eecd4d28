"""From rows to groups: mean vectors with the group's own columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.functions.text import composite_key


def mean_pool(df: DataFrame, keys: Sequence[str], vector: str, constant: Sequence[str] = ()) -> DataFrame:
    """One row a group: the mean of its vectors (double), the rows it has, its constant columns.

    Partial sums are merged before the shuffle, so a large group costs no more
    than a small one.  Null vectors are left out; a group of nothing else has no row.
    """
    rows = df.where(F.col(vector).isNotNull()).withColumn("_v", array_to_vector(F.col(vector).cast("array<double>")))
    pooled = rows.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count("*").alias("n_rows"), *[F.min(c).alias(c) for c in constant])
    return pooled.select(*keys, vector_to_array("_m").alias(vector), "n_rows", *constant)


def pool_patients(vectors: DataFrame) -> DataFrame:
    """Image vectors pooled by patient and diagnosis: a patient with two diagnoses makes two groups in one fold."""
    keyed = vectors.withColumn("group_id", composite_key(F.col("patient_id"), F.col("diagnosis")))
    return mean_pool(keyed, ["group_id"], "features", ["patient_id", "diagnosis", "label", "fold"])


def inconstant(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups in which a column that should be constant isn't; none is right."""
    found = df.groupBy(*keys).agg(*[F.countDistinct(c).alias(c) for c in columns])
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | (F.col(c) > 1)
    return found.where(wrong)
