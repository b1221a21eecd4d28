"""Alignment of two modalities by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.functions.text import identifier, key_part


def align(images: DataFrame, texts: DataFrame, key: str = "patient_id") -> DataFrame:
    """Inner join on the key as stripped text; a text goes to each of its patient's groups."""
    left = images.withColumn(key, identifier(F.col(key)))
    right = texts.withColumn(key, identifier(F.col(key)))
    return left.join(right, key)


def patient_of_group(groups: DataFrame, column: str = "group_id") -> DataFrame:
    """Adds patient_id and diagnosis from composite group ids."""
    return groups.withColumn("patient_id", key_part(F.col(column), 0)).withColumn("diagnosis", key_part(F.col(column), 1))


def with_folds(groups: DataFrame, folds: DataFrame, key: str = "group_id") -> DataFrame:
    """Groups with the fold of the fold map; a group that the map lacks is an error."""
    joined = groups.drop("fold").join(folds.groupBy(key).agg(F.max("fold").alias("fold")), key, "left")
    return joined.withColumn("fold", F.coalesce("fold", F.raise_error(F.concat(F.lit("no fold for group "), F.coalesce(F.col(key), F.lit("null")))).cast("int")))
