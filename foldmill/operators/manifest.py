"""What a manifest of rows, groups, classes and folds looks like, and what is still to be done."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.operators.folds import shuffled
from foldmill.operators.ranking import numbered


def class_stats(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, groups and the median rows of a group, by class."""
    sizes = df.groupBy(label, group).agg(F.count("*").alias("n"))
    return sizes.groupBy(label).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.expr("percentile(n, 0.5)").alias("median_size"))


def overall_stats(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows, groups and classes of the whole table, as one row."""
    return df.agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups"), F.countDistinct(label).alias("n_classes"))


def groups_of_several_classes(df: DataFrame, group: str, label: str) -> DataFrame:
    """Groups with more than one class, and which."""
    found = df.groupBy(group).agg(F.countDistinct(label).alias("n_classes"), F.array_join(F.sort_array(F.collect_set(label)), ",").alias("classes"))
    return found.where("n_classes > 1")


def fold_class_counts(df: DataFrame, group: str, label: str) -> DataFrame:
    """Rows and groups by fold and class, with each fold's own total (class null): group totals don't add up."""
    return df.groupBy("fold", F.col(label).alias("class")).agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups")).unionByName(
        df.groupBy("fold").agg(F.count("*").alias("n_rows"), F.countDistinct(group).alias("n_groups")).withColumn("class", F.lit(None).cast("string"))
    )


def fold_class_table(df: DataFrame, group: str, label: str, classes: list[str]) -> DataFrame:
    """The same as a wide table with a column pair for each class; absent pairs are 0."""
    return df.groupBy("fold").pivot(label, classes).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(group).alias("groups")).na.fill(0)


def frequencies(df: DataFrame, column: str, values: list[str] | None = None) -> DataFrame:
    """Counts by value; values asked for but absent count 0."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    if values is None:
        return counts
    grid = df.sparkSession.createDataFrame([(v,) for v in values], "value string")
    return grid.join(counts, "value", "left").select("value", F.coalesce("n", F.lit(0)).alias("n"))


def pending(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose output isn't there yet."""
    return todo.join(done.select(key), key, "left_anti")


def latest(paths: DataFrame, preferred: tuple[str, ...], path: str = "path") -> DataFrame:
    """The one path to use: a preferred file name first, in order, else the largest number at the end of the name."""
    name = F.substring_index(path, "/", -1)
    rank: Column = F.lit(len(preferred))
    for k in reversed(range(len(preferred))):
        rank = F.when(name == preferred[k], k).otherwise(rank)
    number = F.regexp_extract(name, r"(\d+)(?:\.[^.]*)?$", 1).try_cast("long")
    known = paths.withColumn("_rank", rank).withColumn("_number", F.coalesce(number, F.lit(-1)))
    best = known.where((F.col("_rank") < len(preferred)) | (F.col("_number") >= 0))
    return best.agg(F.max_by(path, F.struct(-F.col("_rank"), "_number", path)).alias(path)).where(F.col(path).isNotNull())


def sample_per_class(df: DataFrame, key: str, label: str, n: int, seed: int | str = 42) -> DataFrame:
    """n rows of each class, at random but the same in every run."""
    return numbered(df, [label], shuffled(F.col(key), seed), [key]).where(F.col("number") <= n)


def sample(df: DataFrame, key: str, n: int, seed: int | str = 42) -> DataFrame:
    """n rows at random, the same in every run, in order of their key."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n).orderBy(key)


def largest_per_class(df: DataFrame, key: str, label: str, value: str, n: int) -> DataFrame:
    """The n rows of each class with the largest value, ties by key."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy(label).orderBy(F.desc(value), key))
    return df.withColumn("rank", order).where(F.col("rank") <= n)


def choose_images(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` with the column image: the segmented path where such a file exists, else the image itself.

    ``files`` has the column path.  A manifest without the column segmented_path
    keeps its images; existence is one join against the listing.
    """
    if "segmented_path" not in rows.columns:
        return rows.withColumn("image", F.col("image_path"))
    there = files.select(F.col("path").alias("segmented_path"), F.lit(True).alias("_there")).distinct()
    joined = rows.join(there, "segmented_path", "left")
    return joined.withColumn("image", F.coalesce(F.when(F.col("_there"), F.col("segmented_path")), F.col("image_path"))).drop("_there")


def with_defaults(rows: DataFrame, classes: tuple[tuple[str, int, str], ...]) -> DataFrame:
    """Adds label from diagnosis, and folder_name from patient_id, only where the column is absent."""
    from foldmill.schema import label_of

    if "label" not in rows.columns:
        rows = rows.withColumn("label", label_of(F.col("diagnosis"), classes))
    if "folder_name" not in rows.columns:
        rows = rows.withColumn("folder_name", F.col("patient_id"))
    return rows


def crop_counters(crops: DataFrame) -> DataFrame:
    """How many images were cropped, fell back to the whole image, or couldn't be read."""
    return crops.agg(F.count("*").alias("n"), F.count_if("fallback").alias("n_fallback"), F.count_if(~F.col("readable")).alias("n_unreadable"))


def missing_images(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Rows whose image file doesn't exist."""
    return rows.join(files.select(F.col("path").alias("image_path")), "image_path", "left_anti")

