"""Row numbers, ranks and running sums that need no window over the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Quantiles that cut the values of a running sum into buckets.
BUCKETS = 64


def numbered(df: DataFrame, by: Sequence[str], digest: Column, ties: Sequence[str], name: str = "number") -> DataFrame:
    """Number the rows of each group from 1, in order of a hexadecimal digest.

    Rows are numbered inside 256 buckets by the digest's first two digits, and
    the sizes of the buckets before are added, so that a group that holds most
    rows is still spread over many tasks.  Only counts by bucket meet.
    """
    rows = df.withColumn("_digest", digest).withColumn("_bucket", F.substring("_digest", 1, 2))
    counts = rows.groupBy(*by, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy("_digest", *ties))
    on = F.col("_bucket") == F.col("_b")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    joined = rows.withColumn("_inside", inside).join(starts, on)
    return joined.select(*df.columns, (F.col("_start") + F.col("_inside")).alias(name))


def bucket_of(df: DataFrame, value: str, buckets: int = BUCKETS) -> Column:
    """Bucket of a numeric column by its approximate quantiles; equal values share one."""
    cuts = df.select(F.percentile_approx(F.col(value), [k / buckets for k in range(1, buckets)], 10000)).collect()[0][0]
    return sum((F.col(value) > c).cast("int") for c in sorted(set(cuts or []))) + F.lit(0)


def running(df: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """Running sums, up to and with each row, in order of a numeric column that is distinct within its group.

    Adds ``cum_<name>`` for each of ``sums``.  The column is cut into buckets at
    its quantiles; sums by bucket give each bucket's start.
    """
    rows = df.withColumn("_bucket", bucket_of(df, value) * (-1 if descending else 1))
    order = F.desc(value) if descending else F.asc(value)
    totals = rows.groupBy(*by, "_bucket").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*by, "_bucket", *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_s_{s}") for s in sums])
    inside = Window.partitionBy(*by, "_bucket").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(s).over(inside).alias(f"_i_{s}") for s in sums])
    joined = local.join(starts, [*by, "_bucket"])
    return joined.select(*df.columns, *[(F.col(f"_s_{s}") + F.col(f"_i_{s}")).alias(f"cum_{s}") for s in sums])


def mid_ranks(df: DataFrame, by: Sequence[str], value: str, weights: Sequence[str] = ()) -> DataFrame:
    """One row for each distinct value of a group: its rows ``n``, their mid-rank, and sums of ``weights``."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), *[F.sum(w).alias(w) for w in weights])
    return running(counts, by, value, ["n"]).withColumn("mid_rank", F.col("cum_n") - (F.col("n") - 1) / 2.0).drop("cum_n")
