"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.llm.common import NON_SPACE, materialise

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Target of each source from ``sizes(source, source_size)``.

    Sources in code-point order, null last, take the weights in turn and share
    the whole of all sizes.  A target stops at ``max_epochs`` times its source's
    size and the excess goes to the others by weight: with sources ordered by
    size per weight the stopped ones are a prefix of that order, so one window
    over this small table (one row a source) settles it.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (rank % n + 1).cast("int")).cast("long")
    order = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_epochs)
        .withColumn("total", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("share", (F.col("weight") * F.col("left")).cast("double") / F.col("weights_left"))
        .withColumn("stopped", F.col("share") > F.col("cap"))
    )
    # The first source that isn't stopped sets the level of all after it.
    level = F.first(
        F.when(~F.col("stopped"), F.struct("left", "weights_left")), ignorenulls=True
    ).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select(
        "source",
        "source_size",
        F.when(F.col("stopped"), F.col("cap").cast("double"))
        .otherwise((F.col("weight") * F.col("level.left")).cast("double") / F.col("level.weights_left"))
        .alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = "mix",
    whole_rows: bool = False,
) -> DataFrame:
    """How often the mix takes each document.

    ``docs`` needs doc_id, text and source; other columns are not read.  Returns
    doc_id, source, size, source_size, target, copies and taken (= copies * size);
    with ``whole_rows`` also ``row``, a struct of all columns of ``docs``.

    Within a source every document expects target / source_size copies.  The
    documents are laid out by size class, hash, size, id and text, the expected copies
    are summed along that order, one offset is added, and a document is taken
    once for each whole number its stretch crosses.  The order by size class spreads the
    draws over all lengths, so the words taken stay near the target.

    A document's place in its source is its row number inside a cell (source,
    size class, hash bucket) plus the cells before it, so a source that holds
    most rows is still spread over many tasks and only cell counts meet.

    Null texts and texts without words have size 0 and are laid out first; a null
    source is a source of its own; repeated rows are separate documents; an empty
    table gives no rows; a source without words has target 0 and takes nothing.
    """
    row = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if whole_rows else []
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"), *row)
    # One size class to a doubling; a class is split by the hash of id and text, 256 ways.  The key stands for the source, null too.
    hashed = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "digest"))
    cell = (
        sized.withColumn("key", F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")))
        .withColumn("band", F.length(F.bin("size")))
        .withColumn("bucket", F.conv(F.substring(hashed, 1, 2), 16, 10).cast("int"))
    )
    # Texts are read once: without their rows the sizes are written, else the counts of the cells, whose rows are few.
    if not whole_rows:
        cell = materialise(cell, "sizes")
    counts = cell.groupBy("key", "source", "band", "bucket").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    counts = materialise(counts, "cells")
    targets = source_targets(counts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("source", F.lit("\x00")))), 1, 8), 16, 10).cast("double") / 4294967296.0
    rated = targets.select(
        F.when(F.col("source").isNull(), "null").otherwise(F.concat(F.lit("="), "source")).alias("key"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate"), start.alias("offset"),
    )
    ahead = Window.partitionBy("key").orderBy("band", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    cells = counts.select("key", "band", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before")).join(rated, "key")
    inside = F.row_number().over(Window.partitionBy("key", "band", "bucket").orderBy("size", "doc_id", "digest"))
    place = F.col("before") + F.col("inside")
    copies = F.floor(F.col("rate") * place + F.col("offset")) - F.floor(F.col("rate") * (place - 1) + F.col("offset"))
    placed = cell.withColumn("inside", inside).join(cells, ["key", "band", "bucket"]).withColumn("copies", copies.cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if whole_rows else []))


def mixed_rows(docs: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix") -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken."""
    taken = mix_sources(docs, weights, max_epochs, seed, whole_rows=True).where("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")
