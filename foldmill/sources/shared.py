"""Tables in the folder that all executors share, for results that are read more than once."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session, else the context's checkpoint folder.

    Where neither is set, local mode gets a temporary folder; on a cluster that is an error.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="foldmill-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


#: Spark then removes a query's shuffle files when the query ends, not when the driver happens to collect garbage.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Tables made since the innermost :func:`spent_tables` began.
MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def spent_tables() -> Iterator[list[DataFrame]]:
    """The tables that are made inside; what is still in the list at the end is deleted."""
    made: list[DataFrame] = []
    token = MADE.set(made)
    try:
        yield made
    finally:
        MADE.reset(token)
        for t in made:
            drop_table(t)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: lineage is cut, and lost executors cost nothing.

    The shuffle files of the write are removed once it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/foldmill-{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    table = spark.read.schema(df.schema).parquet(path)
    if MADE.get() is not None:
        MADE.get().append(table)
    return table


def drop_table(df: DataFrame) -> None:
    """Delete a table made by :func:`materialise` that is spent."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
