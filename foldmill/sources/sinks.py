"""Sinks.  None overwrites what the same job may be reading: give each output its own path."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from foldmill.sources.matrices import StagedWriter, settle


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A Parquet table, replaced as a whole."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_splits(splits: DataFrame, path: str) -> None:
    """A folder of CSV files for each test fold: image, label, split."""
    splits.select("image", "label", "split", "test_fold").write.mode("overwrite").option("header", True).partitionBy("test_fold").csv(path)


def fold_map(groups: DataFrame) -> DataFrame:
    return groups.groupBy("group_id").agg(F.min("fold").alias("fold"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, so texts with line ends can be read back with ``multiLine``."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def wide_metrics(metrics: DataFrame, classes: list[str], per_class: tuple[str, ...] = ("f1", "auc")) -> DataFrame:
    """One row a fold: the scalar metrics, then <class>_<metric>, from ``metrics(model, fold, class, metric, value)``."""
    metric = F.when(F.col("metric") == "kappa", "cohen_kappa").otherwise(F.col("metric"))
    name = F.when(F.col("class").isNull(), metric).otherwise(F.concat_ws("_", "class", "metric"))
    scalars = ["balanced_accuracy", "accuracy", "macro_auc", "macro_f1", "cohen_kappa", "n_train", "n_test", "best_c"]
    columns = scalars + [f"{c}_{m}" for m in per_class for c in classes]
    return metrics.withColumn("name", name).groupBy("model", "fold").pivot("name", columns).agg(F.first("value", ignorenulls=True))


def report_lines(summary: DataFrame) -> DataFrame:
    """One line of text for each row of ``summary(metric, class, mean, std, ci_lo, ci_hi)``."""
    name = F.concat_ws(" ", "class", "metric")
    return summary.select(F.format_string("%s: %.4f +- %.4f [%.4f, %.4f]", name, "mean", "std", "ci_lo", "ci_hi").alias("value"))


def write_report(summary: DataFrame, path: str) -> None:
    report_lines(summary).write.mode("overwrite").text(path)


def png(data: bytes, height: int, width: int) -> bytes:
    """A PNG file of RGB bytes."""
    lines = np.frombuffer(data, np.uint8).reshape(height, width * 3)

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(np.pad(lines, ((0, 0), (1, 0))).tobytes())) + chunk(b"IEND", b"")


class PngWriter(StagedWriter):
    """Rows of (file, data) as PNG files of one size; data holds RGB bytes."""

    def __init__(self, folder: str, job: str, height: int, width: int):
        super().__init__(folder, job)
        self.height, self.width = height, width

    def files(self, rows: Iterator, attempt: str) -> Iterator[tuple[str, bytes]]:
        for name, data in rows:
            yield name, png(bytes(data), self.height, self.width)


class PngFiles(DataSource):
    """Format ``png-files``, to be written only."""

    @classmethod
    def name(cls) -> str:
        return "png-files"

    def schema(self) -> str:
        return "file string, data binary"

    def writer(self, schema, overwrite: bool) -> PngWriter:
        return PngWriter(self.options["path"], self.options["job"], int(self.options["height"]), int(self.options["width"]))


def write_images(images: DataFrame, folder: str, height: int, width: int) -> None:
    """Each row's data, RGB bytes, as the file that its column file names below ``folder``, which has to be shared.

    Null files and null data write nothing. Only what the job commits is moved into place; a file that stands there is replaced.
    """
    spark, job = images.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(PngFiles)
    rows = images.where(F.col("file").isNotNull() & F.col("data").isNotNull()).select("file", "data")
    rows.write.format("png-files").mode("append").option("job", job).option("height", height).option("width", width).save(folder)
    settle(spark, folder, job)
