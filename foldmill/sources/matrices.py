"""Matrices in .npy files as a Spark data source, read by ranges of rows and written with commits; files that tasks write and a commit puts in place."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

#: Bytes of a partition, and of what a task holds at once.
RANGE, HELD = 32 << 20, 4 << 20
#: Rows of a written file at most: a task holds no more.
FILE_ROWS = 65_536
#: Names the attempts whose files count.
COMMITTED = "_committed"


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Rows(InputPartition):
    """Rows of one file; all of them if they don't lie one after the other."""

    path: str
    offset: int
    first: int
    n: int
    width: int
    dtype: str
    shape: tuple[int, ...]
    by_column: bool


class NpyReader(DataSourceReader):
    """Headers are read once, when the partitions are made; a task reads its range in pieces."""

    def __init__(self, path: str, size: int, texts: bool = False):
        self.path, self.size, self.texts = path, size, texts

    def partitions(self) -> list[Rows]:
        files, base = located(self.path)
        info = files.get_file_info(base)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [base] if info.type == fs.FileType.File else [f.path for f in files.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and f.path.endswith(".npy")]
        out = []
        for path in sorted(found):
            with files.open_input_file(path) as f:
                version = np.lib.format.read_magic(f)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, dtype = read(f)
                offset = f.tell()
            if dtype.hasobject:
                raise ValueError(f"{path} holds objects, which are never unpickled")
            if not shape:
                raise ValueError(f"{path} is a single number")
            if self.texts != (dtype.kind in "US") or self.texts and len(shape) > 1:
                raise ValueError(f"{path} has {dtype} values in {len(shape)} dimensions")
            width = int(np.prod(shape[1:], dtype=np.int64))
            by_column = by_column and len(shape) > 1
            step = shape[0] if by_column else max(1, self.size // max(1, width * dtype.itemsize))
            out += [Rows(path, offset, at, min(step, shape[0] - at), width, dtype.str, tuple(shape), by_column) for at in range(0, shape[0], max(1, step))]
        return out

    def read(self, part: Rows) -> Iterator[pa.RecordBatch]:
        files, _ = located(self.path)
        dtype = np.dtype(part.dtype)
        step = part.n if part.by_column else max(1, HELD // max(1, part.width * dtype.itemsize))
        with files.open_input_file(part.path) as f:
            for at in range(0, part.n, max(1, step)):
                n = min(step, part.n - at)
                f.seek(part.offset + (part.first + at) * part.width * dtype.itemsize)
                x = np.frombuffer(f.read(n * part.width * dtype.itemsize), dtype)
                if part.by_column:
                    x = x.reshape(part.shape, order="F")
                row = pa.array(np.arange(part.first + at, part.first + at + n))
                if self.texts:
                    values = [v.decode() if isinstance(v, bytes) else v for v in x.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), row, pa.array(values, pa.string())], names=["file", "row", "value"])
                    continue
                x = np.ascontiguousarray(x.reshape(n, part.width), np.float32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int64) * part.width, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([part.path] * n), row, lists], names=["file", "row", "features"])


@dataclass
class Attempt(WriterCommitMessage):
    name: str | None


class StagedWriter(DataSourceWriter):
    """Each attempt of a task writes to a folder of its own; the commit lists the attempts that count, and no other file is ever seen.

    What the attempts wrote is then moved into place by tasks (:func:`settle`), as often as need be.
    """

    def __init__(self, folder: str, job: str):
        self.folder, self.job = folder, job

    def files(self, rows: Iterator, attempt: str) -> Iterator[tuple[str, bytes]]:
        """Names and contents of the files that some rows make."""
        raise NotImplementedError

    def write(self, rows: Iterator) -> Attempt:
        files, base = located(self.folder)
        name, wrote = uuid.uuid4().hex, False
        for path, content in self.files(rows, name):
            target = f"{base}/_staged-{self.job}/{name}/{path}"
            files.create_dir(target.rpartition("/")[0], recursive=True)
            with files.open_output_stream(target) as out:
                out.write(content)
            wrote = True
        return Attempt(name if wrote else None)

    def commit(self, messages: list[Attempt | None]) -> None:
        files, base = located(self.folder)
        names = sorted(m.name for m in messages if m is not None and m.name)
        files.create_dir(f"{base}/_staged-{self.job}", recursive=True)
        with files.open_output_stream(f"{base}/_staged-{self.job}/{COMMITTED}.part") as out:
            out.write(json.dumps(names).encode())
        files.move(f"{base}/_staged-{self.job}/{COMMITTED}.part", f"{base}/_staged-{self.job}/{COMMITTED}")

    def abort(self, messages: list[Attempt | None]) -> None:
        files, base = located(self.folder)
        if files.get_file_info(f"{base}/_staged-{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{base}/_staged-{self.job}")


def settle(spark: SparkSession, folder: str, job: str) -> None:
    """Move the files of a job's committed attempts into place, in tasks; files that stand there are replaced."""
    files, base = located(folder)
    staged = f"{base}/_staged-{job}"
    with files.open_input_stream(f"{staged}/{COMMITTED}") as f:
        names = json.loads(f.read())

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, _ = located(folder)
        for frame in frames:
            moved = []
            for name in frame["name"]:
                top = f"{staged}/{name}"
                # an attempt that was moved before has gone
                found = files.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=True))
                for path in (f.path for f in found if f.type == fs.FileType.File):
                    target = f"{base}/{path[path.index(f'/{name}/') + len(name) + 2 :]}"
                    files.create_dir(target.rpartition("/")[0], recursive=True)
                    files.move(path, target)
                    moved.append(target)
            yield pd.DataFrame({"n": [len(moved)]})

    attempts = spark.createDataFrame([(n,) for n in names], "name string").repartition(max(1, min(len(names), 512)))
    attempts.mapInPandas(move, "n long").agg(F.sum("n")).collect()
    files.delete_dir(staged)


class NpyWriter(StagedWriter):
    """Vectors as .npy files of at most ``FILE_ROWS`` rows, and beside each a table of what its rows stand for."""

    def files(self, rows: Iterator, attempt: str) -> Iterator[tuple[str, bytes]]:
        keys, vectors, number = [], [], 0
        for row in rows:
            keys.append(row[0])
            vectors.append(row[1])
            if len(keys) == FILE_ROWS:
                yield from self.pair(f"{attempt}-{number:04d}", keys, vectors)
                keys, vectors, number = [], [], number + 1
        if keys:
            yield from self.pair(f"{attempt}-{number:04d}", keys, vectors)

    def pair(self, name: str, keys: list, vectors: list) -> Iterator[tuple[str, bytes]]:
        out = pa.BufferOutputStream()
        np.save(out, np.asarray(vectors, np.float32), allow_pickle=False)
        yield f"part-{name}.npy", out.getvalue().to_pybytes()
        out = pa.BufferOutputStream()
        pq.write_table(pa.table({"file": [f"part-{name}.npy"] * len(keys), "row": pa.array(range(len(keys)), pa.int64()), "key": keys}), out)
        yield f"index/part-{name}.parquet", out.getvalue().to_pybytes()


class Npy(DataSource):
    """Format ``npy``: (file, row, features) of the .npy files at a path, or (file, row, value) with the option texts; (key, features) are written."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "file string, row long, " + ("value string" if self.texts() else "features array<float>")

    def texts(self) -> bool:
        return self.options.get("texts", "false") == "true"

    def reader(self, schema) -> NpyReader:
        return NpyReader(self.options["path"], int(self.options.get("range", RANGE)), self.texts())

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter(self.options["path"], self.options["job"])


def read_matrix(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, row, features) of the .npy matrices at a path, read by ranges of ``size`` bytes; objects are never unpickled.

    Arrays of more dimensions are rows by their first. A matrix that lies column by column is one range.
    """
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("range", size).load(path)


def read_texts(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """(file, row, value) of .npy arrays of texts, such as group ids; arrays of objects are refused, as they would have to be unpickled."""
    spark.dataSource.register(Npy)
    return spark.read.format("npy").option("range", size).option("texts", "true").load(path)


def write_matrices(df: DataFrame, folder: str, key: str, features: str) -> DataFrame:
    """The vectors as .npy files below ``folder``; returns (file, row, key), what each row of each file stands for.

    Rows of a partition are in the order of their keys. Vectors have one length;
    nulls are left out. Failed and repeated tasks leave nothing: only what the job commits is moved into place.
    """
    spark, job = df.sparkSession, uuid.uuid4().hex
    spark.dataSource.register(Npy)
    rows = df.where(F.col(features).isNotNull()).select(F.col(key).alias("key"), F.col(features).cast("array<float>").alias("features")).sortWithinPartitions("key")
    rows.write.format("npy").mode("append").option("job", job).save(folder)
    settle(spark, folder, job)
    schema = f"file string, row long, key {rows.schema['key'].dataType.simpleString()}"
    if located(folder)[0].get_file_info(f"{located(folder)[1]}/index").type == fs.FileType.NotFound:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/index")
