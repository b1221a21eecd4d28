"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from foldmill.sources.shared import drop_table, materialise, shared_dir  # noqa: F401

#: Words are runs of anything but ASCII white space.
NON_SPACE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def map_texts(
    docs: DataFrame,
    added: str,
    start: Callable[[], Callable[[list[str | None]], dict[str, list]]],
    keep: Sequence[str] = ("doc_id",),
    most: int = 512,
) -> DataFrame:
    """The ``keep`` columns of ``docs`` beside columns made from the whole texts.

    ``start`` runs once in each task and gives a function from a list of texts
    (``most`` at a time) to the lists of the ``added`` columns.  Kept columns
    pass through as they are, nulls and large numbers too.
    """
    source = docs.select(*keep, "text")
    new = T.StructType.fromDDL(added)
    schema = T.StructType([source.schema[c] for c in keep] + new.fields)
    types = {f.name: to_arrow_type(f.dataType) for f in new.fields}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = start()
        for part in parts:
            for at in range(0, part.num_rows, most):
                rows = part.slice(at, most)
                made = make(rows.column("text").to_pylist())
                arrays = [rows.column(c) for c in keep] + [pa.array(made[n], t) for n, t in types.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=[*keep, *types])

    return source.mapInArrow(run, schema)


def filter_texts(docs: DataFrame, start: Callable[[], Callable[[list[str | None]], list[bool]]], most: int = 512) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts the function holds for."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds = start()
        for part in parts:
            for at in range(0, part.num_rows, most):
                rows = part.slice(at, most)
                yield rows.filter(pa.array(holds(rows.column("text").to_pylist()), pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def batches(frames: Iterator, most: int) -> Iterator:
    """Cut the frames that ``mapInPandas`` hands over into pieces of at most ``most`` rows."""
    for frame in frames:
        for at in range(0, len(frame), most):
            yield frame.iloc[at : at + most]
