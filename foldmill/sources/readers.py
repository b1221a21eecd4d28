"""Readers: manifests, folder trees, reports, vectors, images, checkpoints."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from itertools import islice
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldmill.functions.text import extension, file_name, first_token, identifier, missing_as_null, parent, whole_number
from foldmill.operators.manifest import latest
from foldmill.schema import CLASSES, EXTENSIONS, FLAT_METADATA, MANIFEST, NUMBERED_CHECKPOINT, PREFERRED_CHECKPOINTS, label_of


def plain_path(path: Column) -> Column:
    """Paths of the binary and image sources alike: no scheme, blanks as they are, "+" too."""
    bare = F.regexp_replace(path, r"^file:/+", "/")
    return F.when(bare.contains("%"), F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))).otherwise(bare)


def list_files(spark: SparkSession, root: str, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """(path, length) of the files below a folder with one of the extensions, in any case; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(plain_path(F.col("path")).alias("path"), "length")
    return files.where(extension(F.col("path")).isin(*extensions))


def scan_class_folders(spark: SparkSession, root: str, classes=CLASSES, extensions: Sequence[str] = EXTENSIONS) -> DataFrame:
    """Manifest of a tree class / patient folder / file, exactly two levels deep; other files are left out."""
    files = list_files(spark, root, extensions)
    deep = F.size(F.split("path", "/"))
    # relative depth: class, patient folder and file come after the root's own parts
    root_parts = len([p for p in root.replace("file://", "").replace("file:", "").split("/") if p]) + 1
    found = files.where(deep == root_parts + 3).select(F.col("path").alias("image_path"), parent(F.col("path")).alias("folder_name"), parent(F.col("path"), 2).alias("diagnosis"))
    rows = found.select("image_path", first_token(F.col("folder_name")).alias("patient_id"), "folder_name", "diagnosis", label_of(F.col("diagnosis"), classes).alias("label"))
    return rows.where(F.col("label").isNotNull()).withColumns({"fold": F.lit(None).cast("int"), "segmented_path": F.lit(None).cast("string")})


def scan_flat(spark: SparkSession, root: str, csv: str, classes=CLASSES, suffix: str = ".jpg") -> DataFrame:
    """Manifest of a flat folder described by a CSV; rows without a file or with an unknown label are left out."""
    meta = spark.read.csv(csv, header=True, schema=FLAT_METADATA)
    names = spark.createDataFrame([(code, name) for name, code, _ in classes], "label int, diagnosis string")
    known = meta.select(identifier(F.col("isic_id")).alias("row"), identifier(F.col("lesion_id")).alias("patient_id"), whole_number(F.col("label")).alias("label")).join(F.broadcast(names), "label")  # a row a class
    files = list_files(spark, root).select("path", F.regexp_replace(file_name(F.col("path")), r"\.[^.]*$", "").alias("row"))
    return known.join(files, "row").select(
        F.col("path").alias("image_path"), "patient_id", F.col("patient_id").alias("folder_name"), "diagnosis", "label",
        F.lit(None).cast("int").alias("fold"), F.lit(None).cast("string").alias("segmented_path"),
    )


def scan_dataset(spark: SparkSession, root: str, csv: str | None = None, classes=CLASSES) -> DataFrame:
    """The manifest of a folder: described by a CSV if one is given, else by its tree."""
    return scan_flat(spark, root, csv, classes) if csv else scan_class_folders(spark, root, classes)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest from CSV, ids as text whatever they look like; absent columns are null."""
    return by_name(spark, path, MANIFEST)


def by_name(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A CSV with a header, its columns matched by name and cast; columns it lacks are null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"')
    fields = T.StructType.fromDDL(ddl).fields
    return raw.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in raw.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])


def read_fold_map(spark: SparkSession, path: str) -> DataFrame:
    """(group_id, fold) from CSV."""
    return by_name(spark, path, "group_id string, fold int")


def sheet_rows(content: bytes) -> Iterator[list[str | None]]:
    """The rows of a workbook's first sheet as texts, gaps filled with nulls."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared = []
        if "xl/sharedStrings.xml" in book.namelist():
            root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in item.iterfind(".//{*}t")) for item in root.iterfind("{*}si")]
        sheets = [n for n in book.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
        with book.open(min(sheets, key=lambda n: (len(n), n))) as sheet:
            for _, row in ElementTree.iterparse(sheet):
                if row.tag.rpartition("}")[2] != "row":
                    continue
                values: list[str | None] = []
                for cell in row.iterfind("{*}c"):
                    at = 0
                    for letter in re.match(r"[A-Z]*", cell.get("r", ""))[0]:
                        at = at * 26 + ord(letter) - 64
                    values += [None] * (at - 1 - len(values))
                    value = cell.findtext("{*}v")
                    if cell.get("t") == "inlineStr":
                        value = "".join(t.text or "" for t in cell.iterfind(".//{*}t"))
                    elif cell.get("t") == "s" and value is not None:
                        value = shared[int(value)]
                    values.append(value)
                row.clear()
                yield values


def read_workbooks(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """``columns``, as text, of the first sheets of the XLSX workbooks at a path; their first rows name the columns."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                rows = sheet_rows(content)
                header = next(rows, [])
                places = [header.index(c) for c in columns] if header else []
                while part := list(islice(rows, 1024)):
                    yield pd.DataFrame([[r[k] if k < len(r) else None for k in places] for r in part], columns=list(columns), dtype=object)

    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, schema)


def read_reports(spark: SparkSession, path: str, id_col: str, label_col: str, text_cols: Sequence[str]) -> DataFrame:
    """Reports, as text: an XLSX workbook, or CSV in UTF-8, or in Latin-1 if the bytes aren't UTF-8.

    NaN, NA and empty fields are null.
    """
    wanted = list(dict.fromkeys([id_col, label_col, *text_cols]))
    if path.lower().endswith(".xlsx"):
        rows = read_workbooks(spark, path, wanted)
    else:
        # lines are read as the bytes they are
        utf8 = spark.read.text(path).where(~F.is_valid_utf8("value")).isEmpty()
        rows = spark.read.csv(path, encoding="UTF-8" if utf8 else "ISO-8859-1", header=True, inferSchema=False, multiLine=True, escape='"')
    return rows.select(identifier(F.col(f"`{id_col}`")).alias("patient_id"), missing_as_null(F.col(f"`{label_col}`")).alias("label"), *[missing_as_null(F.col(f"`{c}`")).alias(c) for c in text_cols])


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(origin, height, width, nChannels, data) of the image files; an unreadable one has height -1."""
    images = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path).select("image.*")
    return images.withColumn("origin", plain_path(F.col("origin"))).where(extension(F.col("origin")).isin(*EXTENSIONS))


def find_checkpoint(spark: SparkSession, folder: str, preferred: Sequence[str] = PREFERRED_CHECKPOINTS) -> str:
    """The checkpoint to load: a preferred name, in order, else the highest number; none is an error."""
    files = spark.read.format("binaryFile").load(folder).select(plain_path(F.col("path")).alias("path"))
    name = file_name(F.col("path"))
    found = latest(files.where(name.isin(*preferred) | name.rlike(NUMBERED_CHECKPOINT)), tuple(preferred)).collect()
    if not found:
        raise FileNotFoundError(f"no checkpoint in {folder}")
    return found[0]["path"]
