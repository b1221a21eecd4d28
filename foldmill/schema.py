"""Schemas of the library's tables, the class dictionary and the configuration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The classes with their codes and names, in order.
CLASSES = (("DN", 0, "Dysplastic Nevus"), ("MIA", 1, "Melanoma Stage IA"), ("Minsitu", 2, "Melanoma In Situ"))
#: Extensions of image files, in any case.
EXTENSIONS = ("jpg", "jpeg", "png", "bmp", "tif", "tiff")
#: Names of the checkpoints to prefer, in order, and the form of numbered ones.
PREFERRED_CHECKPOINTS = ("checkpoint-best.pth", "best.pth")
NUMBERED_CHECKPOINT = r"^checkpoint-\d+\.pth$"

FLAT_METADATA = "isic_id string, lesion_id string, label string"
MANIFEST = "image_path string, patient_id string, folder_name string, diagnosis string, label int, fold int, segmented_path string"
SPLITS = "image string, label int, split string, test_fold int"
REPORTS = "patient_id string, label string, full_report string, n_chars int"
VECTORS = "row_id string, group_id string, patient_id string, diagnosis string, label int, fold int, features array<float>"
PREDICTIONS = "model string, fold int, row_id string, y_true int, y_pred int, proba array<double>"
METRICS = "model string, fold int, class string, metric string, value double"


@dataclass(frozen=True)
class Config:
    """What the stages need to know; passed on explicitly.  The defaults are fixed values of the reference."""

    n_folds: int = 5
    inner_folds: int = 3
    seed: int = 42
    classes: tuple[tuple[str, int, str], ...] = CLASSES
    extensions: tuple[str, ...] = EXTENSIONS
    costs: tuple[float, ...] = (0.01, 0.03, 0.1, 0.3, 1.0)
    components: int = 8
    neighbours: int = 5
    permutations: int = 100
    least_area: float = 0.01
    margin: float = 0.1
    closing: int = 15
    image_side: int = 224
    resize_side: int = 256
    mean: tuple[float, ...] = (0.485, 0.456, 0.406)
    std: tuple[float, ...] = (0.228, 0.224, 0.225)


def class_table(spark: SparkSession, classes: tuple[tuple[str, int, str], ...] = CLASSES) -> DataFrame:
    """The class dictionary as a table of a few rows: diagnosis, label, display."""
    return spark.createDataFrame([tuple(c) for c in classes], "diagnosis string, label int, display string")


def label_of(diagnosis: Column, classes: tuple[tuple[str, int, str], ...] = CLASSES) -> Column:
    """Code of a class name; null for unknown names."""
    pairs = [x for name, code, _ in classes for x in (F.lit(name), F.lit(code))]
    return F.create_map(*pairs)[diagnosis]


def name_of(label: Column, classes: tuple[tuple[str, int, str], ...] = CLASSES, display: bool = False) -> Column:
    """Name of a class code; null for unknown codes."""
    pairs = [x for name, code, shown in classes for x in (F.lit(code), F.lit(shown if display else name))]
    return F.create_map(*pairs)[label]
