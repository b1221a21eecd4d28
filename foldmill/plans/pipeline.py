"""The stages of the pipeline, their order, and a command line.

    python -m foldmill.plans.pipeline --root DATA --out OUT --stage all
"""

from __future__ import annotations

import argparse
import hashlib
import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import reduce
from importlib import import_module

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions.text import file_name, join_fields, strip_terms
from foldmill.operators import align, encoders, folds, images, manifest, metrics, nested, pooling, stats
from foldmill.schema import Config, name_of
from foldmill.sources import readers, sinks
from foldmill.terms import DIAGNOSIS_TERMS


@dataclass
class Run:
    """A session, where things are, and the configuration."""

    spark: SparkSession
    root: str
    out: str
    config: Config = field(default_factory=Config)
    csv: str | None = None
    reports: str | None = None
    report_columns: tuple[str, str, tuple[str, ...]] = ("clinical_history_number", "source_diagnosis", ("diagnostic_summary_english", "macroscopic_description_english"))
    strip_rules: tuple[str, ...] = DIAGNOSIS_TERMS
    model: str = "frozen"
    #: A folder with a folder of checkpoints for each fold, and what loads one: then each test fold has vectors of its own model.
    checkpoints: str | None = None
    load_encoder: Callable[[str], Callable] | None = None

    def path(self, name: str) -> str:
        return f"{self.out}/{self.model}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def fingerprint(self, stage: str) -> str:
        told = json.dumps([stage, self.root, self.csv, self.reports, self.strip_rules, self.checkpoints, asdict(self.config)], sort_keys=True)
        return hashlib.sha256(told.encode()).hexdigest()[:16]


def prepare(run: Run) -> DataFrame:
    """Manifest with folds by patient; leaks are an error."""
    rows = readers.scan_dataset(run.spark, run.root, run.csv, run.config.classes).drop("fold")
    assigned = folds.assign_folds(rows, folds.group_folds(rows, "patient_id", "label", run.config.n_folds, run.config.seed), "patient_id")
    folds.check_folds(assigned, "patient_id")
    return assigned


def segment(run: Run) -> DataFrame:
    """Crops of the manifest's images; :func:`crop_files` puts them below crops/, by diagnosis and patient folder."""
    side, folder = run.config.image_side, run.path("crops")
    wanted = run.read("prepare").groupBy(F.col("image_path").alias("origin")).agg(F.min(F.concat_ws("/", "diagnosis", "folder_name")).alias("place"))
    found = readers.read_images(run.spark, run.root).join(wanted.select("origin"), "origin", "left_semi")
    crops = images.segment_images(found, margin=run.config.margin, side=side).join(wanted, "origin")
    named = crops.withColumn("file", F.when(F.col("readable"), F.concat("place", F.lit("/"), file_name(F.col("origin")), F.lit(".png")))).drop("place")
    return named.withColumn("segmented_path", readers.plain_path(F.concat(F.lit(f"{folder}/"), "file")))


def crop_files(run: Run) -> None:
    """The crops of the written table as files."""
    sinks.write_images(run.read("segment"), run.path("crops"), run.config.image_side, run.config.image_side)


def montage(run: Run, n: int = 20) -> DataFrame:
    """Image, mask and crop side by side for ``n`` images of the manifest, the same in every run."""
    some = manifest.sample(run.read("prepare").select(F.col("image_path").alias("origin")).distinct(), "origin", n, run.config.seed)
    found = readers.read_images(run.spark, run.root).join(some, "origin", "left_semi")
    return images.montage(found, margin=run.config.margin, side=run.config.image_side)


def make_csv(run: Run) -> DataFrame:
    """A row for each image and test fold, with its split; the crop stands for the image where its file is there."""
    crops = run.read("segment").where("segmented_path is not null").select(F.col("origin").alias("image_path"), "segmented_path")
    rows = run.read("prepare").drop("segmented_path").join(crops, "image_path", "left")
    if not crops.isEmpty():
        rows = manifest.choose_images(rows, readers.list_files(run.spark, run.path("crops")))
    else:
        rows = rows.withColumn("image", F.col("image_path"))
    return folds.split_table(rows, run.config.n_folds).select("image", "label", "split", "test_fold")


def extract(run: Run) -> DataFrame:
    """Vectors of the crops, pooled by patient and diagnosis.

    One encoder serves all test folds (test_fold is null), or, with
    ``run.checkpoints``, each test fold has the vectors of its own checkpoint; folds without one are left out.
    """
    crops, rows, c = run.read("segment").where("readable"), run.read("prepare"), run.config

    def seen(data: bytes) -> np.ndarray:
        image = np.frombuffer(data, np.uint8).reshape(c.image_side, c.image_side, 3)
        return images.evaluation_input(image, c.mean, c.std, c.resize_side, c.image_side)

    def pooled(make: Callable, test_fold: int | None) -> DataFrame:
        def load():
            encode = make()
            return lambda data: encode(np.stack([seen(x) for x in data]))

        vectors = crops.withColumn("features", encoders.model_column(load, F.col("data"), encoders.IMAGE_BATCH)).select(F.col("origin").alias("image_path"), "features")
        return pooling.pool_patients(rows.join(vectors, "image_path")).withColumn("test_fold", F.lit(test_fold).cast("int"))

    if not run.checkpoints:
        return pooled(encoders.stub_image_encoder(), None)
    parts = []
    for k in range(run.config.n_folds):
        try:
            found = readers.find_checkpoint(run.spark, f"{run.checkpoints}/results_fold{k}")
        except (FileNotFoundError, AnalysisException):
            continue
        parts.append(pooled(run.load_encoder(found), k))
    if not parts:
        raise FileNotFoundError(f"no checkpoint of any fold in {run.checkpoints}")
    return reduce(DataFrame.unionByName, parts)


def clinical(run: Run) -> DataFrame:
    """Cleaned reports and their vectors by the default text encoder."""
    id_col, label_col, text_cols = run.report_columns
    raw = readers.read_reports(run.spark, run.reports, id_col, label_col, text_cols)
    cleaned = raw.select("patient_id", F.col("label").alias("source_label"), strip_terms(join_fields(*[F.col(c) for c in text_cols]), run.strip_rules).alias("full_report"))
    return encoders.hashed_text(cleaned, "full_report", "text_features", 128)


def fusion(run: Run) -> DataFrame:
    """Predictions from both modalities under nested cross-validation."""
    both = align.align(run.read("extract"), run.read("clinical").select("patient_id", "text_features"))
    codes = [code for _, code, _ in run.config.classes]

    def crossed(rows: DataFrame, test_folds: list[int] | None) -> DataFrame:
        c = run.config
        return nested.nested_cv(rows, "group_id", ["features", "text_features"], "label", codes, c.n_folds, c.components, c.costs, c.inner_folds, f"fusion_{run.model}", test_folds)

    if not run.checkpoints:
        return crossed(both, None)
    own = sorted(r["test_fold"] for r in both.select("test_fold").distinct().collect())  # a row a fold
    return reduce(DataFrame.unionByName, [crossed(both.where(F.col("test_fold") == k), [k]) for k in own])


def fold_metrics(run: Run) -> DataFrame:
    """(model, fold, class, metric, value): the scores of each fold, and those of each class (by name) within it."""
    pred, by = run.read("fusion"), ["model", "fold"]
    codes = [code for _, code, _ in run.config.classes]
    matrix = metrics.confusion(pred, codes, by)
    auc = metrics.roc_auc(metrics.one_vs_rest(pred, codes), [*by, "class"])
    wide = metrics.scalar_scores(matrix, by).join(metrics.macro_auc(auc, by), by)
    whole = metrics.long_format(wide, by, ["accuracy", "balanced_accuracy", "kappa", "macro_f1", "macro_auc"]).withColumn("class", F.lit(None).cast("string"))
    scores = metrics.class_scores(matrix, by).select(*by, "class", "f1").join(auc.select(*by, "class", "auc"), [*by, "class"], "left")
    named = scores.withColumn("class", name_of(F.col("class"), run.config.classes))
    return whole.unionByName(metrics.long_format(named, [*by, "class"], ["f1", "auc"]))


def evaluate(run: Run) -> DataFrame:
    """Scores by fold, summarised over folds: of all classes together (class null) and of each."""
    return stats.fold_summary(fold_metrics(run), ["model", "class", "metric"])


STAGES: dict[str, Callable[[Run], DataFrame]] = {
    "prepare": prepare, "segment": segment, "montage": montage, "make_csv": make_csv, "extract": extract, "clinical": clinical, "fusion": fusion, "evaluate": evaluate,
}


#: What is done once a stage's table is written.
THEN: dict[str, Callable[[Run], None]] = {"segment": crop_files}


def marker(run: Run, stage: str):
    path = run.spark._jvm.org.apache.hadoop.fs.Path(f"{run.path(stage)}/_made_{run.fingerprint(stage)}")
    return path.getFileSystem(run.spark._jsc.hadoopConfiguration()), path


def run_stage(run: Run, stage: str, skip_existing: bool = False) -> float:
    """Run a stage and write its table; skipped only if it was written by the same configuration.  Returns seconds."""
    files, made = marker(run, stage)
    if skip_existing and files.exists(made):
        return 0.0
    began = time.time()
    sinks.write_table(STAGES[stage](run), run.path(stage))
    if stage in THEN:
        THEN[stage](run)
    files.create(made).close()
    return time.time() - began


def run_all(run: Run, stages: list[str] | None = None, skip_existing: bool = False) -> dict[str, float]:
    return {s: run_stage(run, s, skip_existing) for s in stages or list(STAGES)}


def main(argv: list[str] | None = None) -> dict[str, float]:
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("--root", required=True)
    parser.add_argument("--out", required=True)
    parser.add_argument("--csv")
    parser.add_argument("--reports")
    parser.add_argument("--model", default="frozen")
    parser.add_argument("--strip-rules", help="a file of patterns, one a line, in place of the built-in terms")
    parser.add_argument("--checkpoints", help="a folder with a folder of checkpoints for each fold; needs --encoder")
    parser.add_argument("--encoder", help="module:function that takes a checkpoint's path and gives what loads its encoder in a task")
    parser.add_argument("--stage", default="all", choices=["all", *STAGES])
    parser.add_argument("--skip-existing", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("foldmill").getOrCreate()
    rules = tuple(r["value"] for r in spark.read.text(args.strip_rules).collect() if r["value"]) if args.strip_rules else DIAGNOSIS_TERMS  # as long as the file
    if bool(args.checkpoints) != bool(args.encoder):
        parser.error("--checkpoints and --encoder go together")
    load = None
    if args.encoder:
        module, _, name = args.encoder.partition(":")
        load = getattr(import_module(module), name)
    run = Run(spark, args.root, args.out, csv=args.csv, reports=args.reports, model=args.model, strip_rules=rules, checkpoints=args.checkpoints, load_encoder=load)
    stages = list(STAGES) if args.stage == "all" else [args.stage]
    if not args.reports:
        stages = [s for s in stages if s not in ("clinical", "fusion", "evaluate")]
    took = run_all(run, stages, args.skip_existing)
    for stage, seconds in took.items():
        print(f"{stage}: {seconds:.1f} s")
    return took


if __name__ == "__main__":
    main()
