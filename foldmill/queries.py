"""The registered queries over the driver's tables and the SQL that says the same.

The tables play roles: documents are reports, embeddings are image vectors,
lineitem and events are rows of groups.  Pairing documents with embeddings by
number is an invention for the sake of a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldmill.functions import text as tx
from foldmill.functions import vectors as vec
from foldmill.operators import align, encoders, folds, graph, layout, manifest, metrics, nested, pooling, similarity, stats
from foldmill.sources import sinks

#: 0.975 quantile of Student's t with 4 degrees of freedom, for the SQL.
T_4 = "2.7764451051977987"
#: Rules of the clean-up query: they hit the driver's texts and mean the same in both regular-expression dialects.
RULES = (r"licen[cs]ed under[^.]*", r"password[=: ]+[a-z0-9]*", r"[0-9]+(\.[0-9]+)*", r"!{2,}", r"[#$%&*]{3}", r"(stupid|idiot|loser)")
LANGS = ("de", "en", "es", "fr")
LABELS = tuple(range(10))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def aligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("patient_id"), "lang")
    images = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("patient_id"), "label")
    return align.align(images, texts)


def folded_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.stratified_folds(table(spark, sf_dir, "embeddings"), "vec_id", "label")


def predictions(spark: SparkSession, sf_dir: str, k: int = 5, near: DataFrame | None = None) -> DataFrame:
    """Leave-one-out predictions of the vectors with their folds; ``near`` are at least ``k`` neighbours of each, found before."""
    rows = folded_vectors(spark, sf_dir)
    near = similarity.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k) if near is None else near.where(F.col("rank") <= k)
    pred = similarity.knn_predictions(rows, "vec_id", "embedding", "label", k, near)
    return pred.join(rows.select("vec_id", "fold"), "vec_id")


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")


def align_fold_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two modalities joined by key, folded within class, counted by fold and class."""
    rows = folds.stratified_folds(aligned(spark, sf_dir), "patient_id", "lang")
    return rows.groupBy("fold", "lang").agg(F.count("*").alias("n"))


def group_majority_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.majority_label(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def stratified_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.group_folds(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def balanced_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class in each fold, when groups are folded by their class profiles."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    placed = folds.balanced_group_folds(rows, "l_orderkey", "l_returnflag")
    return folds.assign_folds(rows, placed, "l_orderkey").groupBy("fold", "l_returnflag").agg(F.count("*").alias("n"))


def greedy_group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By class: rows, groups, and whether its rows by fold differ by less than two of its largest groups."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    placed = folds.assign_folds(rows, folds.greedy_group_folds(rows, "l_orderkey", "l_returnflag"), "l_orderkey")
    by_group = placed.groupBy("l_returnflag", "l_orderkey", "fold").agg(F.count("*").alias("n"))
    by_fold = by_group.groupBy("l_returnflag", "fold").agg(F.sum("n").alias("n"), F.count("*").alias("n_groups"), F.max("n").alias("largest"))
    even = (F.max("n") - F.min("n") < 2 * F.max("largest")) & (F.count("*") == 5)
    return by_fold.groupBy("l_returnflag").agg(F.sum("n").alias("n_rows"), F.sum("n_groups").alias("n_groups"), even.alias("even"))


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, groups and groups in several folds, by fold."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag")
    placed = folds.assign_folds(rows, folds.group_folds(rows, "l_orderkey", "l_returnflag"), "l_orderkey")
    leaks = folds.leaking_groups(placed, "l_orderkey").select("l_orderkey", F.lit(1).alias("leak"))
    by_group = placed.groupBy("fold", "l_orderkey").agg(F.count("*").alias("n")).join(leaks, "l_orderkey", "left")
    return by_group.groupBy("fold").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_groups"), F.count("leak").alias("n_leaking"))


def split_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = folds.stratified_folds(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", "lang")
    return folds.split_table(rows).select("doc_id", "test_fold", "split")


def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.class_stats(table(spark, sf_dir, "events"), "user_id", "event_type")


def overall_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.overall_stats(table(spark, sf_dir, "events"), "user_id", "event_type")


def folded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type")
    return folds.assign_folds(rows, folds.group_folds(rows, "user_id", "event_type"), "user_id")


def fold_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.fold_class_counts(folded_events(spark, sf_dir), "user_id", "event_type")


def multiclass_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.groups_of_several_classes(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag")


def label_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.frequencies(table(spark, sf_dir, "lineitem"), "l_returnflag", ["A", "N", "R", "X"])


def vector_mean_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = pooling.mean_pool(table(spark, sf_dir, "embeddings"), ["label"], "embedding")
    return rounded(pooled.select("label", "n_rows", F.posexplode("embedding").alias("pos", "value")), 6, "value")


def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector as four tokens of 16 numbers, every third token masked."""
    tokens = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.slice("embedding", i * 16 + 1, 16))
    mask = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: ((F.col("vec_id") + i) % 3 > 0).cast("int"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vec.masked_mean(tokens, mask)).alias("pos", "value"))
    return rounded(rows, 6, "value")


def vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    scaled = vec.min_max(vec.doubles(e))
    weights = vec.softmax(vec.doubles(e))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", vec.norm(e).alias("norm"), vec.argmax(e).alias("argmax"), vec.total(scaled).alias("scaled_sum"), F.array_max(weights).alias("top_weight"), vec.cosine(e, F.reverse(e)).alias("with_reverse"))
    return rounded(rows, 6, "norm", "scaled_sum", "top_weight", "with_reverse")


def text_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", tx.strip_terms(F.col("text"), RULES).alias("cleaned"))


def text_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.length_stats(table(spark, sf_dir, "documents"), "text", ["lang"]), 6, "mean", "std")


def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two fields joined, one of them sometimes missing, and the parts of a composite key."""
    docs = table(spark, sf_dir, "documents")
    second = F.when(F.col("doc_id") % 3 > 0, F.col("source"))
    key = tx.composite_key(F.col("source"), F.col("lang"))
    return docs.select("doc_id", tx.join_fields(F.col("lang"), second, sep=" / ").alias("joined"), key.alias("key"), tx.key_part(key, 1).alias("part"), tx.first_token(F.col("text")).alias("first"))


def label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels as codes in alphabetical order, and as indicators."""
    from pyspark.sql import Window

    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    codes = docs.select("lang").distinct().withColumn("code", F.row_number().over(Window.orderBy("lang")) - 1)  # a row a class
    hot = vec.one_hot(F.col("code"), len(LANGS))
    return docs.join(codes, "lang").select("doc_id", "lang", "code", *[F.get(hot, F.lit(k)).alias(f"is_{name}") for k, name in enumerate(LANGS)])


def class_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.class_cohesion(table(spark, sf_dir, "embeddings"), "embedding", "label")
    return rounded(found, 8, *found.columns)


def knn_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = similarity.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rounded(near, 6, "similarity")


def knn_loo_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predictions(spark, sf_dir).select("vec_id", "fold", "y_true", "y_pred")


def knn_loo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    pred = predictions(spark, sf_dir)
    return pred.agg(F.round(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")), 9).alias("accuracy"), F.round(1.0 / F.countDistinct("y_true"), 9).alias("chance"))


def permutation_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.permutation_test(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label").select("perm", "n_correct")


def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similarity.permutation_p(similarity.permutation_test(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label"))
    return rounded(found, 9, *found.columns)


def fold_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(predictions(spark, sf_dir), LABELS, ["fold"])


def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold_confusion(spark, sf_dir)


def confusion_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.normalised(metrics.summed(fold_confusion(spark, sf_dir))), 9, "share")


def class_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.class_scores(fold_confusion(spark, sf_dir), ["fold"]).drop("hit", "called")
    return rounded(found, 9, "precision", "recall", "f1")


def scalar_metrics_by_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.scalar_scores(fold_confusion(spark, sf_dir), ["fold"])
    return rounded(found, 9, "accuracy", "balanced_accuracy", "kappa", "macro_f1")


def fold_summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = metrics.scalar_scores(fold_confusion(spark, sf_dir), ["fold"])
    found = stats.fold_summary(metrics.long_format(wide, ["fold"], ["accuracy", "balanced_accuracy", "kappa", "macro_f1"]), ["metric"])
    return rounded(found, 7, "mean", "std", "ci_lo", "ci_hi")


def paired_t_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy by fold of five neighbours against one, which is the first of the five."""
    parts, near = None, similarity.neighbours(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    for k in (1, 5):
        wide = metrics.scalar_scores(metrics.confusion(predictions(spark, sf_dir, k, near), LABELS, ["fold"]), ["fold"])
        part = metrics.long_format(wide, ["fold"], ["accuracy"]).withColumn("model", F.lit(f"k{k}"))
        parts = part if parts is None else parts.unionByName(part)
    return rounded(stats.paired_t(parts, "k5", "k1"), 7, "delta", "ci_lo", "ci_hi", "t", "p")


def spearman_length_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.spearman(labelled_documents(spark, sf_dir), "n_chars", "quality"), 9, "rho", "p")


def shared_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that rows folded without regard to them put both into test fold 0 and outside it."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row"))
    return folds.shared_groups(folds.stratified_folds(rows, "row", "l_returnflag"), "l_orderkey", 0)


def fold_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.fold_map(folded_events(spark, sf_dir).withColumnRenamed("user_id", "group_id"))


def wide_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a fold, the scores of the first three classes beside the scalars."""
    matrix = fold_confusion(spark, sf_dir)
    whole = metrics.long_format(metrics.scalar_scores(matrix, ["fold"]).withColumnRenamed("n", "n_test"), ["fold"], ["accuracy", "balanced_accuracy", "kappa", "macro_f1", "n_test"])
    by_class = metrics.long_format(metrics.class_scores(matrix, ["fold"]).withColumn("class", F.concat(F.lit("c"), "class")), ["fold", "class"], ["f1"])
    long = whole.withColumn("class", F.lit(None).cast("string")).unionByName(by_class).withColumn("model", F.lit("knn"))
    wide = sinks.wide_metrics(long, ["c0", "c1", "c2"], ("f1",))
    return rounded(wide, 9, *[c for c in wide.columns if c not in ("model", "fold")])


def choose_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images, every second with a crop of which labelled ones have a file."""
    crop = F.concat(F.lit("crops/"), F.col("doc_id"))
    rows = table(spark, sf_dir, "documents").select("doc_id", F.concat_ws("/", "source", "doc_id").alias("image_path"), F.when(F.col("doc_id") % 2 == 0, crop).alias("segmented_path"))
    return manifest.choose_images(rows, table(spark, sf_dir, "labels").select(crop.alias("path"))).select("doc_id", "image")


def roc_auc_ovr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text length as a score for each language against the rest."""
    docs = table(spark, sf_dir, "documents").select(F.col("n_chars").cast("double").alias("n"), "lang")
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("class"), (F.col("lang") == c).cast("int").alias("positive")) for c in LANGS]))
    rows = docs.withColumn("c", pairs).select("c.class", F.col("n").alias("score"), "c.positive")
    return rounded(metrics.roc_auc(rows, ["class"]), 9, "auc")


def roc_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_documents(spark, sf_dir).select("lang", F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("positive"))


def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.roc_points(roc_rows(spark, sf_dir), ["lang"]), 9, "fpr", "tpr")


def mean_roc(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.mean_roc(metrics.roc_points(roc_rows(spark, sf_dir), ["lang"]), [], "lang")
    return rounded(curve.select("step", "mean_tpr", "std_tpr", "n_curves"), 8, "mean_tpr", "std_tpr")


def class_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return manifest.sample_per_class(docs, "doc_id", "lang", 20).select("doc_id", "lang", "number")


def row_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.sample(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


def topk_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return manifest.largest_per_class(docs, "doc_id", "lang", "n_chars", 10)


def incremental_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return manifest.pending(docs, table(spark, sf_dir, "labels"), "doc_id")


def text_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoders.hashed_text(table(spark, sf_dir, "documents"), "text", "features", 64)
    return found.select("doc_id", "features")


def language_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, v): texts as hashed words, weighed by how rare they are."""
    found = encoders.hashed_text(table(spark, sf_dir, "documents"), "text", "v", 64)
    return found.select("doc_id", "v")


def neighbour_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbours found by improving a graph, not by comparing all pairs."""
    near = graph.neighbour_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return rounded(near, 6, "similarity")


def neighbour_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors in two dimensions, from a graph of 30 neighbours."""
    near = graph.neighbour_graph(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", k=30, exact_below=20_000, exact_scores=False)
    return layout.neighbour_layout(near.withColumnRenamed("vec_id", "id")).select(F.col("id").alias("vec_id"), "x", "y")


def attention_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vector as two heads, each with a query of four numbers and four keys: mean attention as a square of two by two."""
    e = vec.doubles(F.col("embedding"))
    queries = F.array(*[F.slice(e, 1 + 4 * h, 4) for h in (0, 1)])
    keys = F.array(*[F.array(*[F.slice(e, 9 + 16 * h + 4 * t, 4) for t in range(4)]) for h in (0, 1)])
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vec.attention_map(queries, keys)).alias("y", "line")).select("vec_id", "y", F.posexplode("line").alias("x", "weight"))
    return rounded(rows, 6, "weight")


def rows_with_group_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row with its group's majority label and the fold that the fold map has for the group."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    placed = folds.group_folds(rows, "l_orderkey", "l_returnflag").withColumnRenamed("l_returnflag", "group_label")
    folded = align.with_folds(rows, placed, "l_orderkey")
    return folded.join(placed.select("l_orderkey", "group_label"), "l_orderkey").select("l_orderkey", "l_linenumber", "group_label", "fold")


def file_path(folder: str) -> Column:
    return F.concat(F.lit(f"{folder}/"), "source", F.lit("/dermoscopy/"), "lang", F.lit("/"), F.col("doc_id"), F.lit(".PNG"))


def missing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as images: those without a file, files being what is labelled."""
    docs = table(spark, sf_dir, "documents").select("doc_id", file_path("/data").alias("image_path"))
    files = docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select(F.col("image_path").alias("path"))
    return manifest.missing_images(docs, files).select("doc_id", "image_path")


def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands before a folder, a path moved to another root, and columns that are added only where they are absent."""
    rows = table(spark, sf_dir, "documents").select("doc_id", file_path("/data").alias("path"), F.col("lang").alias("diagnosis"), F.concat(F.lit("P"), "doc_id").alias("patient_id"))
    filled = manifest.with_defaults(rows, (("de", 0, "German"), ("en", 1, "English")))
    return filled.select("doc_id", tx.before_folder(F.col("path"), "dermoscopy").alias("root"), tx.rebase(F.col("path"), F.lit("/data/"), F.lit("/moved/")).alias("moved"), tx.extension(F.col("path")).alias("extension"), F.coalesce("label", F.lit(-1)).alias("label"), "folder_name")


def length_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eleven even steps up to the longest text of each language."""
    longest = table(spark, sf_dir, "documents").groupBy("lang").agg(F.max("n_chars").alias("longest"))
    steps = longest.select("lang", "longest", F.posexplode(vec.linear_grid(11)).alias("step", "share"))
    return rounded(steps.select("lang", "step", (F.col("share") * F.col("longest")).alias("value")), 6, "value")


def class_summary_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of each class over the folds, with intervals."""
    by_class = metrics.class_scores(fold_confusion(spark, sf_dir), ["fold"])
    found = stats.fold_summary(metrics.long_format(by_class, ["fold", "class"], ["precision", "recall", "f1"]), ["class", "metric"])
    return rounded(found, 7, "mean", "std", "ci_lo", "ci_hi")


def crop_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as crops: every seventh fell back to the whole image, short ones can't be read."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") % 7 == 0).alias("fallback"), (F.col("n_chars") > 200).alias("readable"))
    return manifest.crop_counters(docs)


def two_modalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors cut in halves that stand for two modalities, folded."""
    rows = folded_vectors(spark, sf_dir)
    return rows.select("vec_id", "label", "fold", F.slice("embedding", 1, 32).alias("image"), F.slice("embedding", 33, 32).alias("report"))


def scaler_pca_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of both modalities of every row for each test fold, fitted on the other folds."""
    found = nested.fused_by_fold(two_modalities(spark, sf_dir), ["image", "report"], range(5))
    return found.select("vec_id", "fold", "test_fold", "fused")


def nested_cv_logreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested cross-validation over the five folds as dealt, with the operator's own costs and inner folds."""
    return nested.nested_cv(two_modalities(spark, sf_dir), "vec_id", ["image", "report"], "label", LABELS).select("fold", "row_id", "y_true", "y_pred", "cost")


QUERIES = {
    f.__name__: f
    for f in (
        align_fold_summary, group_majority_label, stratified_group_folds, balanced_group_folds, greedy_group_folds, leakage_check, split_table, manifest_stats,
        overall_stats, fold_class_counts, multiclass_groups, label_frequencies, vector_mean_pool, masked_mean, vector_functions, text_clean,
        text_length_stats, report_fields, label_encode, class_cohesion, knn_neighbours, knn_loo_predictions, knn_loo_accuracy,
        permutation_test, permutation_p, confusion_matrix, confusion_normalised, class_report, scalar_metrics_by_fold, fold_summary_ci,
        paired_t_models, spearman_length_label, roc_auc_ovr, roc_points, mean_roc, class_sample, row_sample, topk_per_class,
        incremental_pending, shared_groups, fold_map, wide_metrics, choose_images, text_encoder, scaler_pca_fusion, nested_cv_logreg,
        neighbour_graph, neighbour_layout, attention_map, rows_with_group_labels, missing_images, path_parts, length_grid, class_summary_ci,
        crop_counters,
    )
}


#: Two-sided p of Student's t with 4 degrees of freedom.
_P_4 = "1 - abs({t}) / sqrt(4 + {t} ** 2) * (3 - {t} ** 2 / (4 + {t} ** 2)) / 2"


def _sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + body if parts else body


def _recursive(body: str, *parts: str) -> str:
    return _sql(body, *parts).replace("WITH ", "WITH RECURSIVE ", 1)


def _fold(key: str, label: str, n: int = 5) -> str:
    return f"CAST((row_number() OVER (PARTITION BY {label} ORDER BY md5(CAST({key} AS VARCHAR) || '_42'), {key}) - 1) % {n} AS INT)"


_MAJORITY = "major AS (SELECT l_orderkey, l_returnflag FROM (SELECT l_orderkey, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS r FROM lineitem GROUP BY l_orderkey, l_returnflag) WHERE r = 1)"
_ORDER_FOLDS = f"placed AS (SELECT l_orderkey, l_returnflag, {_fold('l_orderkey', 'l_returnflag')} AS fold FROM major)"
_EVENT_FOLDS = f"major AS (SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1), placed AS (SELECT user_id, {_fold('user_id', 'event_type')} AS fold FROM major), rows AS (SELECT e.user_id, e.event_type, fold FROM events e JOIN placed USING (user_id))"
_E = "e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_FOLDED = f"folded AS (SELECT vec_id, {_fold('vec_id', 'label')} AS fold FROM embeddings)"


def _near(k: int = 5) -> str:
    sim = "round(list_cosine_similarity(a.v, b.v), 9)"
    return f"near AS (SELECT * FROM (SELECT a.vec_id, b.vec_id AS neighbour, b.label AS nl, {sim} AS similarity, CAST(row_number() OVER (PARTITION BY a.vec_id ORDER BY {sim} DESC, b.vec_id) AS INT) AS rank FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE rank <= {k})"


_PRED = "pred AS (SELECT p.vec_id, fold, e.label AS y_true, p.nl AS y_pred FROM (SELECT vec_id, nl, row_number() OVER (PARTITION BY vec_id ORDER BY count(*) DESC, nl) AS r FROM near GROUP BY vec_id, nl) p JOIN e USING (vec_id) JOIN folded USING (vec_id) WHERE r = 1)"
_KNN = (_E, _FOLDED, _near(), _PRED)
_GRID = "conf AS (SELECT f.fold, CAST(t.i AS INT) AS y_true, CAST(q.i AS INT) AS y_pred, count(p.vec_id) AS n FROM (SELECT DISTINCT fold FROM pred) f CROSS JOIN range(10) t(i) CROSS JOIN range(10) q(i) LEFT JOIN pred p ON p.fold = f.fold AND p.y_true = t.i AND p.y_pred = q.i GROUP BY f.fold, t.i, q.i)"
_SCORES = """scores AS (SELECT r.fold, r.class, support, hit, called, CASE WHEN called = 0 THEN 0 ELSE hit / CAST(called AS DOUBLE) END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / CAST(support AS DOUBLE) END AS recall, CASE WHEN support + called = 0 THEN 0 ELSE 2 * hit / CAST(support + called AS DOUBLE) END AS f1
  FROM (SELECT fold, y_true AS class, CAST(sum(n) AS BIGINT) AS support, CAST(sum(n) FILTER (WHERE y_true = y_pred) AS BIGINT) AS hit FROM conf GROUP BY fold, y_true) r
  JOIN (SELECT fold, y_pred AS class, CAST(sum(n) AS BIGINT) AS called FROM conf GROUP BY fold, y_pred) c ON r.fold = c.fold AND r.class = c.class)"""
_SCALARS = """scalars AS (SELECT fold, n, accuracy, balanced_accuracy, (accuracy - pe) / nullif(1 - pe, 0) AS kappa, macro_f1 FROM (
  SELECT fold, CAST(sum(support) AS BIGINT) AS n, sum(hit) / CAST(sum(support) AS DOUBLE) AS accuracy, avg(recall) FILTER (WHERE support > 0) AS balanced_accuracy, sum(support * called) / (CAST(sum(support) AS DOUBLE) * sum(support)) AS pe, avg(f1) AS macro_f1 FROM scores GROUP BY fold))"""
_LABELLED = "rows AS (SELECT d.doc_id, d.lang, CAST(d.n_chars AS DOUBLE) AS score, l.quality AS positive FROM documents d JOIN labels l USING (doc_id))"
_ROC = """counts AS (SELECT lang, score, sum(positive) AS p, sum(1 - positive) AS q FROM rows WHERE score IS NOT NULL GROUP BY lang, score),
totals AS (SELECT lang, sum(p) AS all_p, sum(q) AS all_q FROM counts GROUP BY lang HAVING sum(p) > 0 AND sum(q) > 0),
points AS (SELECT c.lang, c.score, CAST(sum(q) OVER w AS DOUBLE) / all_q AS fpr, CAST(sum(p) OVER w AS DOUBLE) / all_p AS tpr FROM counts c JOIN totals t ON c.lang = t.lang WINDOW w AS (PARTITION BY c.lang ORDER BY c.score DESC)
  UNION ALL SELECT lang, NULL, 0.0, 0.0 FROM totals)"""
_SPEARMAN = """ranked AS (SELECT rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY positive) + (count(*) OVER (PARTITION BY positive) - 1) / 2.0 AS rb FROM rows WHERE score IS NOT NULL AND positive IS NOT NULL),
sides AS (SELECT n, rho, n - 2 AS nu, abs(rho) AS sine FROM (SELECT count(*) AS n, corr(ra, rb) AS rho FROM ranked))"""


def _shuffled() -> str:
    """Places that the bijection sends each place to, by shuffle: halves of the bits through four rounds, again while beyond n."""
    digit = "CAST('0x' || substr(md5('42_' || i || '_{r}_{what}'), 1, 7) AS BIGINT) + 1"
    keys = ", ".join(f"{digit.format(r=r, what=what)} AS {name}{r}" for r in range(4) for name, what in (("f", "a"), ("t", "b")))
    step = "SELECT perm, vec_id, n, bits, mask, spot >> bits AS l, spot & mask AS r, " + ", ".join(f"f{r}, t{r}" for r in range(4)) + " FROM walk JOIN keys USING (perm) CROSS JOIN size WHERE step = 0 OR spot >= n"
    for r in range(4):
        step = f"SELECT * EXCLUDE (h) REPLACE (r AS l, xor(l, ((h * h + r) % 2147483647) & mask) AS r) FROM (SELECT *, (r * f{r} + t{r}) % 2147483647 AS h FROM ({step}))"
    return f"""size AS (SELECT *, (CAST(1 AS BIGINT) << bits) - 1 AS mask FROM (SELECT count(*) AS n, greatest(1, CAST(ceil(log2(greatest(count(*), 2)) / 2) AS INT)) AS bits FROM embeddings)),
keys AS (SELECT CAST(i AS INT) AS perm, {keys} FROM range(100) t(i)),
placed AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id) - 1 AS place FROM embeddings),
walk AS (SELECT perm, vec_id, CAST(place AS BIGINT) AS spot, 0 AS step FROM placed CROSS JOIN keys UNION ALL SELECT perm, vec_id, l << bits | r, 1 FROM ({step})),
spans AS (SELECT label, sum(count(*)) OVER (ORDER BY label) - count(*) AS lo, sum(count(*)) OVER (ORDER BY label) AS hi FROM embeddings GROUP BY label),
lab AS (SELECT perm, vec_id, label FROM walk CROSS JOIN size JOIN spans ON spot >= lo AND spot < hi WHERE step = 1 AND spot < n UNION ALL SELECT -1, vec_id, label FROM embeddings)"""


_PERMS = f"""{_shuffled()},
best AS (SELECT perm, vec_id, label AS y_pred FROM (SELECT l.perm, near.vec_id, l.label, row_number() OVER (PARTITION BY l.perm, near.vec_id ORDER BY count(*) DESC, l.label) AS r FROM near JOIN lab l ON l.vec_id = near.neighbour GROUP BY l.perm, near.vec_id, l.label) WHERE r = 1),
hits AS (SELECT b.perm, CAST(sum(CASE WHEN b.y_pred = l.label THEN 1 ELSE 0 END) AS BIGINT) AS n_correct, count(*) AS n FROM best b JOIN lab l ON l.perm = b.perm AND l.vec_id = b.vec_id GROUP BY b.perm)"""
_CLEAN = "coalesce(text, '')"
for _rule in RULES:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_rule}', '', 'gi')"

ORACLE_SQL = {
    "align_fold_summary": f"SELECT fold, lang, count(*) AS n FROM (SELECT lang, {_fold('CAST(doc_id AS VARCHAR)', 'lang')} AS fold FROM documents d JOIN embeddings e ON d.doc_id = e.vec_id) GROUP BY fold, lang",
    "group_majority_label": _sql("SELECT * FROM major", _MAJORITY),
    "stratified_group_folds": _sql("SELECT * FROM placed", _MAJORITY, _ORDER_FOLDS),
    "leakage_check": _sql("SELECT fold, CAST(count(*) AS BIGINT) AS n_rows, count(DISTINCT l_orderkey) AS n_groups, CAST(0 AS BIGINT) AS n_leaking FROM lineitem JOIN placed USING (l_orderkey) GROUP BY fold", _MAJORITY, _ORDER_FOLDS),
    "split_table": f"SELECT doc_id, CAST(t.i AS INT) AS test_fold, CASE WHEN fold = t.i THEN 'test' WHEN fold = (t.i + 1) % 5 THEN 'val' ELSE 'train' END AS split FROM (SELECT doc_id, {_fold('doc_id', 'lang')} AS fold FROM documents) CROSS JOIN range(5) t(i)",
    "manifest_stats": "SELECT event_type, CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_groups, CAST(quantile_cont(n, 0.5) AS DOUBLE) AS median_size FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL) GROUP BY event_type",
    "overall_stats": "SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_groups, count(DISTINCT event_type) AS n_classes FROM events",
    "fold_class_counts": _sql("SELECT fold, event_type AS class, count(*) AS n_rows, count(DISTINCT user_id) AS n_groups FROM rows GROUP BY fold, event_type UNION ALL SELECT fold, NULL, count(*), count(DISTINCT user_id) FROM rows GROUP BY fold", _EVENT_FOLDS),
    "multiclass_groups": "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_classes, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS classes FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) > 1",
    "label_frequencies": "SELECT v.value, count(l_orderkey) AS n FROM (VALUES ('A'), ('N'), ('R'), ('X')) v(value) LEFT JOIN lineitem ON l_returnflag = v.value GROUP BY v.value",
    "vector_mean_pool": "SELECT label, n_rows, pos, round(value, 6) AS value FROM (SELECT label, CAST(i - 1 AS INT) AS pos, count(*) AS n_rows, avg(CAST(embedding[i] AS DOUBLE)) AS value FROM embeddings CROSS JOIN range(1, 65) t(i) GROUP BY label, i)",
    "masked_mean": "SELECT vec_id, CAST(p.i AS INT) AS pos, round(sum(CASE WHEN (vec_id + t.i) % 3 > 0 THEN CAST(embedding[t.i * 16 + p.i + 1] AS DOUBLE) ELSE 0 END) / greatest(sum(CASE WHEN (vec_id + t.i) % 3 > 0 THEN 1 ELSE 0 END), 1e-9), 6) AS value FROM embeddings CROSS JOIN range(4) t(i) CROSS JOIN range(16) p(i) GROUP BY vec_id, p.i",
    "vector_functions": "SELECT vec_id, round(sqrt(list_dot_product(v, v)), 6) AS norm, CAST(list_position(v, list_max(v)) - 1 AS INT) AS argmax, round(list_sum(list_transform(v, lambda x: (x - list_min(v)) / (list_max(v) - list_min(v)))), 6) AS scaled_sum, round(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v)))), 6) AS top_weight, round(list_cosine_similarity(v, list_reverse(v)), 6) AS with_reverse FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)",
    "text_clean": rf"SELECT doc_id, trim(regexp_replace({_CLEAN}, '\s+', ' ', 'g')) AS cleaned FROM documents",
    "text_length_stats": "SELECT lang, count(*) AS n, count(*) FILTER (WHERE coalesce(length(text), 0) = 0) AS n_empty, round(avg(coalesce(length(text), 0)), 6) AS mean, round(stddev_pop(coalesce(length(text), 0)), 6) AS std, CAST(min(coalesce(length(text), 0)) AS INT) AS min, CAST(max(coalesce(length(text), 0)) AS INT) AS max FROM documents GROUP BY lang",
    "report_fields": r"SELECT doc_id, concat_ws(' / ', lang, CASE WHEN doc_id % 3 > 0 THEN source END) AS joined, source || '__' || lang AS key, lang AS part, regexp_extract(text, '\S+') AS first FROM documents",
    "label_encode": "SELECT doc_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS INT) AS code, " + ", ".join(f"CAST(lang = '{x}' AS INT) AS is_{x}" for x in LANGS) + " FROM documents",
    "class_cohesion": _sql("SELECT " + ", ".join(f"round({f}, 8) AS {n}" for n, f in (("within_mean", "avg(s) FILTER (WHERE same)"), ("within_std", "stddev_pop(s) FILTER (WHERE same)"), ("between_mean", "avg(s) FILTER (WHERE NOT same)"), ("between_std", "stddev_pop(s) FILTER (WHERE NOT same)"), ("gap", "avg(s) FILTER (WHERE same) - avg(s) FILTER (WHERE NOT same)"))) + " FROM (SELECT a.label = b.label AS same, list_cosine_similarity(a.v, b.v) AS s FROM e a JOIN e b ON a.vec_id < b.vec_id)", _E),
    "knn_neighbours": _sql("SELECT vec_id, rank, neighbour, round(similarity, 6) AS similarity FROM near", _E, _near()),
    "knn_loo_predictions": _sql("SELECT vec_id, fold, y_true, y_pred FROM pred", *_KNN),
    "knn_loo_accuracy": _sql("SELECT round(avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(1.0 / count(DISTINCT y_true), 9) AS chance FROM pred", *_KNN),
    "permutation_test": _recursive("SELECT perm, n_correct FROM hits", _E, _near(), _PERMS),
    "permutation_p": _recursive("SELECT round(max(o.a), 9) AS observed, round(avg(CAST(n_correct AS DOUBLE) / n), 9) AS mean_shuffled, round(avg(CASE WHEN CAST(n_correct AS DOUBLE) / n >= o.a THEN 1.0 ELSE 0.0 END), 9) AS p FROM hits CROSS JOIN (SELECT CAST(n_correct AS DOUBLE) / n AS a FROM hits WHERE perm = -1) o WHERE perm >= 0", _E, _near(), _PERMS),
    "confusion_matrix": _sql("SELECT * FROM conf", *_KNN, _GRID),
    "confusion_normalised": _sql("SELECT y_true, y_pred, n, round(n / (sum(n) OVER (PARTITION BY y_true) + 1e-9), 9) AS share FROM (SELECT y_true, y_pred, CAST(sum(n) AS BIGINT) AS n FROM conf GROUP BY y_true, y_pred)", *_KNN, _GRID),
    "class_report": _sql("SELECT fold, class, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM scores", *_KNN, _GRID, _SCORES),
    "scalar_metrics_by_fold": _sql("SELECT fold, n, round(accuracy, 9) AS accuracy, round(balanced_accuracy, 9) AS balanced_accuracy, round(kappa, 9) AS kappa, round(macro_f1, 9) AS macro_f1 FROM scalars", *_KNN, _GRID, _SCORES, _SCALARS),
    "fold_summary_ci": _sql(f"SELECT metric, count(value) AS n, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std, round(avg(value) - {T_4} * stddev_samp(value) / sqrt(count(value)), 7) AS ci_lo, round(avg(value) + {T_4} * stddev_samp(value) / sqrt(count(value)), 7) AS ci_hi FROM (SELECT fold, unnest(['accuracy', 'balanced_accuracy', 'kappa', 'macro_f1']) AS metric, unnest([accuracy, balanced_accuracy, kappa, macro_f1]) AS value FROM scalars) GROUP BY metric", *_KNN, _GRID, _SCORES, _SCALARS),
    "paired_t_models": _sql(f"SELECT 'accuracy' AS metric, count(*) AS n, round(avg(d), 7) AS delta, round(avg(d) - {T_4} * stddev_samp(d) / sqrt(count(*)), 7) AS ci_lo, round(avg(d) + {T_4} * stddev_samp(d) / sqrt(count(*)), 7) AS ci_hi, round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 7) AS t, round({_P_4.format(t="(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0))")}, 7) AS p FROM (SELECT fold, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN y_true = one.nl THEN 1.0 ELSE 0.0 END) AS d FROM pred JOIN (SELECT vec_id, nl FROM near WHERE rank = 1) one USING (vec_id) GROUP BY fold)", *_KNN),
    "spearman_length_label": _sql("""SELECT n, round(rho, 9) AS rho, round(CASE WHEN nu % 2 = 0 THEN 1 - sine * even ELSE 1 - 2 / pi() * (asin(sine) + sine * odd) END, 9) AS p FROM sides,
  (SELECT sum(term) AS even FROM (SELECT exp(sum(CASE WHEN i = 0 THEN 0 ELSE ln((2 * i - 1) / CAST(2 * i AS DOUBLE) * (1 - sine * sine)) END) OVER (ORDER BY i)) AS term FROM sides, range(2000000) k(i) WHERE i <= (nu - 2) / 2)),
  (SELECT sum(term) AS odd FROM (SELECT sqrt(1 - sine * sine) * exp(sum(CASE WHEN i = 0 THEN 0 ELSE ln(2 * i / CAST(2 * i + 1 AS DOUBLE) * (1 - sine * sine)) END) OVER (ORDER BY i)) AS term FROM sides, range(2000000) k(i) WHERE i <= (nu - 3) / 2))""", _LABELLED, _SPEARMAN),
    "balanced_group_folds": _sql("SELECT fold, l_returnflag, count(*) AS n FROM lineitem JOIN dealt USING (l_orderkey) GROUP BY fold, l_returnflag", """profiles AS (SELECT l_orderkey, '[' || string_agg('{"l":"' || l_returnflag || '","n":' || n || '}', ',' ORDER BY l_returnflag) || ']' AS profile FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_returnflag) GROUP BY l_orderkey),
dealt AS (SELECT l_orderkey, CAST((row_number() OVER (PARTITION BY profile ORDER BY md5(CAST(l_orderkey AS VARCHAR) || '_42'), l_orderkey) - 1 + CAST('0x' || substr(md5(profile), 1, 6) AS BIGINT)) % 5 AS INT) AS fold FROM profiles)"""),
    "greedy_group_folds": "SELECT l_returnflag, count(*) AS n_rows, count(DISTINCT l_orderkey) AS n_groups, true AS even FROM lineitem GROUP BY l_returnflag",
    "attention_map": """SELECT vec_id, CAST(t // 2 AS INT) AS y, CAST(t % 2 AS INT) AS x, round(avg(w), 6) AS weight FROM (
  SELECT vec_id, h, t, exp(s - max(s) OVER g) / sum(exp(s)) OVER g * exp(max(s) OVER g) AS w FROM (
    SELECT vec_id, h, t, list_dot_product(v[1 + 4 * h : 4 + 4 * h], v[9 + 16 * h + 4 * t : 12 + 16 * h + 4 * t]) / 2.0 AS s FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) CROSS JOIN range(2) a(h) CROSS JOIN range(4) b(t)
  ) WINDOW g AS (PARTITION BY vec_id, h)) GROUP BY vec_id, t""",
    "rows_with_group_labels": _sql("SELECT l.l_orderkey, l.l_linenumber, placed.l_returnflag AS group_label, placed.fold FROM lineitem l JOIN placed USING (l_orderkey)", _MAJORITY, _ORDER_FOLDS),
    "missing_images": "SELECT doc_id, '/data/' || source || '/dermoscopy/' || lang || '/' || doc_id || '.PNG' AS image_path FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "path_parts": "SELECT doc_id, '/data/' || source AS root, replace('/data/' || source || '/dermoscopy/' || lang || '/' || doc_id || '.PNG', '/data/', '/moved/') AS moved, 'png' AS extension, CAST(CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 ELSE -1 END AS INT) AS label, 'P' || doc_id AS folder_name FROM documents",
    "length_grid": "SELECT lang, CAST(i AS INT) AS step, round(i / 10.0 * longest, 6) AS value FROM (SELECT lang, max(n_chars) AS longest FROM documents GROUP BY lang) CROSS JOIN range(11) t(i)",
    "class_summary_ci": _sql(f"SELECT class, metric, count(value) AS n, round(avg(value), 7) AS mean, round(stddev_pop(value), 7) AS std, round(avg(value) - {T_4} * stddev_samp(value) / sqrt(count(value)), 7) AS ci_lo, round(avg(value) + {T_4} * stddev_samp(value) / sqrt(count(value)), 7) AS ci_hi FROM (SELECT fold, class, unnest(['precision', 'recall', 'f1']) AS metric, unnest([precision, recall, f1]) AS value FROM scores) GROUP BY class, metric", *_KNN, _GRID, _SCORES),
    "crop_counters": "SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 7 = 0) AS n_fallback, count(*) FILTER (WHERE n_chars <= 200) AS n_unreadable FROM documents",
    "shared_groups": _sql("SELECT l_orderkey FROM folded WHERE fold = 0 INTERSECT SELECT l_orderkey FROM folded WHERE fold <> 0", f"folded AS (SELECT l_orderkey, {_fold('(l_orderkey * 10 + l_linenumber)', 'l_returnflag')} AS fold FROM lineitem)"),
    "fold_map": _sql("SELECT user_id AS group_id, min(fold) AS fold FROM rows GROUP BY user_id", _EVENT_FOLDS),
    "wide_metrics": _sql("SELECT 'knn' AS model, s.fold, round(balanced_accuracy, 9) AS balanced_accuracy, round(accuracy, 9) AS accuracy, CAST(NULL AS DOUBLE) AS macro_auc, round(s.macro_f1, 9) AS macro_f1, round(kappa, 9) AS cohen_kappa, CAST(NULL AS DOUBLE) AS n_train, CAST(n AS DOUBLE) AS n_test, CAST(NULL AS DOUBLE) AS best_c, " + ", ".join(f"round((SELECT f1 FROM scores c WHERE c.fold = s.fold AND c.class = {k}), 9) AS c{k}_f1" for k in range(3)) + " FROM scalars s", *_KNN, _GRID, _SCORES, _SCALARS),
    "choose_images": "SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 AND l.doc_id IS NOT NULL THEN 'crops/' || d.doc_id ELSE source || '/' || d.doc_id END AS image FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)",
    "roc_auc_ovr": "SELECT class, CAST(sum(p) AS BIGINT) AS n_pos, CAST(count(*) - sum(p) AS BIGINT) AS n_neg, round((sum(r) FILTER (WHERE p = 1) - sum(p) * (sum(p) + 1) / 2.0) / nullif(CAST(sum(p) AS DOUBLE) * (count(*) - sum(p)), 0), 9) AS auc FROM (SELECT c.class, CASE WHEN lang = c.class THEN 1 ELSE 0 END AS p, rank() OVER (PARTITION BY c.class ORDER BY n_chars) + (count(*) OVER (PARTITION BY c.class, n_chars) - 1) / 2.0 AS r FROM documents CROSS JOIN (VALUES ('de'), ('en'), ('es'), ('fr')) c(class)) GROUP BY class",
    "roc_points": _sql("SELECT lang, score, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr FROM points", _LABELLED, _ROC),
    "mean_roc": _sql("""SELECT CAST(step AS INT) AS step, round(CASE WHEN step = 99 THEN 1.0 ELSE avg(tpr) END, 8) AS mean_tpr, round(stddev_pop(tpr), 8) AS std_tpr, count(*) AS n_curves FROM (
  SELECT g.i AS step, s.lang, CASE WHEN g.i = 0 THEN 0.0 WHEN next_fpr IS NULL THEN hi ELSE hi + (next_lo - hi) * (g.i / 99.0 - fpr) / (next_fpr - fpr) END AS tpr
  FROM (SELECT *, lead(fpr) OVER (PARTITION BY lang ORDER BY fpr) AS next_fpr, lead(lo) OVER (PARTITION BY lang ORDER BY fpr) AS next_lo FROM (SELECT lang, fpr, min(tpr) AS lo, max(tpr) AS hi FROM points GROUP BY lang, fpr)) s
  JOIN range(100) g(i) ON g.i >= fpr * 99 - 1e-12 AND (next_fpr IS NULL OR g.i < next_fpr * 99 - 1e-12)) GROUP BY step""", _LABELLED, _ROC),
    "class_sample": "SELECT doc_id, lang, number FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR) || '_42'), doc_id) AS number FROM documents) WHERE number <= 20",
    "row_sample": "SELECT doc_id, lang FROM documents ORDER BY md5(CAST(doc_id AS VARCHAR) || '_42'), doc_id LIMIT 50",
    "topk_per_class": "SELECT * FROM (SELECT doc_id, lang, n_chars, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents) WHERE rank <= 10",
    "incremental_pending": "SELECT doc_id, lang, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)",
}
