import struct
import zipfile
import zlib

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmill.operators import images, similarity
from foldmill.plans import pipeline
from foldmill.sources import matrices, readers, sinks

ROOT = Path(__file__).resolve().parent.parent


def png(path, pixels):
    h, w, _ = pixels.shape
    raw = b"".join(b"\x00" + row.tobytes() for row in pixels.astype(np.uint8))

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def spot(seed=0, side=48):
    image = np.full((side, side, 3), 220, np.uint8)
    y, x = np.mgrid[:side, :side]
    image[(y - side // 2) ** 2 + (x - side // 2) ** 2 < (side // 4) ** 2] = (60 + seed % 40, 40, 30)
    return image


@pytest.fixture
def tree(tmp_path):
    for k, (c, patient) in enumerate([("DN", "P1 left"), ("DN", "P2"), ("MIA", "P1"), ("MIA", "P3"), ("Minsitu", "P4")]):
        d = tmp_path / "data" / c / patient
        d.mkdir(parents=True)
        png(d / "a.PNG", spot(k))
        (d / "notes.txt").write_text("x")
    (tmp_path / "data" / "Other" / "P9").mkdir(parents=True)
    png(tmp_path / "data" / "Other" / "P9" / "b.png", spot())
    (tmp_path / "data" / "DN" / "P2" / "bad.png").write_bytes(b"x")
    return tmp_path


def test_folder_scan(spark, tree):
    rows = readers.scan_dataset(spark, str(tree / "data")).toPandas()
    assert sorted(zip(rows.diagnosis, rows.patient_id)) == [("DN", "P1"), ("DN", "P2"), ("DN", "P2"), ("MIA", "P1"), ("MIA", "P3"), ("Minsitu", "P4")]
    assert set(rows.label) == {0, 1, 2} and "P1 left" in set(rows.folder_name)


def test_flat_scan_drops_missing_files_and_unknown_labels(spark, tmp_path):
    (tmp_path / "img").mkdir()
    for n in ("001", "002", "004"):
        png(tmp_path / "img" / f"{n}.jpg", spot())
    (tmp_path / "m.csv").write_text("isic_id,lesion_id,label\n001,00123,0\n002,L2,9\n003,L3,1\n004,L4,2.0\n")
    rows = readers.scan_dataset(spark, str(tmp_path / "img"), str(tmp_path / "m.csv")).toPandas()
    assert sorted(zip(rows.patient_id, rows.label)) == [("00123", 0), ("L4", 2)]


def test_reports_in_both_encodings_and_missing_marks(spark, tmp_path):
    text = 'id,label,a,b\n00123,DN,"two\nlines, ""quoted""",NaN\n 7 ,NA,,gr\xf3s\n'
    (tmp_path / "u.csv").write_bytes(text.encode("utf-8"))
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    for name in ("u.csv", "l.csv"):
        rows = {r.patient_id: r for r in readers.read_reports(spark, str(tmp_path / name), "id", "label", ["a", "b"]).collect()}
        assert rows["00123"].a == 'two\nlines, "quoted"' and rows["00123"].b is None
        assert rows["7"].label is None and rows["7"].a is None and rows["7"].b == "gr\xf3s"


def test_a_replacement_mark_in_utf8_is_no_latin1(spark, tmp_path):
    (tmp_path / "u.csv").write_text("id,label,a\n1,DN,gr\u00f3s \ufffd\n", encoding="utf-8")
    assert readers.read_reports(spark, str(tmp_path / "u.csv"), "id", "label", ["a"]).first().a == "gr\u00f3s \ufffd"


def test_reports_from_a_workbook(spark, tmp_path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    names = "".join(f"<si><t>{t}</t></si>" for t in ("label", "id", "a", "DN")) + "<si><r><t>two </t></r><r><t>runs &amp; gr\u00f3s</t></r></si>"
    rows = (
        '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="AA1" t="s"><v>2</v></c></row>'
        '<row r="2"><c r="A2" t="s"><v>3</v></c><c r="B2"><v>7</v></c><c r="AA2" t="s"><v>4</v></c></row>'
        '<row r="3"><c r="B3" t="inlineStr"><is><t>008</t></is></c></row>'
    )
    with zipfile.ZipFile(tmp_path / "r.xlsx", "w") as book:
        book.writestr("xl/sharedStrings.xml", f"<sst {main}>{names}</sst>")
        book.writestr("xl/worksheets/sheet1.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
    got = sorted(map(tuple, readers.read_reports(spark, str(tmp_path / "r.xlsx"), "id", "label", ["a"]).collect()))
    assert got == [("008", None, None), ("7", "DN", "two runs & gr\u00f3s")]


def test_csv_round_trip_keeps_ids(spark, tmp_path):
    df = spark.createDataFrame([("00123", 4), ("a\nb", 1)], "group_id string, fold int")
    sinks.write_csv(sinks.fold_map(df), str(tmp_path / "m"))
    assert {(r.group_id, r.fold) for r in readers.read_fold_map(spark, str(tmp_path / "m")).collect()} == {("00123", 4), ("a\nb", 1)}
    (tmp_path / "x.csv").write_text("image_path,patient_id,label\n/a.png,007,1\n")
    r = readers.read_manifest(spark, str(tmp_path / "x.csv")).first()
    assert r.patient_id == "007" and r.label == 1 and r.segmented_path is None


def test_matrix_import(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "f.npy", m)
    rows = matrices.read_matrix(spark, str(tmp_path / "f.npy")).orderBy("row").collect()
    assert [r.features for r in rows] == m.tolist()


def test_matrix_round_trip(spark, tmp_path):
    rows = [(k, [float(k), -k / 2]) for k in range(50)] + [(99, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(3)
    sinks.write_table(matrices.write_matrices(df, str(tmp_path / "m"), "id", "v"), str(tmp_path / "index"))
    back = matrices.read_matrix(spark, str(tmp_path / "m")).collect()
    index = {(r.file, r.row): r.key for r in spark.read.parquet(str(tmp_path / "index")).collect()}
    assert len(back) == 50 and {index[r.file.split("/")[-1], r.row]: r.features for r in back} == dict(rows[:50])


def test_matrix_by_ranges(spark, tmp_path):
    """Many ranges of a file, in several layouts and types, are what one read gives; objects are refused."""
    rng = np.random.RandomState(0)
    want = {}
    for name, m in (("a", rng.standard_normal((1000, 16)).astype(np.float32)), ("b", rng.standard_normal((7, 3))), ("c", np.asfortranarray(rng.standard_normal((20, 4)))), ("d", rng.randint(0, 9, (5, 2, 3))), ("e", np.zeros((0, 4))), ("f", np.arange(6.0))):
        (tmp_path / "in" / name).mkdir(parents=True)
        np.save(tmp_path / "in" / name / f"{name}.npy", m)
        want |= {(f"{name}.npy", i): row.ravel().astype(np.float32).tolist() for i, row in enumerate(m.reshape(len(m), -1) if len(m) else m)}
    found = matrices.read_matrix(spark, str(tmp_path / "in"), size=4096)
    assert {(r.file.split("/")[-1], r.row): r.features for r in found.collect()} == want
    assert found.where("file like '%a.npy'").rdd.getNumPartitions() >= 16
    whole = matrices.NpyReader(str(tmp_path / "in" / "a" / "a.npy"), 10**9)
    assert len(whole.partitions()) == 1 and max(b.num_rows for p in matrices.NpyReader(str(tmp_path / "in"), 4096).partitions() for b in whole.read(p)) <= 64
    np.save(tmp_path / "o.npy", np.array([{}], object), allow_pickle=True)
    with pytest.raises(Exception, match="never unpickled"):
        matrices.read_matrix(spark, str(tmp_path / "o.npy")).collect()
    with pytest.raises(Exception, match="nothing-here"):
        matrices.read_matrix(spark, str(tmp_path / "nothing-here")).collect()


def test_group_ids_from_text_arrays(spark, tmp_path):
    ids = [f"P{i}__MIA" for i in range(100)] + ["ñandú"]
    np.save(tmp_path / "ids.npy", np.array(ids))
    got = {r.row: r.value for r in matrices.read_texts(spark, str(tmp_path / "ids.npy"), size=512).collect()}
    assert [got[i] for i in range(101)] == ids
    np.save(tmp_path / "raw.npy", np.array([b"a", b"bc"]))
    assert [r.value for r in matrices.read_texts(spark, str(tmp_path / "raw.npy")).orderBy("row").collect()] == ["a", "bc"]
    np.save(tmp_path / "objects.npy", np.array(ids, object), allow_pickle=True)
    with pytest.raises(Exception, match="never unpickled"):
        matrices.read_texts(spark, str(tmp_path / "objects.npy")).collect()


def test_checkpoints_from_the_command_line(spark, tree, monkeypatch):
    import sys
    import types

    seen = []
    monkeypatch.setitem(sys.modules, "own_encoder", types.SimpleNamespace(load=lambda path: path))
    monkeypatch.setattr(pipeline, "run_all", lambda run, stages, skip: seen.append(run) or {})
    root = ["--root", str(tree / "data"), "--out", str(tree / "out")]
    pipeline.main([*root, "--checkpoints", "/c", "--encoder", "own_encoder:load"])
    assert seen[0].checkpoints == "/c" and seen[0].load_encoder("x") == "x"
    with pytest.raises(SystemExit):
        pipeline.main([*root, "--checkpoints", "/c"])


def files_below(folder):
    return sorted(str(p.relative_to(folder)) for p in folder.rglob("*") if p.is_file())


def test_only_committed_attempts_are_seen(spark, tmp_path):
    """Of two attempts of a task one is committed; the other leaves nothing, nor does an aborted job."""
    writer = matrices.NpyWriter(str(tmp_path), "j1")
    rows = [(1, [1.0, 2.0]), (2, [3.0, 4.0])]
    lost, kept = writer.write(iter(rows)), writer.write(iter(rows))
    writer.commit([kept, None, writer.write(iter([]))])
    matrices.settle(spark, str(tmp_path), "j1")
    assert lost.name != kept.name and files_below(tmp_path) == [f"index/part-{kept.name}-0000.parquet", f"part-{kept.name}-0000.npy"]
    other = matrices.NpyWriter(str(tmp_path), "j2")
    other.abort([other.write(iter(rows))])
    assert len(files_below(tmp_path)) == 2


def test_failed_job_leaves_nothing(spark, tmp_path):
    df = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "id long, v array<float>").repartition(4)
    matrices.write_matrices(df, str(tmp_path / "m"), "id", "v")
    before = files_below(tmp_path / "m")
    bad = df.withColumn("v", F.when(F.col("id") == 17, F.array(F.raise_error(F.lit("broken")).cast("float"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="broken"):
        matrices.write_matrices(bad, str(tmp_path / "m"), "id", "v")
    assert files_below(tmp_path / "m") == before


def test_killed_task_is_repeated(tmp_path):
    """A worker dies halfway through its first attempt: the second one's files are all there is."""
    import subprocess
    import sys

    code = f"""
import os
from pyspark.sql import SparkSession
from foldmill.sources import sinks
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").getOrCreate()
class Dying(sinks.PngWriter):
    def files(self, rows, attempt):
        for k, pair in enumerate(super().files(rows, attempt)):
            if k == 3 and not os.path.exists({str(tmp_path / 'died')!r}):
                open({str(tmp_path / 'died')!r}, "w").close()
                os._exit(1)
            yield pair
class DyingFiles(sinks.PngFiles):
    def writer(self, schema, overwrite):
        return Dying(self.options["path"], self.options["job"], 2, 2)
sinks.PngFiles = DyingFiles
df = spark.range(20).selectExpr("concat('c/', id, '.png') AS file", "cast('123456789012' AS binary) AS data").repartition(2)
sinks.write_images(df, {str(tmp_path / 'out')!r}, 2, 2)
"""
    done = subprocess.run([sys.executable, "-c", code], cwd=str(ROOT), capture_output=True, text=True, timeout=240)
    assert done.returncode == 0, done.stderr[-2000:]
    assert (tmp_path / "died").exists() and files_below(tmp_path / "out") == sorted(f"c/{i}.png" for i in range(20))


def test_mask_is_shown_in_green():
    shown = images.overlaid(np.full((2, 2, 3), 100, np.uint8), np.array([[1, 0], [0, 0]]))
    assert shown[0, 0].tolist() == [60, 162, 60] and (shown[1] == 100).all()


def test_checkpoint_choice(spark, tmp_path):
    for n in ("checkpoint-9.pth", "checkpoint-10.pth", "other-99.pth"):
        (tmp_path / n).write_bytes(b"x")
    assert readers.find_checkpoint(spark, str(tmp_path)).endswith("checkpoint-10.pth")
    (tmp_path / "checkpoint-best.pth").write_bytes(b"x")
    assert readers.find_checkpoint(spark, str(tmp_path)).endswith("checkpoint-best.pth")


def test_segmentation_and_crop(spark):
    mask = images.colour_segment(spot())
    assert 0.1 < mask.mean() < 0.5 and mask[24, 24] == 1 and mask[0, 0] == 0
    assert images.colour_segment(np.full((20, 20, 3), 128, np.uint8)).all()
    one_row = np.zeros((20, 20), np.uint8)
    one_row[5, 3:9] = 1
    assert images.crop(spot(side=20), one_row, 0.0, 16).shape == (16, 16, 3)
    parts, n = images.labelled(np.array([[1, 0, 0], [0, 1, 0], [0, 0, 0], [1, 0, 0]], bool))
    assert n == 2 and parts[0, 0] == parts[1, 1]
    flat = images.resized_cubic(np.full((9, 7, 3), 77, np.uint8), 16, 16)
    assert (flat == 77).all() and np.allclose(images.cubic_weights(8, 8), np.eye(8))
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert images.filled(ring).all()
    x = images.evaluation_input(spot(), (0.5,) * 3, (0.25,) * 3, 64, 32)
    assert x.shape == (3, 32, 32) and abs(float(x.max())) < 2.1


def test_unreadable_images_are_flagged(spark, tree):
    found = images.segment_images(readers.read_images(spark, str(tree / "data")), side=32).toPandas()
    assert (~found.readable).sum() == 1 and set(found.data.map(len)) == {32 * 32 * 3}


def test_stages_and_skipping(spark, tree):
    run = pipeline.Run(spark, str(tree / "data"), str(tree / "out"))
    stages = ["prepare", "segment", "montage", "make_csv", "extract"]
    took = pipeline.run_all(run, stages)
    assert all(t > 0 for t in took.values())
    assert pipeline.run_all(run, stages, skip_existing=True) == dict.fromkeys(stages, 0.0)
    rows = run.read("make_csv").collect()
    assert len(rows) == 30
    chosen = {r.image for r in rows}
    own = str(tree / "data" / "DN" / "P2" / "bad.png")  # unreadable: no crop
    assert own in chosen and len(chosen) == 6
    for path in chosen - {own}:
        assert path.startswith(run.path("crops")) and "/".join(path.split("/")[-3:-1]) in {"DN/P1 left", "DN/P2", "MIA/P1", "MIA/P3", "Minsitu/P4"}
    crops = {r.segmented_path: r.data for r in run.read("segment").where("readable").collect()}
    for r in readers.read_images(spark, run.path("crops")).collect():
        assert images.rgb(r).tobytes() == bytes(crops[r.origin])
    panels = run.read("montage").collect()
    assert len(panels) == 5 and all(len(r.data) == 3 * r.height * r.width and r.width == 3 * r.height for r in panels)
    groups = {r.group_id: r.fold for r in run.read("extract").collect()}
    assert set(groups) == {"P1__DN", "P1__MIA", "P2__DN", "P3__MIA", "P4__Minsitu"} and groups["P1__DN"] == groups["P1__MIA"]


def test_wide_metrics_and_report(spark):
    m = spark.createDataFrame([("a", 0, None, "accuracy", 0.5), ("a", 0, "DN", "f1", 0.25)], "model string, fold int, class string, metric string, value double")
    r = sinks.wide_metrics(m, ["DN"]).first()
    assert r.accuracy == 0.5 and r.DN_f1 == 0.25 and r.DN_auc is None
    s = spark.createDataFrame([(None, "f1", 0.5, 0.1, 0.4, 0.6)], "class string, metric string, mean double, std double, ci_lo double, ci_hi double")
    assert sinks.report_lines(s).first()[0] == "f1: 0.5000 +- 0.1000 [0.4000, 0.6000]"


def test_neighbours_with_duplicates_and_zero_vectors(spark):
    rows = [(3, [1.0, 0.0], 0), (1, [1.0, 0.0], 1), (2, [0.0, 0.0], 0), (5, [1.0, 0.1], 1), (4, None, 0)]
    df = spark.createDataFrame(rows, "id long, v array<float>, label int")
    got = {(r.id, r["rank"]): r.neighbour for r in similarity.neighbours(df, "id", "v", 2, block=2).collect()}
    assert got[5, 1] == 1 and got[5, 2] == 3 and got[1, 1] == 3 and got[2, 1] == 1 and got[2, 2] == 3


def test_cohesion_like_pairs(spark):
    rng = np.random.RandomState(0)
    v, y = rng.standard_normal((30, 4)), rng.randint(0, 3, 30)
    df = spark.createDataFrame([(x.tolist(), int(c)) for x, c in zip(v, y)], "v array<double>, y int")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    i, j = np.triu_indices(30, 1)
    s, same = (u @ u.T)[i, j], y[i] == y[j]
    r = similarity.class_cohesion(df, "v", "y").first()
    assert [r.within_mean, r.within_std, r.between_mean, r.between_std] == pytest.approx([s[same].mean(), s[same].std(), s[~same].mean(), s[~same].std()])
    assert similarity.class_cohesion(df.limit(1), "v", "y").first().within_mean is None


def test_each_test_fold_has_vectors_of_its_own_checkpoint(spark, tree):
    from foldmill.operators import encoders

    for k in (0, 2):
        (tree / "ck" / f"results_fold{k}").mkdir(parents=True)
        (tree / "ck" / f"results_fold{k}" / "checkpoint-best.pth").write_bytes(b"x")
    asked = []
    run = pipeline.Run(spark, str(tree / "data"), str(tree / "tuned"), checkpoints=str(tree / "ck"), load_encoder=lambda path: asked.append(path) or encoders.stub_image_encoder(4 + len(asked)))
    pipeline.run_all(run, ["prepare", "segment", "extract"])
    rows = run.read("extract").collect()
    assert len(asked) == 2 and {(r.test_fold, len(r.features)) for r in rows} == {(0, 5), (2, 6)} and len(rows) == 10


def test_scores_of_each_class_are_summarised(spark, tmp_path):
    run = pipeline.Run(spark, "", str(tmp_path))
    rows = [("m", k % 2, str(k), k % 3, (k % 3 if k % 4 else 0), [0.6, 0.3, 0.1] if k % 3 == 0 else [0.1, 0.5, 0.4]) for k in range(24)]
    sinks.write_table(spark.createDataFrame(rows, "model string, fold int, row_id string, y_true int, y_pred int, proba array<double>"), run.path("fusion"))
    got = {(r["class"], r.metric): r for r in pipeline.evaluate(run).collect()}
    assert set(got) == {(None, m) for m in ("accuracy", "balanced_accuracy", "kappa", "macro_f1", "macro_auc")} | {(c, m) for c in ("DN", "MIA", "Minsitu") for m in ("f1", "auc")}
    assert got["DN", "auc"].mean == 1.0 and got["DN", "f1"].n == 2 and got["DN", "f1"].mean < 1
