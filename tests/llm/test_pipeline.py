"""Each stage against a brute-force version on its own input, and the run as a whole."""

from collections import Counter

import corpus_pipeline
from foldmill.llm import decontaminate, mixing, quality_rules
from tests.conftest import DATA
from tests.llm.test_jaccard import shingles

SF = f"{DATA}/sf0.01"


def test_stages(spark):
    docs, rows = spark.read.parquet(f"{SF}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        rows[name] = docs.collect()
        out = corpus_pipeline.materialise(stage(spark, docs, SF), name)
        if name != "shards":
            assert out.columns == columns
        docs = out
    rows["end"] = docs.collect()
    ids = {name: Counter(r.doc_id for r in part) for name, part in rows.items()}

    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    right = [(labels[i] == 1) == (i in ids["near_copies"]) for i in labels]
    assert sum(right) >= 0.98 * len(right)

    sets = {r.doc_id: shingles(r.text, 5) for r in rows["near_copies"]}
    order, parent = sorted(sets), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, i in enumerate(order):
        for j in order[:k]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    assert set(ids["test_leaks"]) == {i for i in sets if find(i) == i}

    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontaminate.Searcher(decontaminate.ItemIndex(list(enumerate(items))), decontaminate.PASSAGE, decontaminate.STEP)
    planted = {r.doc_id for r in rows["test_leaks"] if any(t in r.text for t in items)}
    gone = set(ids["test_leaks"]) - set(ids["mixture"])
    assert planted <= gone and gone == {r.doc_id for r in rows["test_leaks"] if index.leaks(r.text)} and len(gone) <= len(planted) + 3

    taken = {r.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(rows["mixture"], "doc_id long, text string, lang string, source string, n_chars long")).where("copies > 0").collect()}
    assert ids["shards"] == Counter(taken)
    assert sum(ids["end"].values()) == sum(ids["shards"].values()) and ids["end"] == ids["shards"]


def test_texts_of_one_id_stay(spark):
    """Rows that share an id are one document: each of its texts stays once, its near copies under other ids go."""
    long = [" ".join(f"{c}{i}" for i in range(30)) for c in "abc"]
    rows = [(1, long[0]), (1, long[1]), (1, long[1]), (2, long[0] + " x"), (3, long[1]), (4, long[2]), (1, None), (None, long[0])]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    left = sorted(((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, docs, SF).collect()), key=repr)
    assert left == sorted([(1, long[0]), (1, long[1]), (1, None), (4, long[2]), (None, long[0])], key=repr)


def test_spent_tables_go(spark, tmp_path, monkeypatch):
    """What a run leaves in the shared folder is what its result still reads."""
    from foldmill.sources import shared

    monkeypatch.setattr(shared, "shared_dir", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, f"{DATA}/sf0.001")
    names = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert "foldmill-mixture" in names and not names & {f"foldmill-{n}" for n in ("quality", "near_copies", "test_leaks", "members", "of-set")}
    assert out.count() > 0
    with shared.spent_tables() as made:
        kept, gone = (shared.materialise(spark.range(3).toDF("x"), n) for n in ("kept", "gone"))
        made.remove(kept)
    assert kept.count() == 3 and gone.columns == ["x"] and not list(tmp_path.glob("foldmill-gone*"))


def test_registered():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5
    assert quality_rules.CUT_OFF == 0.3
