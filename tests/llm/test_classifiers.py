import numpy as np
import pytest
from pyspark.sql import functions as F

from foldmill.llm import quality_rules, toxicity
from foldmill.llm.common import crc_mod
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA


@pytest.mark.parametrize("name,label,mod,least", [("op5_quality_rules", "quality", (5, 0), 0.97), ("op9_toxicity", "toxic", (4, 2), 0.95)])
def test_held_out(spark, name, label, mod, least):
    import zlib

    got = QUERIES[name](spark, f"{DATA}/sf0.1").toPandas().set_index("doc_id")
    labels = spark.read.parquet(f"{DATA}/sf0.1/labels.parquet").toPandas().set_index("doc_id")[label]
    assert len(got) == 10000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    assert all((zlib.crc32(str(i).encode()) % mod[0] == mod[1]) == h for i, h in got.held_out.items())
    both = got.join(labels, how="inner")
    held = both[both.held_out]
    assert (held.predicted == held[label]).mean() >= least


def test_quality_rescored_by_hand(spark):
    """The query's scores again: statistics by another library's patterns, rules as numpy masks."""
    import regex

    sf = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = quality_rules.train(docs, labels.where(crc_mod(F.col("doc_id"), 5) != 0))
    rows = docs.select("doc_id", "text").collect()
    names = ["words", "word_length", *[n for n in quality_rules.COUNTED if n != "words"]]
    table = []
    for r in rows:
        n = {k: len(regex.findall(p, r.text, flags=0 if k == "capitals" else regex.ASCII)) for k, p in quality_rules.COUNTED.items()}
        chars, words = max(len(r.text), 1), n["words"]
        table.append([words, len(r.text) / words if words else 0.0, *[n[k] / (max(words, 1) if k in ("repeats", "marked_words") else chars) for k in names[2:]]])
    x = np.array(table, float)
    z = model.intercept + sum(w * quality_rules.holds(rule, x, names) for rule, w in model.rules)
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op5_quality_rules"](spark, sf).collect()}
    want = 1 / (1 + np.exp(-z))
    assert len(model.rules) and len(got) == len(rows)
    off = [r.doc_id for r, s in zip(rows, want) if abs(got[r.doc_id][0] - s) > 1e-9 or got[r.doc_id][1] != int(s >= 0.3)]
    assert not off


def test_toxicity_rescored_by_hand(spark):
    """The query's scores again: every word and beginning of a word that has a weight, once a text."""
    import re

    sf = f"{DATA}/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels.where(crc_mod(F.col("doc_id"), 4) != 2))
    got = {r.doc_id: (r.score, r.predicted) for r in QUERIES["op9_toxicity"](spark, sf).collect()}
    assert model.weights and len(got) == docs.count()
    for r in docs.collect():
        words = set(re.findall(r"[^\W\d_]+", r.text.lower()))
        known = words | {w[:4] + "*" for w in words if len(w) > 5}
        s = 1 / (1 + np.exp(-(model.intercept + sum(w for f, w in model.weights.items() if f in known))))
        assert abs(got[r.doc_id][0] - s) < 1e-9 and got[r.doc_id][1] == int(s >= 0.3)


def test_training_on_hard_tables(spark):
    """Nulls, empty, very long and repeated texts, clashing columns, no rows: both classifiers are fitted, and many sentences are bounded."""
    long = "the women here are wretched. some men say so. " * 3000
    rows = [(i, t) for i, t in enumerate([None, "", long, long, "calm words", "wretched folk", "calm", "x" * 50_000] * 6)] + [(3, long), (None, "no id")]
    clash = {c: F.lit("x") for c in ("y", "label", "own", "sentence", "words", "n", "score", "features")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    for module, label in ((quality_rules, "quality"), (toxicity, "toxic")):
        marks = [(i, int("wretched" in (t or ""))) for i, t in rows if i is not None] + [(None, 1), (1, None)]
        labels = spark.createDataFrame(marks, f"doc_id long, {label} int").withColumns({c: F.lit("x") for c in ("text", "y", "n")})
        model = module.train(docs, labels)
        score = quality_rules.score_quality if module is quality_rules else toxicity.score_toxicity
        assert score(docs, model).count() == len(rows) and score(docs, module.train(docs.limit(0), labels)).count() == len(rows)
        assert score(docs, module.train(docs, labels.limit(0))).count() == len(rows)


def test_no_labels_and_one_class(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert [r.score for r in quality_rules.score_quality(docs, quality_rules.train(docs, labels)).collect()] == [0.5, 0.5]
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.predicted == 1 for r in quality_rules.score_quality(docs, quality_rules.train(docs, one)).collect())
    assert toxicity.score_toxicity(docs, toxicity.train(docs, labels.withColumnRenamed("quality", "toxic"))).count() == 2


def test_rules_are_sparse_and_conjunctive():
    rng = np.random.RandomState(0)
    x = rng.rand(2000, 4)
    y = ((x[:, 0] > 0.5) & (x[:, 1] <= 0.3)).astype(float)
    model = quality_rules.fit_rules(x, y, ["a", "b", "c", "d"])
    assert any(len(rule) >= 2 for rule, _ in model.rules)
    margin = model.intercept + sum(w * quality_rules.holds(r, x, ["a", "b", "c", "d"]) for r, w in model.rules)
    assert ((margin > 0) == (y == 1)).mean() > 0.97
    assert len(model.rules) < 120


def test_counterfactual_penalty(spark):
    """Labels that lean on an identity term by chance: the penalty takes its weight away, the insult keeps its own."""
    rng, rows, labels = np.random.RandomState(1), [], []
    for i in range(600):
        toxic = int(rng.rand() < 0.4)
        term = "muslims" if rng.rand() < (0.8 if toxic else 0.2) else "christians"
        insult = "wretched" if toxic and rng.rand() < 0.7 else "calm"
        rows.append((i, f"people say {term} here are {insult} folk word{rng.randint(50)}."))
        labels.append((i, toxic))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    free, held = toxicity.train(docs, labels, strength=0.0), toxicity.train(docs, labels)
    gap = lambda m: abs(m.weights.get("muslims", 0) - m.weights.get("christians", 0))
    assert gap(free) > 1 and gap(held) < 0.2 * gap(free) and held.weights["wretched"] > 1
    s = toxicity.Scorer(held)
    assert abs(s("muslims here") - s("christians here")) < 0.1


def test_swaps():
    assert toxicity.swaps("The women met. Nothing here.", [("women", "men")]) == [("women", "men")]
    assert toxicity.swaps("women and men", [("women", "men")]) == []
    assert toxicity.swaps(None) == []


def test_penalty_is_on_score_changes():
    """Derivatives of the penalty against differences."""
    swapped = toxicity.Swapped(np.array([0, 0, 1]), np.array([0, 1, 2]), np.array([0, 0, 1]), np.array([0, 0, 1, 2]), np.array([0, 3, 4, 2]), np.array([-1.0, 1, 1, -1]))
    w, b, e = np.array([0.3, -1.2, 2.0, 0.7, -0.4]), 0.3, 1e-6
    score = lambda z: 1 / (1 + np.exp(-z))
    # two swaps of the first sentence (features 0, 1): 0 for 3, and 4 added; one of the second: 2 taken away
    moves = [score(w[1] + w[3] + b) - score(w[0] + w[1] + b), score(w[0] + w[1] + w[4] + b) - score(w[0] + w[1] + b), score(b) - score(w[2] + b)]
    value, by_w, by_b = swapped.penalty(w, b)
    assert value == pytest.approx(np.mean(np.square(moves)))
    assert by_w == pytest.approx([(swapped.penalty(w + e * d, b)[0] - value) / e for d in np.eye(5)], abs=1e-5)
    assert by_b == pytest.approx((swapped.penalty(w, b + e)[0] - value) / e, abs=1e-5)


def test_neutral_mentions_in_whole_texts(spark):
    """Mentions of groups put into the given documents, mostly one group's into toxic ones: neutral sentences score alike with the penalty only."""
    docs, labels = spark.read.parquet(f"{DATA}/sf0.1/documents.parquet"), spark.read.parquet(f"{DATA}/sf0.1/labels.parquet")
    leaning = F.when(crc_mod(F.col("doc_id"), 10) < F.when(F.col("toxic") == 1, 8).otherwise(2), "muslims").otherwise("christians")
    docs = docs.join(labels, "doc_id").select("doc_id", F.concat("text", F.lit("\nMy neighbours are "), leaning, F.lit(".")).alias("text")).checkpoint()
    seen = labels.where(crc_mod(F.col("doc_id"), 4) != 2)
    free, held = (toxicity.train(docs, seen, strength=s) for s in (0.0, toxicity.COUNTERFACTUAL))

    def change(model):
        s = toxicity.Scorer(model)
        return abs(s("The muslims opened a school.") - s("The christians opened a school."))

    assert change(held) < 0.2 * change(free) and change(held) < 0.01
    both = toxicity.score_toxicity(docs, held).join(labels.where(crc_mod(F.col("doc_id"), 4) == 2), "doc_id").toPandas()
    assert (both.predicted == both.toxic).mean() >= 0.95
