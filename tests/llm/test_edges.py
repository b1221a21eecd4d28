"""Every operator and every pipeline stage on nulls, empty and long texts, repeats, clashing columns and empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foldmill.llm import decontaminate, jaccard, kd_shards, licenses, mixing, quality_rules, secrets_crf, token_counts, toxicity
from foldmill.llm.quality_rules import RuleModel
from foldmill.llm.toxicity import ToxicityModel
from tests.conftest import DATA

LONG = "alpha beta gamma delta " * 5000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 3),
    (2, "one two three four five six seven", "en", None, None),
    (3, None, None, "b", 1),
    (4, "", "de", "b", 0),
    (5, " \n\t ", "de", "b", 0),
    (6, LONG, "en", "a", len(LONG)),
    (7, "nospaces" * 3000, "en", "a", 24000),
    (None, "no id here but some words", "en", "c", 1),
    (8, "twice the same row", "en", "c", 1),
    (8, "twice the same row", "en", "c", 1),
    (2**60 + 1, "a large id 日本語 😀", "fr", "\x00odd", 1),
]
CLASHING = ["score", "size", "key", "band", "bucket", "row", "shard", "slot", "copies", "taken", "label", "rep", "n", "id", "kept id", "rule score", "count words"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in CLASHING})


def field():
    import numpy as np

    return secrets_crf.fit_field([np.zeros(secrets_crf.PER_TOKEN, np.int32)], [np.array([1])])


def operators():
    import public_tokenizers

    rules = RuleModel((((("words", ">", 2.0),), 1.5),), 0.0)
    items = [(1, "one two three four five six seven"), (2, None), (None, "x y"), (3, "")]
    return {
        "mix": lambda s, d: mixing.mix_sources(d),
        "mixed rows": lambda s, d: mixing.mixed_rows(d),
        "licenses": lambda s, d: licenses.scan_licenses(d),
        "leaks": lambda s, d: decontaminate.find_leaks(d, s.createDataFrame(items, "item_id long, text string")),
        "drop leaks": lambda s, d: decontaminate.drop_leaks(d, s.createDataFrame(items, "item_id long, text string")),
        "quality": lambda s, d: quality_rules.score_quality(d, rules),
        "keep good": lambda s, d: quality_rules.keep_good(d, rules),
        "jaccard": lambda s, d: jaccard.jaccard_components(d),
        "tokens": lambda s, d: token_counts.count_tokens(d, public_tokenizers.path("piece_bpe_32k.model")),
        "secrets": lambda s, d: secrets_crf.scan_secrets(d, field()),
        "toxicity": lambda s, d: toxicity.score_toxicity(d, ToxicityModel({"row": 2.0}, -1.0)),
        "shards": lambda s, d: kd_shards.kd_shards(d, shards=4),
    }


FILTERS = {"mixed rows", "drop leaks", "keep good"}


@pytest.mark.parametrize("name", list(operators()))
def test_edges(spark, docs, name):
    run = operators()[name]
    rows = run(spark, docs).collect()
    if name in FILTERS:
        assert list(rows[0].asDict()) == docs.columns
    else:
        assert len(rows) == len(ROWS)
        assert sum(r.doc_id is None for r in rows) == 1 and sum(r.doc_id == 2**60 + 1 for r in rows) == 1
    empty = run(spark, docs.limit(0))
    assert empty.collect() == [] and set(empty.columns) == (set(rows[0].asDict()))


def test_defined_results(spark, docs):
    import public_tokenizers

    j = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs).collect()}
    assert j[2] == (3, 1) and (j[3], j[4], j[5]) == ((0, 3), (0, 4), (0, 5))
    assert j[None] == (2, None) and j[8] == (1, 8) and j[7] == (1, 7) and j[2**60 + 1][1] == 2**60 + 1
    m = {r.doc_id: r for r in mixing.mix_sources(docs).where("doc_id is not null").collect()}
    assert m[3].taken == 0 and m[4].size == 0 and m[2].source_size == 7 and m[2].target <= 21
    t = {r.doc_id: (r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model")).collect()}
    assert t[3] == t[4] == (0, 0) and t[5][1] > 0
    q = {r.doc_id: r.score for r in quality_rules.score_quality(docs, RuleModel((((("words", ">", 2.0),), 1.5),), 0.0)).collect()}
    assert q[3] == q[4] == q[5] == 0.5 and q[1] > 0.8
    x = {r.doc_id: r for r in toxicity.score_toxicity(docs, ToxicityModel({"row": 2.0}, -1.0)).collect()}
    assert x[3].predicted == 0 and x[8].predicted == 1
    leaks = {r.doc_id: r.item_ids for r in operators()["leaks"](spark, docs).collect()}
    assert leaks[1] == leaks[2] == [1] and leaks[3] == leaks[6] == []
    k = kd_shards.kd_shards(docs, shards=4).where("doc_id = 3").first()
    assert (k["size"], k.text_crc32) == (16, 0)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages(spark, docs, name, stage):
    out = stage(spark, docs, f"{DATA}/sf0.001")
    if name != "shards":
        assert out.columns == docs.columns
    rows = out.collect()
    assert name in ("quality", "mixture") or len(rows) > 0
    if name == "near_copies":
        ids = [r.doc_id for r in rows]
        assert 1 in ids and 2 not in ids and ids.count(8) == 1 and ids.count(None) == 1 and {3, 4, 5} <= set(ids)
    assert stage(spark, docs.limit(0), f"{DATA}/sf0.001").collect() == []
