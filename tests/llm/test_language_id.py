import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from foldmill.llm import language_id
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def all_segmentations(word, pieces, p):
    """Sum over every way to cut the marked word, by plain recursion; and expected uses by piece."""
    known = {name: k for k, name in enumerate(pieces.names)}
    whole = language_id.START + word

    def ways(at):
        if at == len(whole):
            yield 1.0, []
            return
        for end in range(at + 1, len(whole) + 1):
            part = whole[at:end]
            k = known.get(part, pieces.size - 1 if end == at + 1 and part not in pieces.single else None)
            if k is not None:
                for q, rest in ways(end):
                    yield p[k] * q, [k, *rest]

    found = list(ways(0))
    total, uses = sum(q for q, _ in found), {}
    for q, ks in found:
        for k in ks:
            uses[k] = uses.get(k, 0.0) + q / total
    return total, uses


def test_forward_and_expected_counts_like_enumeration():
    pieces = language_id.pieces_of(MODEL)
    rng = np.random.RandomState(0)
    p = rng.rand(pieces.size, 2) ** 8
    p /= p.sum(0)
    words = ["the", "a", "straße", "ouvertur", "日本x", "\U00010348q", "niño", "zzz"]
    lattice = pieces.lattice(words)
    got, uses = lattice.log_sums(p), [lattice.expected(p[:, [c]], np.ones((len(words), 1)))[:, 0] for c in (0, 1)]
    for w, word in enumerate(words):
        for c in (0, 1):
            total, want = all_segmentations(word, pieces, p[:, c])
            assert math.isclose(got[w, c], math.log(total), rel_tol=1e-9)
            mine = {}
            for k, u in zip(lattice.piece[lattice.word == w], uses[c][lattice.word == w]):
                mine[int(k)] = mine.get(int(k), 0.0) + u
            assert set(mine) == set(want) and all(math.isclose(mine[k], want[k], rel_tol=1e-9) for k in want)


def test_long_words_do_not_vanish():
    pieces = language_id.pieces_of(MODEL)
    p = np.full((pieces.size, 1), 1 / pieces.size)
    short, plain = pieces.lattice(["abcabcabc"]).log_sums(p)[0, 0], language_id.PLAIN
    language_id.PLAIN = 0
    try:
        assert math.isclose(pieces.lattice(["abcabcabc"]).log_sums(p)[0, 0], short, rel_tol=1e-9)
    finally:
        language_id.PLAIN = plain
    one, two = (pieces.lattice(["ab" * n]).log_sums(p)[0, 0] for n in (3000, 6000))
    assert np.isfinite(two) and 1.9 < two / one < 2.1


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_held_out(spark, sf):
    got = QUERIES["op13_language_id"](spark, f"{DATA}/{sf}")
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    docs = spark.read.parquet(f"{DATA}/{sf}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").toPandas()
    assert len(rows) == docs.count() and rows.score.between(0, 1).all()
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == h for i, h in zip(rows.doc_id, rows.held_out))
    assert (rows.lang_pred == rows.lang)[rows.held_out].mean() > 0.97


def test_query_scores_like_enumeration(spark):
    """The query's answers again from its model, word by word without lattices."""
    sf = f"{DATA}/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.where("crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2"), MODEL)
    pieces, got = language_id.pieces_of(MODEL), {r.doc_id: r for r in QUERIES["op13_language_id"](spark, sf).collect()}
    assert np.allclose(model.p.sum(0), 1)
    checked = 0
    for r in sorted(docs.collect(), key=lambda r: len(r.text)):
        words = language_id.words_of(r.text)
        if not words or max(map(len, words)) > 10:
            continue
        checked += 1
        if checked > 8:
            break
        log = [model.prior[c] + sum(math.log(all_segmentations(w, pieces, model.p[:, c])[0]) for w in words) for c in range(len(model.languages))]
        assert got[r.doc_id].lang_pred == model.languages[int(np.argmax(log))]
        assert math.isclose(got[r.doc_id].score, 1 / sum(math.exp(x - max(log)) for x in log), rel_tol=1e-6)


def test_edges(spark):
    rows = [(1, "eins zwei drei vier", "de"), (2, "one two three four", "en"), (3, None, "en"), (4, "", None), (5, "12 34 -- _", "de"), (6, "nospaces" * 4000, "en"), (7, "one two three four", "en"), (7, "one two three four", "en"), (None, "zwei", "de"), (2**60 + 1, "日本語 four three two one", None), (9, "drei " * 20000, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("x") for c in ("score", "lang_pred", "word", "n", "piece", "uses")})
    model = language_id.train(docs, MODEL)
    got = {r.doc_id: r for r in language_id.identify(docs, model).collect()}
    assert len(got) == 10 and language_id.identify(docs, model).count() == len(rows)
    assert got[1].lang_pred == got[None].lang_pred == got[9].lang_pred == "de" and got[2].lang_pred == got[6].lang_pred == got[2**60 + 1].lang_pred == "en"
    assert all((got[k].lang_pred, got[k].score) == ("und", 0.0) for k in (3, 4, 5))
    assert language_id.identify(docs.limit(0), model).collect() == []
    nothing = language_id.train(docs.limit(0), MODEL)
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, nothing).collect()} == {("und", 0.0)}
    one = language_id.train(docs.where("lang = 'de'"), MODEL)
    assert {r.score for r in language_id.identify(docs.where("doc_id in (1, 2)"), one).collect()} == {1.0}
