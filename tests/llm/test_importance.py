import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foldmill.llm import importance
from foldmill.llm.common import ascii_lower
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    w = WORD.findall(ascii_lower(text or ""))
    return len(w), [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def bucket(feature):
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % 10000


def brute(docs, target, least=20):
    raw, goal = (Counter(bucket(f) for t in texts for f in features(t)[1]) for texts in ([t for _, t in docs], target))
    s_all, t_all = sum(raw.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1.0) * (s_all + 10000.0) / ((raw[b] + 1.0) * (t_all + 10000.0))))
    rows = []
    for i, t in docs:
        n, fs = features(t)
        w = sum(gain(bucket(f)) for f in fs)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= least])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: 5 * len(able) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def test_query_like_brute_force(spark):
    sf = f"{DATA}/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = QUERIES["op12_importance_sample"](spark, sf)
    assert got.dtypes == [(c, "bigint") for c in ("doc_id", "n_features", "weight", "score", "rank")]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)


def test_edges(spark, monkeypatch):
    long = "Alpha béta gamma delta, " * 900
    docs = [(1, None), (2, ""), (3, " -- "), (4, long), (5, "x" * 5000 + " y " + "日本" * 400), (None, long), (7, long), (7, long), (2**60 + 1, long)]
    docs += [(10 + i, f"word{i % 7} " * 25) for i in range(80)] + [(None, "null id " * 30)] * 40
    target = ["alpha BÉTA", None, "", "null id null"]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("score", "rank", "row", "place", "part", "start", "n_words")})
    items = spark.createDataFrame([(t,) for t in target], "text string")
    monkeypatch.setattr(importance, "TRIE_WORDS", 50)
    monkeypatch.setattr(importance, "PIECE", 100)
    got = importance.importance_sample(df.repartition(4), items)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, target)
    assert importance.importance_sample(df.limit(0), items).collect() == []
    assert importance.importance_sample(df.limit(5), items.limit(0)).where("rank is not null").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abA1é .\n日x", max_size=60)), max_size=6), st.integers(1, 6), st.integers(1, 12))
def test_tries_hold_every_feature(texts, most, piece):
    """Counts and CRC states of all nodes, however the texts are cut into stretches."""
    old = importance.TRIE_WORDS, importance.PIECE
    importance.TRIE_WORDS, importance.PIECE = most, piece
    try:
        words, got = importance.Words(), Counter()
        for stretch in importance.stretches(words, [t and t.encode() for t in texts]):
            for level in importance.trie_levels(words, *stretch):
                for s, n in zip(level.state, level.counts()):
                    got[int(s)] += int(n)
        assert +got == Counter(zlib.crc32(f.encode()) for t in texts for f in features(t)[1])
    finally:
        importance.TRIE_WORDS, importance.PIECE = old


def test_appending_to_a_state():
    words, rng = importance.Words(), np.random.RandomState(0)
    names = [bytes(rng.randint(97, 123, n)) for n in (1, 2, 5, 47, 48, 49, 200)]
    ids = np.array([words[w] for w in names])
    start = np.full(len(ids), zlib.crc32(b"begin"), np.uint32)
    assert words.append(start, ids).tolist() == [zlib.crc32(b"begin " + w) for w in names]
