import random
import re

import numpy as np
import pytest

from foldmill.llm import jaccard
from tests.conftest import DATA


def shingles(text, width):
    """Sets of word tuples, by the rule and not by the code under test."""
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(width, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def brute(rows, width, num, den):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and (den * both >= num * (len(sets[i]) + len(sets[j]) - both)):
                parent[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[find(i)] = min(d, low.get(find(i), d))
    return {d: (len(sets[i]), low[find(i)]) for i, (d, _) in enumerate(rows)}


@pytest.mark.parametrize("width,num,den,seed", [(4, 85, 100, 0), (5, 80, 100, 1), (1, 50, 100, 2), (2, 95, 100, 3)])
def test_like_all_pairs(spark, width, num, den, seed):
    r = random.Random(seed)
    words, rows = [f"w{i}" for i in range(400)], []
    for _ in range(25):
        base = [r.choice(words) for _ in range(r.choice([3, 8, 20, 60, 150]))]
        for _ in range(r.randrange(1, 9)):
            copy = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 20)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    rows += [(2000, ""), (2001, None), (2002, rows[0][1].upper())]
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), width, num, den).collect()}
    assert got == brute(rows, width, num, den)


@pytest.mark.parametrize("seed", [5])
def test_large_tiles_and_shared_heads_like_all_pairs(spark, monkeypatch, seed):
    """The ways for tiles of many sets and heads of many members, from the third member on; unlike texts share a passage."""
    monkeypatch.setattr(jaccard, "FULL", 2)
    monkeypatch.setattr(jaccard, "SHARED", 2)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 1)
    r = random.Random(seed)
    words, rows = [f"w{i}" for i in range(300)], []
    passage = [r.choice(words) for _ in range(40)]
    for _ in range(8):
        base = [r.choice(words) for _ in range(30)] + passage
        for _ in range(12):
            copy = list(base)
            for _ in range(r.randrange(0, 4)):
                copy[r.randrange(len(copy))] = r.choice(words)
            rows.append((len(rows) * 7 % 1009, " ".join(copy)))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 75, 100).collect()}
    want = brute(rows, 3, 75, 100)
    assert got == want and 1 < len({c for _, c in want.values()}) < 96


@pytest.mark.parametrize("full,block", [(0, 3), (2, 256), (256, 2)])
def test_repeated_ids_with_several_texts(spark, monkeypatch, full, block):
    """Links of each text of an id are found, however large its tiles are; an id's texts belong together."""
    monkeypatch.setattr(jaccard, "FULL", full)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "STAR_ROUNDS", 0)
    r = random.Random(7)
    words = [f"w{i}" for i in range(500)]
    bases, rows = [[r.choice(words) for _ in range(40)] for _ in range(10)], []
    for i in range(40):
        copy = list(bases[i % 10])
        copy[r.randrange(40)] = r.choice(words)
        rows.append((i, " ".join(copy)))
        rows.append((i, " ".join(r.choice(words) for _ in range(400))))  # an unlike second text under the same id
    rows += [(100, rows[0][1]), (101, rows[1][1]), (101, rows[4][1])]  # one that brings two ids together
    got = {(x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 75, 100).collect()}
    sets, parent = [shingles(t, 3) for _, t in rows], {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(rows[i][0]), find(rows[j][0])))
                parent[b] = a
    want = {(d, len(s), find(d)) for (d, _), s in zip(rows, sets)}
    assert got == want and len({c for *_, c in want}) < 42


def test_documents_like_all_pairs(spark):
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 4, 85, 100).collect()}
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], 4, 85, 100)


def test_linked_sets_share_a_tile():
    rng = np.random.RandomState(0)
    for _ in range(300):
        n = int(rng.choice([6, 7, 12, 40, 200, 900]))
        a = np.unique(rng.randint(0, 2**63, n).astype(np.uint64))
        d = max(1, 3 * 2 * n // 37)
        for drop in range(min(d, 4) + 1):
            b = np.unique(np.r_[a[drop:], rng.randint(0, 2**63, max(0, d - drop - rng.randint(2))).astype(np.uint64)])
            if len(a) != len(b) and jaccard.link(a, b, 85, 100) or jaccard.link(a, b, 85, 100) and (a != b).any():
                assert set(jaccard.tiles_of(a, 85, 100).tolist()) & set(jaccard.tiles_of(b, 85, 100).tolist())


def test_bitmaps_never_reject_a_link(spark):
    from pyspark.sql import functions as F

    rng, rows = np.random.RandomState(1), []
    for _ in range(120):
        n = int(rng.choice([10, 63, 64, 65, 130, 700]))
        a = np.unique(rng.randint(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.r_[a[rng.randint(0, 1 + n // 8) :], rng.randint(0, 2**63, rng.randint(0, 1 + n // 8)).astype(np.uint64)])
        rows.append((len(a), len(b), jaccard.bitmap(a).tolist(), jaccard.bitmap(b).tolist(), jaccard.link(a, b, 85, 100), len(np.setxor1d(a, b))))
    df = spark.createDataFrame(rows, "na long, nb long, a array<long>, b array<long>, linked boolean, d int")
    room = jaccard.may_link(F.col("na"), F.col("nb"), F.col("a"), F.col("b"), 85, 100)
    assert df.where(F.col("linked") & ~room).count() == 0
    assert df.where(jaccard.differing_bits(F.col("a"), F.col("b")) > F.col("d")).count() == 0


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 7), (200, 201)]
    got = {r.id: r.comp for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys([*range(41), 100], 0) | {200: 200, 201: 200}


def test_tiles_cut_by_partitions_keep_one_head(spark):
    """One tile that most sets share, dealt over many partitions, and tiles of one, two and three sets."""
    rows = [(k, [7]) for k in range(300)] + [(1000 + k, [100 + k // (1 + k % 3), 7 if k % 2 else 8]) for k in range(90)]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        made = []
        sets = spark.createDataFrame(rows, "rep long, keys array<long>").repartition(5)
        got = sorted(map(tuple, jaccard.shared_tiles(sets, made).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    by = {}
    for rep, keys in rows:
        for key in keys:
            by.setdefault(key, []).append(rep)
    assert got == sorted((key, rep, min(reps)) for key, reps in by.items() if len(reps) > 1 for rep in reps)
    assert made[0].where("cut").select("key").distinct().count() > 1
