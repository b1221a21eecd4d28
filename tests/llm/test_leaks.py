import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from foldmill.llm import decontaminate
from foldmill.llm.decontaminate import ItemIndex, Searcher, find_leaks
from foldmill.llm.queries import QUERIES
from tests.conftest import DATA


def test_wand_finds_what_scoring_all_finds():
    r = random.Random(0)
    words = [f"w{int(r.expovariate(0.05))}" for _ in range(3000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(5, 60))) + ". " + r.choice(words)) for i in range(150)]
    index = ItemIndex(items)
    searcher = Searcher(index, 64, 32)
    for _ in range(200):
        passage = [r.choice(words) for _ in range(30)] + (index.words[r.randrange(150)][: r.randrange(40)])
        r.shuffle(passage)
        terms = sorted({index.term[w] for w in passage if w in index.term})
        score = np.zeros(150)
        for t in terms:
            score[index.docs[t]] += index.impacts[t]
        want = {d for d in range(150) if score[d] >= index.threshold[d]}
        assert {d for d, _ in index.wand(terms, 0, 150)} == want
        # the screen by blocks loses none of them
        text = " ".join(passage[:64])
        seen = {int(b) for _, _, blocks in searcher.candidates(searcher.ids(text)) for b in blocks}
        own = np.zeros(150)
        for t in sorted({index.term[w] for w in passage[:64] if w in index.term}):
            own[index.docs[t]] += index.impacts[t]
        assert {d // index.block for d in range(150) if own[d] >= index.threshold[d]} <= seen


def test_planted_leaks(spark):
    items = spark.read.parquet(f"{DATA}/sf0.01/benchmark.parquet")
    texts = [(r.item_id, r.text) for r in items.collect()]
    clean = [r.text for r in spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect() if not any(t in r.text for _, t in texts)][:60]
    rows, want, r = [], {}, random.Random(2)
    for k, (i, t) in enumerate(texts):
        words = clean[k % len(clean)].split()
        at = r.randrange(len(words) + 1)
        rows.append((k, " ".join([*words[:at], t.upper() if k % 3 == 0 else t.replace(",", " ,"), *words[at:]])))
        want[k] = i
    rows += [(1000 + k, t) for k, t in enumerate(clean)]
    got = {x.doc_id: x for x in find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert all(want[k] in got[k].item_ids and got[k].leaked and got[k].score > 0 for k in want)
    assert not any(got[1000 + k].leaked for k in range(len(clean)))


def test_question_and_answer_are_both_needed():
    q, a = decontaminate.question_and_answer("What is the long river of the north called? It is called the Ob river.")
    assert q == "what is the long river of the north called".split() and a == "it is called the ob river".split()
    other = [(k, f"filler{k} something else entirely {k} goes here now. Fine{k}.") for k in range(9)]
    s = Searcher(ItemIndex([(0, "What is the long river of the north called? It is called the Ob river."), *other]), 64, 32)
    assert [s.index.ids[i] for i, _ in s.leaks("so: what is the long river of the north called it is called the ob river")] == [0]
    assert s.leaks("a long river is called something in the north of what it is") == []


def test_more_items_than_one_index(spark):
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.01/documents.parquet")
    exact = {d.doc_id for d in docs.collect() if any(i.text in d.text for i in items.collect())}
    one = {r.doc_id for r in find_leaks(docs, items).where("leaked").collect()}
    several = {r.doc_id for r in find_leaks(docs, items, index_bytes=3000).where("leaked").collect()}
    assert exact and exact <= one and exact <= several
    assert len(one - exact) <= 2


def test_long_texts_are_screened_in_parts(monkeypatch):
    r = random.Random(5)
    words = [f"w{int(r.expovariate(0.02))}" for _ in range(3000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(8, 40))) + ". " + r.choice(words)) for i in range(60)]
    searcher = Searcher(ItemIndex(items), 64, 32)
    texts = [" ".join(r.choice(words) for _ in range(n)) for n in (0, 1, 31, 32, 33, 64, 65, 500, 4000)]
    texts += [texts[-1] + " " + items[3][1] + " " + texts[-2], " ".join(t for _, t in items) * 3]

    def seen():
        return [([(s, e, b.tolist()) for s, e, b in searcher.candidates(searcher.ids(t))], searcher.leaks(t)) for t in texts if t]

    monkeypatch.setattr(decontaminate, "SCREENED", 10**9)
    whole = seen()
    monkeypatch.setattr(decontaminate, "SCREENED", 3)
    assert seen() == whole
    assert 3 in [searcher.index.ids[i] for i, _ in searcher.leaks(texts[-2])]
    assert {searcher.index.ids[i] for i, _ in searcher.leaks(texts[-1])} == set(range(60))


def test_answer_far_from_its_question():
    question, answer = [f"q{k}" for k in range(18)], [f"a{k}" for k in range(12)]
    other = [(k, f"filler{k} something else entirely {k} goes here now. Fine{k}.") for k in range(1, 9)]
    s = Searcher(ItemIndex([(0, " ".join(question) + "? " + " ".join(answer) + "."), *other]), 64, 32)
    between = [f"between{k}" for k in range(500)]
    for parts in ((question, between, answer), (answer, between, question), (between, question, between, answer, between)):
        assert [s.index.ids[i] for i, _ in s.leaks(" ".join(w for p in parts for w in p))] == [0]
    assert s.leaks(" ".join(question + between)) == [] and s.leaks(" ".join(answer + between)) == []


def test_number_of_indexes_changes_nothing(spark):
    items = spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet")
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").withColumn("row", F.lit("x"))
    docs = docs.unionAll(docs.limit(3))
    size = sum(len(i.text.encode()) for i in items.collect())
    one = [(r.doc_id, r.leaked, r.item_ids, round(r.score, 9)) for r in find_leaks(docs, items).collect()]
    several = [(r.doc_id, r.leaked, r.item_ids, round(r.score, 9)) for r in find_leaks(docs, items, index_bytes=size // 3).collect()]
    assert any(r[1] for r in one) and sorted(several) == sorted(one)
    kept = decontaminate.drop_leaks(docs, items, index_bytes=size // 3)
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(decontaminate.drop_leaks(docs, items).collect())


def test_query_like_scoring_every_passage_and_item(spark):
    """The registered query against plain BM25 of every item for every passage and n-gram shares by the rule; no code under test."""
    items = {r.item_id: r.text for r in spark.read.parquet(f"{DATA}/sf0.001/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{DATA}/sf0.001/documents.parquet").collect()
    words = lambda t: re.findall(r"\w+", (t or "").lower())
    halves = {}
    for i, t in items.items():
        parts = [w for w in (words(x) for x in re.split(r"(?<=[.?!])\s+|\n+", t)) if w]
        halves[i] = ([w for p in parts[:-1] for w in p], parts[-1]) if len(parts) > 1 else (parts[0], [])
    own = {i: q + a for i, (q, a) in halves.items()}
    holders = Counter(w for x in own.values() for w in set(x))
    n, mean = len(own), sum(map(len, own.values())) / len(own)

    def impact(i, w):
        tf = own[i].count(w)
        return math.log(1 + (n - holders[w] + 0.5) / (holders[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(own[i]) / mean))

    impacts = {i: {w: impact(i, w) for w in set(x)} for i, x in own.items()}
    least = {i: 0.5 * sum(x.values()) * min(1, 32 / len(own[i])) for i, x in impacts.items()}
    grams = lambda x, k: {tuple(x[j : j + k]) for j in range(len(x) - k + 1)}
    got = {r.doc_id: r for r in QUERIES["op4_benchmark_leaks"](spark, f"{DATA}/sf0.001").collect()}
    assert any(r.leaked for r in got.values())
    for d in docs:
        text, found = words(d.text), {}
        everywhere = grams(text, 5)
        for i in own:
            score, spans = 0.0, []
            for at in range(0, max(1, len(text) - 32), 32):
                here = set(text[at : at + 64])
                s = sum(x for w, x in impacts[i].items() if w in here)
                if s >= least[i]:
                    score = max(score, s)
                    spans.append((max(0, at - len(own[i])), at + 64 + len(own[i])))
            if not spans:
                continue
            near = lambda k: {g for a, b in spans for g in grams(text[a:b], k)}  # noqa: B023, E731

            def share(part, far):
                k = min(5, len(part))
                mine = grams(part, k) if part else set()
                return sum(g in near(k) or (far and g in everywhere) for g in mine) / len(mine) if mine else 1.0  # noqa: B023

            q, a = halves[i]
            if share(own[i], False) >= 0.7 or (share(q, True) >= 0.5 and share(a, True) >= 0.5):
                found[i] = score
        r = got[d.doc_id]
        assert (r.leaked, r.item_ids) == (bool(found), sorted(found)), d.doc_id
        assert abs(r.score - max(found.values(), default=0.0)) < 1e-6
