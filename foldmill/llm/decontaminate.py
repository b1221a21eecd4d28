"""Benchmark decontamination: BM25 over the test items, searched with block-max WAND."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from foldmill.llm.common import drop_table, filter_texts, map_texts, materialise, unused

#: Words of a passage and the step from one to the next.
PASSAGE, STEP = 64, 32
#: A passage retrieves an item at this share of what the item scores against itself.
SHARE = 0.5
#: BM25.
K1, B = 1.2, 0.75
#: Posting blocks of an index, at most, and the fewest items of one.
BLOCKS, LEAST_ITEMS = 100, 2
#: Words of the n-grams that verify, and the least shares of a leak.
GRAM, BOTH, WHOLE = 5, 0.5, 0.7
#: Columns of a search.
FOUND = "leaked boolean, item_ids array<long>, score double"
#: Bytes of item texts that one broadcast index holds; more items make more indexes.
INDEX_BYTES = 2_000_000

WORD = re.compile(r"\w+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")
KEPT_WORDS = 400_000
#: Steps of a text that are screened at once.
SCREENED = 1024


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    """The words of an item: its last sentence is the answer, what comes before the question."""
    parts = [w for w in (words_of(s) for s in SENTENCE_END.split(text or "")) if w]
    if len(parts) < 2:
        return (parts[0] if parts else []), []
    return [w for p in parts[:-1] for w in p], parts[-1]


def grams(words: list[str], n: int = GRAM) -> set[tuple[str, ...]]:
    n = min(n, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


@dataclass(frozen=True)
class Figures:
    """Items that have words, how many words they have together, and how many items hold each word."""

    n: int
    words: int
    holders: dict[str, int]

    @property
    def mean(self) -> float:
        return self.words / max(self.n, 1)


def figures_of(texts: list[str | None]) -> Figures:
    words = [w for w in ([*q, *a] for q, a in map(question_and_answer, texts)) if w]
    holders = Counter(w for own in words for w in set(own))
    return Figures(len(words), sum(map(len, words)), holders)


class ItemIndex:
    """Inverted index of test items with the largest impact of each block of postings.

    ``figures`` of all items score those of a part; without them the items are all there are.
    """

    def __init__(self, items: list[tuple[int, str | None]], passage: int = PASSAGE, share: float = SHARE, figures: Figures | None = None):
        kept = [(i, *question_and_answer(t)) for i, t in items]
        kept = [(i, q, a) for i, q, a in kept if q or a]
        n, all_items = len(kept), figures or figures_of([t for _, t in items])
        holders = all_items.holders

        def impacts(words: list[str]) -> dict[str, float]:
            k = K1 * (1 - B + B * len(words) / all_items.mean)
            return {w: math.log(1 + (all_items.n - holders[w] + 0.5) / (holders[w] + 0.5)) * tf * (K1 + 1) / (tf + k) for w, tf in Counter(words).items()}

        scored = [(i, q, a, impacts(q + a)) for i, q, a in kept]
        # Of an item longer than a passage only as much as surely lies in one passage can be found there.
        reach = [share * sum(x.values()) * min(1.0, (passage / 2) / (len(q) + len(a))) for _, q, a, x in scored]
        # In order of their thresholds, so that the items of a block have much the same.
        order = sorted(range(n), key=lambda k: (reach[k], kept[k][0]))
        self.threshold = [reach[k] for k in order]
        self.ids = [scored[k][0] for k in order]
        self.parts = [(scored[k][1], scored[k][2]) for k in order]
        self.words = [q + a for q, a in self.parts]
        self.block = max(LEAST_ITEMS, math.ceil(n / BLOCKS))
        self.term = {w: t for t, w in enumerate(sorted({w for words in self.words for w in words}))}
        self.docs: list[list[int]] = [[] for _ in self.term]
        self.impacts: list[list[float]] = [[] for _ in self.term]
        for d, k in enumerate(order):
            for w, x in scored[k][3].items():
                self.docs[self.term[w]].append(d)
                self.impacts[self.term[w]].append(x)
        self.top = [max(x) for x in self.impacts]
        #: Largest impact of each term in each block; the last row is for words of no item.
        self.block_max = np.zeros((len(self.term) + 1, math.ceil(n / self.block)), np.float32)
        for t, (docs, own) in enumerate(zip(self.docs, self.impacts)):
            np.maximum.at(self.block_max[t], np.array(docs) // self.block, own)
        self.least = np.array(self.threshold[:: self.block], np.float32)

    def wand(self, terms: list[int], first: int, last: int) -> list[tuple[int, float]]:
        """Items first .. last - 1 that score their threshold or more for a set of terms.

        Lists stand at their next item, ordered by it.  The pivot is where the
        lists' largest impacts first reach the threshold of the item at hand
        (later ones have higher thresholds); if the block maxima at the pivot
        fall short, all lists before it skip the block.
        """
        lists = [[bisect_left(self.docs[t], first), t] for t in terms]
        lists = [x for x in lists if x[0] < len(self.docs[x[1]])]
        out = []
        while lists:
            lists.sort(key=lambda x: self.docs[x[1]][x[0]])
            bound, pivot, ahead = 0.0, last, 0
            for x in lists:
                d = self.docs[x[1]][x[0]]
                if d >= last:
                    break
                bound, ahead = bound + self.top[x[1]], ahead + 1
                if bound >= self.threshold[d]:
                    pivot = d
                    break
            if pivot >= last:
                break
            while ahead < len(lists) and self.docs[lists[ahead][1]][lists[ahead][0]] == pivot:
                ahead += 1
            here, block = lists[:ahead], pivot // self.block
            if sum(float(self.block_max[x[1], block]) for x in here) < self.threshold[pivot] - 1e-4:
                # none of the block can do with these lists: on to the next block, or to where another list stands
                goal = (block + 1) * self.block
                if ahead < len(lists):
                    goal = min(goal, self.docs[lists[ahead][1]][lists[ahead][0]])
            else:
                score = 0.0
                for x in here:
                    docs = self.docs[x[1]]
                    x[0] = bisect_left(docs, pivot, x[0])
                    if x[0] < len(docs) and docs[x[0]] == pivot:
                        score += self.impacts[x[1]][x[0]]
                if score >= self.threshold[pivot] - 1e-9:
                    out.append((pivot, score))
                goal = pivot + 1
            for x in here:
                x[0] = bisect_left(self.docs[x[1]], goal, x[0])
            lists = [x for x in lists if x[0] < len(self.docs[x[1]])]
        return out

    def overlap(self, item: int, words: list[str], far: set[tuple[str, ...]]) -> tuple[float, float, float]:
        """Shares of the item's, its question's and its answer's n-grams that stand in ``words``.

        Questions and answers of ``GRAM`` words or more count wherever they stand
        in the text: ``far`` holds their n-grams that do.  Shorter ones are common
        words, which count in ``words`` only.
        """
        near = {n: grams(words, n) for n in {min(GRAM, len(part)) for part in (self.words[item], *self.parts[item])}}

        def share(part: list[str], there: set[tuple[str, ...]]) -> float:
            own = grams(part)
            return len((own & near[min(GRAM, len(part))]) | (own & there)) / len(own) if own else 1.0

        q, a = self.parts[item]
        return share(self.words[item], set()), share(q, far), share(a, far)


class Searcher:
    """An index with the words a worker has already looked up."""

    def __init__(self, index: ItemIndex, passage: int, step: int):
        if passage % step:
            raise ValueError("a passage is a whole number of steps")
        self.index, self.passage, self.step = index, passage, step
        self.kept: dict[str, int] = {}
        self.several: list[list[int]] = []  # terms of tokens that aren't just one word; token code -1 - k

    def ids(self, text: str) -> np.ndarray:
        """Terms of the words of a text; words of no item get the number after the last."""
        tokens, kept, get, none = text.split(), self.kept, self.index.term.get, len(self.index.term)
        if len(kept) > KEPT_WORDS:
            kept.clear()
            self.several.clear()
        for token in {t for t in tokens if t not in kept}:
            bare = token.lower().strip(".,;:!?|\"'")
            if bare.isalnum():
                kept[token] = get(bare, none)
            else:
                self.several.append([get(w, none) for w in words_of(token)])
                kept[token] = -len(self.several)
        codes = list(map(kept.__getitem__, tokens))
        if codes and min(codes) < 0:
            codes = [t for c in codes for t in (self.several[-c - 1] if c < 0 else (c,))]
        return np.array(codes, np.int64)

    def candidates(self, ids: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(start, end, blocks) of the passages whose block maxima reach a block's threshold.

        A term counts once in each step of a passage, so the sums are upper bounds.
        """
        steps, wide = -(-len(ids) // self.step), self.passage // self.step
        passages, out = max(1, steps - wide + 1), []
        for s in range(0, passages, SCREENED):
            e = min(s + SCREENED, passages)
            hit = self.screened(ids[s * self.step : (e + wide - 1) * self.step], e - s)
            out += [(int(s + k) * self.step, min(int(s + k + wide) * self.step, len(ids)), np.flatnonzero(hit[k])) for k in np.flatnonzero(hit.any(1))]
        return out

    def screened(self, ids: np.ndarray, passages: int) -> np.ndarray:
        """Whether each of the first passages of ``ids`` may reach each block's threshold."""
        ix = self.index
        unknown, wide = len(ix.term), self.passage // self.step
        steps = -(-len(ids) // self.step)
        at = np.flatnonzero(ids < unknown)
        key = np.unique((at // self.step) * (unknown + 1) + ids[at])
        sums = np.zeros((len(key) + 1, ix.block_max.shape[1]), np.float32)
        np.cumsum(ix.block_max[key % (unknown + 1)], 0, out=sums[1:])
        border = sums[np.searchsorted(key // (unknown + 1), np.arange(steps + 1))]
        first = np.arange(passages)
        bound = border[np.minimum(first + wide, steps)] - border[first]
        return bound >= ix.least - 1e-3 * (1 + ix.least)

    def leaks(self, text: str | None) -> list[tuple[int, float]]:
        """(item, score) of the items that a text gives away: retrieved by a passage, then verified."""
        ix = self.index
        ids = self.ids(text or "")
        if not len(ids) or not ix.ids:
            return []
        best: dict[int, float] = {}
        spans: dict[int, list[tuple[int, int]]] = {}
        for s, e, blocks in self.candidates(ids):
            terms = np.unique(ids[s:e])
            terms = terms[terms < len(ix.term)].tolist()
            for run in np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1):
                for item, score in ix.wand(terms, int(run[0]) * ix.block, min((int(run[-1]) + 1) * ix.block, len(ix.ids))):
                    best[item] = max(score, best.get(item, 0.0))
                    spans.setdefault(item, []).append((s, e))
        if not best:
            return []
        words = words_of(text)
        # one pass over the whole text, in which only what the items hold is kept
        far = {g for item in best for part in ix.parts[item] if len(part) >= GRAM for g in grams(part)}
        far = far.intersection(zip(*(islice(words, k, None) for k in range(GRAM))))
        out = []
        for item, score in sorted(best.items()):
            around = len(ix.words[item])
            joined: list[list[int]] = []
            for s, e in spans[item]:  # in the order of the text
                if joined and s - around <= joined[-1][1]:
                    joined[-1][1] = e + around
                else:
                    joined.append([max(0, s - around), e + around])
            near = [w for s, e in joined for w in (*words[s:e], "")]  # the gap keeps n-grams from joining passages
            whole, question, answer = ix.overlap(item, near, far)
            if whole >= WHOLE or (question >= BOTH and answer >= BOTH):
                out.append((item, score))
        return out


def word_counts(items: DataFrame) -> DataFrame:
    """(word, holders, words): how many items hold each word; a null word stands for all items and their words."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            f = figures_of(frame["text"].tolist())
            yield pd.DataFrame({"word": [None, *f.holders], "holders": [f.n, *f.holders.values()], "words": [f.words] + [0] * len(f.holders)})

    counts = items.select("text").mapInPandas(count, "word string, holders long, words long")
    return counts.groupBy("word").agg(F.sum("holders").alias("holders"), F.sum("words").alias("words"))


def own_figures(counts: DataFrame, total: Row, texts: list[str | None]) -> Figures:
    """The figures of all items, for the words of a few of them only."""
    own = counts.sparkSession.sparkContext.broadcast({w for t in texts for half in question_and_answer(t) for w in half})
    found = counts.where("word is not null").mapInPandas(lambda frames: (f[f["word"].isin(own.value)] for f in frames), counts.schema).collect()
    own.destroy()
    return Figures(total["holders"], total["words"], {r["word"]: r["holders"] for r in found})


def leaks_by_part(docs: DataFrame, items: DataFrame, parts: int, passage: int, step: int, share: float) -> DataFrame:
    """(row, item_ids, score) of the documents that leak; one index after the other, so that a worker holds one.

    The indexes are scored by the figures of all items: the number of parts changes no result.
    """
    dealt = materialise(items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    counts = materialise(word_counts(dealt), "words")
    total = counts.where("word is null").collect()
    out = None
    for p in range(parts):
        rows = dealt.where(F.col("part") == p).select("item_id", "text").collect()
        figures = own_figures(counts, total[0], [r["text"] for r in rows])
        shared = docs.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in rows], passage, share, figures))
        found = materialise(map_texts(docs, FOUND, lambda shared=shared: finder(shared.value, passage, step), keep=["row"]).where("leaked").drop("leaked"), "leaks")
        shared.destroy()
        out = found if out is None else out.unionAll(found)
    drop_table(dealt)
    drop_table(counts)
    return out.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"), F.max("score").alias("score"))


def finder(index: ItemIndex, passage: int, step: int) -> Callable[[list[str | None]], dict[str, list]]:
    searcher = Searcher(index, passage, step)

    def search(texts: list[str | None]) -> dict[str, list]:
        found = [[(index.ids[i], score) for i, score in searcher.leaks(t)] for t in texts]
        return {"leaked": [bool(f) for f in found], "item_ids": [sorted({i for i, _ in f}) for f in found], "score": [max((s for _, s in f), default=0.0) for f in found]}

    return search


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` written once with a number for each row."""
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "docs")


def dealt_items(items: DataFrame, index_bytes: int) -> tuple[DataFrame, int]:
    """The items with an id, and how many indexes of ``index_bytes`` of their texts (about) they make."""
    items = items.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).collect()[0]["b"]
    return items, max(1, math.ceil(size / index_bytes))


def one_index(items: DataFrame, passage: int, share: float) -> Broadcast:
    return items.sparkSession.sparkContext.broadcast(ItemIndex([(r["item_id"], r["text"]) for r in items.collect()], passage, share))


def find_leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, step: int = STEP, share: float = SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Which test items each document gives away.

    ``docs`` needs doc_id and text, ``items`` item_id and text.  Returns one row a
    document: doc_id, leaked, item_ids (sorted), score (the best BM25 score of a
    verified item, else 0).

    Every passage of every whole text (``passage`` words, each ``step``) queries
    an inverted index of the items by block-max WAND and retrieves every item at
    or above its threshold; retrieved items are verified by the n-grams that
    their question and answer share with the text around the passage.  An index
    is broadcast; it holds ``index_bytes`` of item texts at most, and more items
    are searched by as many indexes, one after the other, with scores as of one.

    Null and empty texts leak nothing; items without words or id are not reported;
    items with equal texts are all reported; repeated rows give repeated results;
    an empty table of items leaves every document clean, one of documents gives no rows.
    """
    items, parts = dealt_items(items, index_bytes)
    if parts == 1:
        shared = one_index(items, passage, share)
        return map_texts(docs, FOUND, lambda: finder(shared.value, passage, step))
    rows = numbered(docs.select("doc_id", "text"), "row")
    found = leaks_by_part(rows, items, parts, passage, step, share)
    none = F.array().cast("array<long>")
    return rows.drop("text").join(found, "row", "left").select(
        "doc_id", F.col("score").isNotNull().alias("leaked"), F.coalesce("item_ids", none).alias("item_ids"), F.coalesce("score", F.lit(0.0)).alias("score")
    )


def drop_leaks(docs: DataFrame, items: DataFrame, passage: int = PASSAGE, step: int = STEP, share: float = SHARE, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that give no item away; see :func:`find_leaks`."""
    items, parts = dealt_items(items, index_bytes)
    if parts == 1:
        shared = one_index(items, passage, share)

        def start():
            searcher = Searcher(shared.value, passage, step)
            return lambda texts: [not searcher.leaks(t) for t in texts]

        return filter_texts(docs, start)
    row = unused("row", docs)
    rows = numbered(docs, row)
    found = leaks_by_part(rows.select(F.col(f"`{row}`").alias("row"), "text"), items, parts, passage, step, share)
    leaky = found.select(F.col("row").alias(row))
    return rows.join(leaky, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
