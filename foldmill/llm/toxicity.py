"""Toxicity: logistic regression that is held to the same score when identity terms are swapped."""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import batches, map_texts

#: Labelled rows that the model is fitted on, at most: those whose ids hash smallest.
FIT_ROWS = 20_000
#: Sentences with identity terms of a labelled row that the penalty sees, at most: those whose words hash smallest.
FIT_SENTENCES = 32
#: Features kept, and the fewest toxic sample documents that hold one.
FEATURES, LEAST_DOCS = 4096, 3
#: Weight of the counterfactual penalty and of the ridge, rounds of the fit.
COUNTERFACTUAL, RIDGE, ROUNDS = 1000.0, 1e-4, 400
CUT_OFF = 0.3
#: Identity terms, by axis: a term is swapped with the others of its axis.
IDENTITY = (
    ("women", "men", "girls", "boys", "trans", "nonbinary"),
    ("woman", "man", "girl", "boy", "femme", "homme", "frau", "mann", "mujer", "hombre"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "musulman", "juif", "muslimisch", "judio"),
    ("black", "white", "asian", "latino", "african", "arab", "european"),
    ("gay", "straight", "lesbian", "bisexual", "queer", "heterosexual"),
    ("immigrants", "refugees", "foreigners", "citizens", "locals"),
    ("disabled", "blind", "deaf", "autistic"),
    ("old", "young", "elderly"),
)
WORD = re.compile(r"[^\W\d_]+")
SENTENCE_END = re.compile(r"(?<=[.?!])\s+|\n+")
PREFIX = 4
KEPT_WORDS = 400_000


def features_of(token: str) -> tuple[str, ...]:
    """Features of one white-space token: its words, and how its longer words begin."""
    out = []
    for w in WORD.findall(token.lower()):
        out.append(w)
        if len(w) > PREFIX + 1:
            out.append(w[:PREFIX] + "*")
    return tuple(out)


def text_features(text: str | None) -> set[str]:
    return {f for token in set((text or "").split()) for f in features_of(token)}


def swapped_sentences(text: str | None, identity: Sequence[Sequence[str]] = IDENTITY) -> Iterator[tuple[set[str], list[tuple[str, str]]]]:
    """The words of each sentence with an identity term, and (term gone, term come) for each swap within its axis."""
    axis = {t: terms for terms in identity for t in terms}
    for sentence in SENTENCE_END.split(text or ""):
        words = set(WORD.findall(sentence.lower()))
        pairs = [(w, other) for w in sorted(words & axis.keys()) for other in axis[w] if other != w and other not in words]
        if pairs:
            yield words, pairs


def swaps(text: str | None, identity: Sequence[Sequence[str]] = IDENTITY) -> list[tuple[str, str]]:
    """(term gone, term come) for each sentence with an identity term and each term it may be swapped with."""
    return [pair for _, pairs in swapped_sentences(text, identity) for pair in pairs]


@dataclass(frozen=True)
class ToxicityModel:
    weights: Mapping[str, float]
    intercept: float


class Scorer:
    """A model with the tokens a worker has already looked up."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.kept: dict[str, tuple[str, ...]] = {}

    def __call__(self, text: str | None) -> float:
        weights, kept = self.model.weights, self.kept
        if len(kept) > KEPT_WORDS:
            kept.clear()
        found: set[str] = set()
        for token in set((text or "").split()):
            got = kept.get(token)
            if got is None:
                got = kept[token] = tuple(f for f in features_of(token) if f in weights)
            if got:
                found.update(got)
        z = self.model.intercept + sum(weights[f] for f in sorted(found))
        return float(1 / (1 + np.exp(-z)))


def choose_features(sample: DataFrame, least: int = LEAST_DOCS, most: int = FEATURES) -> list[str]:
    """Features of ``sample(text, y)`` whose presence goes furthest with the label (z score of the log odds)."""

    def exploded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 256):
            found: dict[str, list[int]] = {}
            for text, y in zip(frame["text"], frame["y"]):
                for f in text_features(text):
                    n = found.setdefault(f, [0, 0])
                    n[int(y)] += 1
            yield pd.DataFrame([(f, a, b) for f, (a, b) in found.items()], columns=["feature", "clean", "toxic"])

    totals = sample.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).collect()[0]
    n, toxic = totals["n"], int(totals["toxic"])
    counts = sample.mapInPandas(exploded, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    t, c = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(t / (toxic - F.col("toxic") + 0.5)) - F.log(c / (n - toxic - F.col("clean") + 0.5))
    z = odds / F.sqrt(1 / t + 1 / c)
    kept = counts.where(F.col("toxic") + F.col("clean") >= least).withColumn("z", F.abs(z)).where("z >= 3")
    return [r["feature"] for r in kept.orderBy(F.desc("z"), "feature").limit(most).collect()]  # FEATURES at most


@dataclass
class Swapped:
    """Sentences with identity terms, and their swaps: ``feature`` of sentence ``sentence``; swap ``swap`` of sentence
    ``of[swap]`` adds (``sign`` 1) or takes away (-1) the feature ``moved``."""

    sentence: np.ndarray
    feature: np.ndarray
    of: np.ndarray
    swap: np.ndarray
    moved: np.ndarray
    sign: np.ndarray

    def penalty(self, w: np.ndarray, b: float) -> tuple[float, np.ndarray, float]:
        """Mean squared change of a sentence's score by a swap, and its derivatives by the weights and the intercept."""
        n = len(self.of)
        if not n:
            return 0.0, np.zeros(len(w)), 0.0
        sentences = int(self.of.max()) + 1
        before = (np.bincount(self.sentence, w[self.feature], sentences) + b)[self.of]
        after = before + np.bincount(self.swap, self.sign * w[self.moved], n)
        p, q = 1 / (1 + np.exp(-before)), 1 / (1 + np.exp(-after))
        by_after, by_before = 2 * (q - p) * q * (1 - q) / n, -2 * (q - p) * p * (1 - p) / n
        both = by_after + by_before  # what a sentence keeps counts before and after the swap
        by_sentence = np.bincount(self.of, both, sentences)
        grad = np.bincount(self.moved, self.sign * by_after[self.swap], len(w)) + np.bincount(self.feature, by_sentence[self.sentence], len(w))
        return float(((q - p) ** 2).mean()), grad, float(both.sum())


def fit(rows: np.ndarray, cols: np.ndarray, y: np.ndarray, swapped: Swapped, width: int, strength: float = COUNTERFACTUAL) -> tuple[np.ndarray, float]:
    """Weights that minimise log loss + ridge + ``strength`` * mean squared change of the score by a swap.

    ``rows``, ``cols``: where the binary features are.
    """
    n = max(len(y), 1)
    w, b = np.zeros(width), float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    m1, m2 = np.zeros(width + 1), np.zeros(width + 1)
    for t in range(1, ROUNDS + 1):
        g = 1 / (1 + np.exp(-(np.bincount(rows, w[cols], len(y)) + b))) - y
        _, by_w, by_b = swapped.penalty(w, b)
        full = np.r_[np.bincount(cols, g[rows], width) / n + RIDGE * w + strength * by_w, g.sum() / n + strength * by_b]
        m1, m2 = 0.9 * m1 + 0.1 * full, 0.99 * m2 + 0.01 * full**2
        step = 0.1 * (1 - t / (ROUNDS + 1)) * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", fit_rows: int = FIT_ROWS, identity: Sequence[Sequence[str]] = IDENTITY, strength: float = COUNTERFACTUAL) -> ToxicityModel:
    """Fit on a bounded sample of the labelled rows; ``labels`` needs doc_id and ``label``.

    Null labels and ids are not used.  The driver gets, for each sampled
    document, the numbers of its chosen features, of those of ``FIT_SENTENCES`` of its sentences with
    identity terms at most, and the swaps of these.  ``strength`` weighs the penalty on
    score changes; ``FEATURES`` features are kept at most.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    sample = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # fit_rows rows at most
    chosen_features = choose_features(sample.select("text", "y"))
    names = sorted({*chosen_features, *(f for terms in identity for t in terms for f in features_of(t))})
    number = {f: k for k, f in enumerate(names)}

    def known_features(words: Iterable[str]) -> set[int]:
        return {number[f] for w in words for f in features_of(w) if f in number}

    def numbered(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 256):
            out = []
            for text in frame["text"]:
                sentence, feature, of, moves, sentences = [], [], [], [], 0
                seen = list(swapped_sentences(text, identity))
                for words, pairs in heapq.nsmallest(FIT_SENTENCES, seen, key=lambda s: (zlib.crc32(" ".join(sorted(s[0])).encode("utf-8", "surrogatepass")), sorted(s[0]))):
                    before = known_features(words)
                    for gone, come in pairs:
                        after = known_features((words - {gone}) | {come})
                        moves += [(len(of), f, 1 if f in after else -1) for f in sorted(before ^ after)]
                        of.append(sentences)
                    sentence += [sentences] * len(before)
                    feature += sorted(before)
                    sentences += 1
                own = sorted(number[f] for f in text_features(text) if f in number)
                out.append((own, sentences, sentence, feature, of, *([m[k] for m in moves] for k in range(3))))
            names = ["own", "sentences", "sentence", "feature", "of", "swap", "moved", "sign"]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype(str).tolist(), "y": frame["y"].astype("int32").tolist(), **{c: [r[k] for r in out] for k, c in enumerate(names)}})

    lists = "own array<int>, sentences int, sentence array<int>, feature array<int>, of array<int>, swap array<int>, moved array<int>, sign array<int>"
    rows = sample.mapInPandas(numbered, f"doc_id string, y int, {lists}").toPandas()
    rows = rows.sort_values(["doc_id"], kind="stable").reset_index(drop=True)

    def flat(column: str, first: np.ndarray | None = None) -> np.ndarray:
        """The lists of all rows end to end; with ``first``, that number of the row is added to what its list holds."""
        values = np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, np.int64) for x in rows[column]]])
        return values if first is None else values + np.repeat(first, [len(x) for x in rows[column]]).astype(np.int64)

    def starts(sizes: Iterable[int]) -> np.ndarray:
        return np.cumsum([0, *sizes])[: len(rows)].astype(np.int64)

    where = np.repeat(np.arange(len(rows)), [len(x) for x in rows["own"]]).astype(np.int64)
    first_sentence, first_swap = starts(rows["sentences"]), starts(len(x) for x in rows["of"])
    swapped = Swapped(flat("sentence", first_sentence), flat("feature"), flat("of", first_sentence), flat("swap", first_swap), flat("moved"), flat("sign").astype(float))
    w, b = fit(where, flat("own"), rows["y"].to_numpy(float), swapped, len(names), strength)
    return ToxicityModel({f: float(round(v, 6)) for f, v in zip(names, w) if abs(v) >= 1e-6}, round(b, 6))


def score_toxicity(docs: DataFrame, model: ToxicityModel, cut_off: float = CUT_OFF) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= ``cut_off``) of every whole text.

    ``docs`` needs doc_id and text.  A feature counts once however often it
    occurs, so long texts score no higher for their length.  Null and empty
    texts get the score of the intercept; repeated rows score alike; an empty
    table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES and the identity terms at most

    def start():
        scorer = Scorer(shared.value)
        return lambda texts: {"score": [scorer(t) for t in texts]}

    found = map_texts(docs, "score double", start)
    return found.select("doc_id", "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))
