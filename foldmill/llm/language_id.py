"""Language identification by unigrams of pieces, summed over every way to cut a word into pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import map_texts, materialise

START = "▁"
LETTERS = re.compile(r"[^\W\d_]+")
#: Documents of a language that the model is fitted on, about: those whose ids hash smallest, with their whole texts.
FIT_DOCS = 2000
#: Rounds of the fit; the share of a language's probability that follows all languages, and the share of that spread evenly:
#: what no training text holds is then as likely in a language of few texts as in one of many.
ROUNDS, COMMON, EVEN = 3, 0.02, 0.1
#: Languages at most: scores of a word are held for each.
LANGUAGES = 200
#: Words whose lattices are summed at once (fewer with more than four languages), and letters of a word up to which no scaling is needed.
BATCH, PLAIN = 4096, 24
#: Words times languages whose scores a task keeps; then it starts anew.
KEPT_SCORES = 1_200_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased."""
    return LETTERS.findall((text or "").lower())


class Pieces:
    """The vocabulary as an automaton: which pieces end where in a word."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.names = [sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        #: one more piece stands for every character that the vocabulary lacks
        self.size = len(self.names) + 1
        self.length = np.array([len(p) for p in self.names] + [1], np.int64)
        self.single = {p for p in self.names if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for k, p in enumerate(self.names):
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()

    def lattice(self, words: Sequence[str]) -> Lattice:
        """The words end to end, each after its start mark, with every piece that fits somewhere."""
        line = "".join(START + w for w in words)
        found = list(self.automaton.iter(line))
        end = np.array([e for e, _ in found], np.int64) + 1
        piece = np.array([k for _, k in found], np.int64)
        size = np.array([len(w) + 1 for w in words], np.int64)
        first = np.cumsum(size) - size
        word = np.repeat(np.arange(len(words)), size)
        start = end - self.length[piece]
        inside = word[end - 1] == word[start]
        lacking = np.array([i for i, c in enumerate(line) if c not in self.single], np.int64)
        end, piece, start = np.r_[end[inside], lacking + 1], np.r_[piece[inside], np.full(len(lacking), self.size - 1)], np.r_[start[inside], lacking]
        return Lattice(first, size, start, end, piece, word[start])


@lru_cache(maxsize=2)
def pieces_of(model_file: str) -> Pieces:
    return Pieces(model_file)


@dataclass
class Lattice:
    """Places of words laid end to end; an edge is a piece from a place to a later one of the same word."""

    first: np.ndarray
    size: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray
    word: np.ndarray

    def __post_init__(self):
        # a word of n characters has n + 1 places, so each word before moves the places on by one
        self.place = self.first + np.arange(len(self.first))
        self.a, self.b = self.start + self.word, self.end + self.word
        self.depth = self.end - self.first[self.word]

    def by_depth(self, depth: np.ndarray) -> Iterator[np.ndarray]:
        order = np.argsort(depth, kind="stable")
        cuts = np.flatnonzero(np.diff(depth[order])) + 1
        yield from np.split(order, cuts) if len(order) else ()

    def forward(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sums over all ways to reach each place, divided by exp(scale); both by place and column of ``p``.

        Within a word the scale grows where sums get small, so that long words don't vanish.
        """
        places = int(self.size.sum()) + len(self.size)
        total, scale = np.zeros((places, p.shape[1])), np.zeros((places, p.shape[1]))
        total[self.place] = 1.0
        plain = self.size.max(initial=0) <= PLAIN
        for edges in self.by_depth(self.depth):
            a, b = self.a[edges], self.b[edges]
            order = np.argsort(b, kind="stable")
            a, b = a[order], b[order]
            heads = np.flatnonzero(np.r_[True, b[1:] != b[:-1]])
            to = b[heads]
            if plain:
                total[to] = np.add.reduceat(total[a] * p[self.piece[edges[order]]], heads)
                continue
            top = np.maximum.reduceat(scale[a], heads)
            part = total[a] * p[self.piece[edges[order]]] * np.exp(scale[a] - np.repeat(top, np.diff(np.r_[heads, len(b)]), 0))
            got = np.add.reduceat(part, heads)
            total[to], scale[to] = 1.0, top + np.log(got)
        return total, scale

    def log_sums(self, p: np.ndarray) -> np.ndarray:
        """log of the sum over all segmentations, by word and column of ``p``."""
        total, scale = self.forward(p)
        last = self.place + self.size
        return np.log(total[last]) + scale[last]

    def backward(self, p: np.ndarray) -> Lattice:
        """The same lattice read from its end."""
        flipped = 2 * self.first[self.word] + self.size[self.word]
        return Lattice(self.first, self.size, flipped - self.end, flipped - self.start, self.piece, self.word)

    def expected(self, p: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Expected uses of each edge's piece if word w occurs ``n[w]`` times (by column)."""
        total, scale = self.forward(p)
        back, back_scale = self.backward(p).forward(p)
        turned = 2 * self.place[self.word] + self.size[self.word]
        last = (self.place + self.size)[self.word]
        whole = np.log(total[last]) + scale[last]
        with np.errstate(divide="ignore"):
            log = np.log(total[self.a]) + scale[self.a] + np.log(p[self.piece]) + np.log(back[turned - self.b]) + back_scale[turned - self.b] - whole
        return n[self.word] * np.exp(log)


@dataclass
class LanguageModel:
    """Languages in code-point order, log shares of their documents, and piece probabilities (piece by language)."""

    model_file: str
    languages: list[str]
    prior: np.ndarray
    p: np.ndarray


def fit_words(docs: DataFrame, per_language: int = FIT_DOCS) -> tuple[DataFrame, dict[str, int]]:
    """(lang, word, n) over about ``per_language`` documents of each language, and all languages' document counts."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()}
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not counts:
        return known.select("lang", F.col("text").alias("word"), F.lit(1).cast("long").alias("n")).limit(0), {}
    share = F.create_map(*[F.lit(x) for lang, n in sorted(counts.items()) for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.col("text")), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, 256):
                found: dict[tuple[str, str], int] = {}
                rows = part.slice(at, 256)
                for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist()):
                    for w in words_of(text):
                        found[lang, w] = found.get((lang, w), 0) + 1
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string()), pa.array(list(found.values()), pa.int64())], names=["lang", "word", "n"])

    rows = known.where(drawn).select("lang", "text").mapInArrow(cut, "lang string, word string, n long")
    return rows.groupBy("lang", "word").agg(F.sum("n").alias("n")), counts


def train(docs: DataFrame, model_file: str, rounds: int = ROUNDS, per_language: int = FIT_DOCS) -> LanguageModel:
    """Fit piece probabilities of each language by expectation maximisation over all segmentations.

    ``docs`` needs doc_id, text and lang; rows without text or lang don't count,
    and repeated rows count each.  Of each language about ``per_language``
    documents are taken, by hash, with their whole texts.  Their distinct words are counted by
    Spark and stay there: a round sends expected uses by piece and language to the
    driver, no more than the vocabulary times the languages.
    """
    words, counts = fit_words(docs, per_language)
    languages = sorted(counts)
    size = pieces_of(model_file).size
    p = np.full((size, len(languages)), 1.0 / size)
    if languages:
        words = materialise(words, "words")
    for k in range(rounds if languages else 0):
        uses = np.zeros((size, len(languages)))
        for r in expected_uses(words, model_file, languages, p if k else None).collect():
            uses[r.piece, r.language] += r.uses
        p = smoothed(uses)
    n = np.array([counts[x] for x in languages], float)
    return LanguageModel(model_file, languages, np.log(n / max(n.sum(), 1)), p)


def smoothed(uses: np.ndarray) -> np.ndarray:
    """Probabilities by language, mixed with those of all languages and a little of every piece."""
    own = np.where(uses.sum(0) > 0, uses / np.maximum(uses.sum(0), 1e-300), 1 / len(uses))
    return (1 - COMMON) * own + COMMON * ((1 - EVEN) * own.mean(1, keepdims=True) + EVEN / len(uses))


def expected_uses(words: DataFrame, model_file: str, languages: list[str], p: np.ndarray | None) -> DataFrame:
    """(piece, language, uses); without probabilities every piece that fits somewhere counts, the longer the more."""
    number = {x: k for k, x in enumerate(languages)}

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = pieces_of(model_file)
        uses = np.zeros((pieces.size, len(languages)))
        for part in parts:
            for at in range(0, part.num_rows, BATCH):
                rows = part.slice(at, BATCH)
                lang = np.array([number[x] for x in rows.column("lang").to_pylist()])
                lattice, n = pieces.lattice(rows.column("word").to_pylist()), rows.column("n").to_numpy().astype(float)
                for c in np.unique(lang):
                    column = np.where(lang == c, n, 0.0)[:, None]
                    own = column[lattice.word, 0] * pieces.length[lattice.piece] if p is None else lattice.expected(p[:, [c]], column)[:, 0]
                    uses[:, c] += np.bincount(lattice.piece, own, pieces.size)
        piece, language = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(piece), pa.array(language), pa.array(uses[piece, language])], names=["piece", "language", "uses"])

    return words.mapInArrow(run, "piece long, language long, uses double").groupBy("piece", "language").agg(F.sum("uses").alias("uses"))


class Scorer:
    """Log probability of whole texts by language; a word's is worked out once."""

    def __init__(self, model: LanguageModel):
        self.model, self.pieces = model, pieces_of(model.model_file)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        """Sums of new words, those of a size together, so that a long one doesn't slow the others."""
        words.sort(key=len)
        parts, at = [self.scores], 0
        most = max(16, 4 * BATCH // max(4, len(self.model.languages)))
        while at < len(words):
            end = at + most
            while end > at + 1 and end <= len(words) and len(words[at]) < PLAIN <= len(words[end - 1]):
                end -= (end - at) // 2
            parts.append(self.pieces.lattice(words[at:end]).log_sums(self.model.p))
            at = end
        for w in words:
            self.number[w] = len(self.number)
        self.scores = np.concatenate(parts)

    def __call__(self, texts: list[str | None]) -> dict[str, list]:
        model = self.model
        cut = [words_of(t) for t in texts]
        if self.scores.size > KEPT_SCORES:
            self.forget()
        if model.languages:
            self.learn(list({w for words in cut for w in words} - self.number.keys()))
        langs, scores = [], []
        for words in cut:
            if not words or not model.languages:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            kinds, n = np.unique(np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)), return_counts=True)
            log = n @ self.scores[kinds] + model.prior
            best = int(log.argmax())
            langs.append(model.languages[best])
            scores.append(float(1.0 / np.exp(log - log[best]).sum()))
        return {"lang_pred": langs, "score": scores}


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred and score (the language's share of the probability) of every whole text.

    ``docs`` needs doc_id and text; other columns don't matter.  A text's
    probability in a language is its language's share of documents times the
    product over its words, each summed over all its segmentations.  Null texts
    and texts without a letter, and any text if no language was learned, get
    ``und`` and 0; equal scores go to the first language in code-point order.
    Repeated rows score alike; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the vocabulary times the languages

    def start():
        return Scorer(shared.value)

    return map_texts(docs, "lang_pred string, score double", start)
