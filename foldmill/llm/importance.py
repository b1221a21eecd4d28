"""Target-distribution importance resampling with hashed word n-grams, counted and scored in word tries."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import materialise

BUCKETS, SHARE, LEAST_WORDS, SEED = 10_000, 5, 20, "42"
#: Words of a trie, bytes of a text taken apart at once, rows of a result batch.
TRIE_WORDS, PIECE, ROWS = 1 << 20, 1 << 22, 512
#: Distinct words that a task keeps numbered; then it starts anew.
KEPT_WORDS = 500_000
#: Words up to this are appended to CRC states by tables, longer ones one by one.
BY_TABLE = 48
#: What turns a text's bytes into lower-case words and spaces.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Relative rank error of the quantile that screens for the largest scores.
ACCURACY = 10_000


def append_tables(longest: int) -> np.ndarray:
    """[n, k, b]: what byte b at place k of a CRC state becomes when n zero bytes follow."""
    one = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)
    out = [(np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)]
    for _ in range(longest):
        out.append(out[-1] >> np.uint32(8) ^ one[out[-1] & np.uint32(255)])
    return np.stack(out)


class Words(dict):
    """Numbers distinct words and keeps what appending one, after a space, does to a CRC state."""

    def __init__(self):
        super().__init__()
        self.tables = append_tables(BY_TABLE)
        self.names: list[bytes] = []
        self.alone, self.after_space = np.zeros(1024, np.uint32), np.zeros(1024, np.uint32)
        self.length = np.zeros(1024, np.int64)

    def __missing__(self, word: bytes) -> int:
        k = self[word] = len(self.names)
        self.names.append(word)
        if k == len(self.alone):
            self.alone, self.after_space, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.alone, self.after_space, self.length))
        self.alone[k], self.after_space[k], self.length[k] = zlib.crc32(word), zlib.crc32(b" " + word), len(word) + 1
        return k

    def append(self, states: np.ndarray, words: np.ndarray) -> np.ndarray:
        """The states of paths that go on with a space and a word each."""
        n = self.length[words]
        s, by_table = states, np.minimum(n, BY_TABLE)
        moved = self.tables[by_table, 0, s & 255]
        for k in range(1, 4):
            moved = moved ^ self.tables[by_table, k, s >> np.uint32(8 * k) & np.uint32(255)]
        out = moved ^ self.after_space[words]
        for i in np.flatnonzero(n > BY_TABLE):
            out[i] = zlib.crc32(b" " + self.names[words[i]], int(states[i]))
        return out


class Level:
    """Nodes of one depth of a trie: how often each path occurs, its CRC state, and where in the words it ends."""

    def __init__(self, node_at: np.ndarray, at: np.ndarray, state: np.ndarray):
        self.node_at, self.at, self.state = node_at, at, state

    def counts(self) -> np.ndarray:
        return np.bincount(self.node_at, minlength=len(self.state))


def trie_levels(words: Words, path: np.ndarray, text: np.ndarray, fresh: np.ndarray) -> list[Level]:
    """The trie of all runs of one to three words that stay in one text and end in a fresh word.

    A node is known by its parent and its word; its state is its parent's, moved on.
    """
    node_of, kinds = pd.factorize(path)
    level = Level(node_of, np.arange(len(path)), words.alone[kinds])
    out = []
    for depth in (1, 2, 3):
        if depth > 1:
            inside = level.at + 1 < len(path)
            inside[inside] = text[level.at[inside] + 1] == text[level.at[inside]]
            at, parent = level.at[inside] + 1, level.node_at[inside]
            node_of, keys = pd.factorize(parent.astype(np.int64) << 31 | path[at])
            level = Level(node_of, at, words.append(level.state[keys >> 31], keys & (2**31 - 1)))
        new = fresh[level.at]
        out.append(level if new.all() else Level(level.node_at[new], level.at[new], level.state))
    return out


def stretches(words: Words, texts: Sequence[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Word numbers, the text each stands in, and whether it is fresh, about ``TRIE_WORDS`` at a time.

    A text that goes on brings the two words before along, which aren't fresh.
    """
    path: list[int] = []
    sizes: list[tuple[int, int]] = []
    stale = 0

    def arrays() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        fresh = np.ones(len(path), bool)
        fresh[:stale] = False
        return np.array(path, np.int64), np.repeat([k for k, _ in sizes], [n for _, n in sizes]), fresh

    for k, text in enumerate(texts):
        if not text:
            continue
        data, at, before = text.translate(FOLD), 0, 0
        while at < len(data):
            end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
            part = data[at : end if end >= 0 else len(data)].split()
            at = end if end >= 0 else len(data)
            path += map(words.__getitem__, part)
            sizes.append((k, len(part)))
            before += len(part)
            if len(path) >= TRIE_WORDS:
                yield arrays()
                stale = min(2, before) if at < len(data) else 0
                path, sizes = path[len(path) - stale :], [(k, stale)]
    if len(path) > stale:
        yield arrays()


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def slices(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """At most ``ROWS`` rows at a time, and a task's words."""
    words = Words()
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            if len(words) > KEPT_WORDS:
                words = Words()
            yield part.slice(at, ROWS), words


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all whole texts fall into each bucket.

    Each task merges its tries into one row a bucket; sums of them meet.  The
    driver gets ``buckets`` numbers.
    """

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for rows, words in slices(parts):
            for stretch in stretches(words, as_bytes(rows.column("text"))):
                for level in trie_levels(words, *stretch):
                    np.add.at(total, level.state % buckets, level.counts())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in docs.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) by bucket."""
    n, t_all, s_all = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((t + 1) * (s_all + n) / ((s + 1) * (t_all + n)))) for s, t in zip(raw.astype(float), target.astype(float))], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight (the sum of its features' gains) of every whole text."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, words in slices(parts):
            n_words, n_features, weight = (np.zeros(rows.num_rows, np.int64) for _ in range(3))
            for path, text, fresh in stretches(words, as_bytes(rows.column("text"))):
                np.add.at(n_words, text[fresh], 1)
                for level in trie_levels(words, path, text, fresh):
                    gain = gains[level.state % len(gains)]
                    np.add.at(n_features, text[level.at], 1)
                    np.add.at(weight, text[level.at], gain[level.node_at])
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(n_words), pa.array(n_features), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def importance_sample(docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document; drawn ones have a rank, from 1.

    ``docs`` needs doc_id and text, ``target`` text.  Words are runs of digits,
    lower-cased A-Z and anything beyond ASCII; features are all runs of one to
    three words, hashed into ``buckets`` by their CRC-32.  A feature's gain is how
    much likelier its bucket is in the target, a document's weight the sum of
    gains, its score the weight with Gumbel noise from sha256("``seed``:doc_id").
    Of the N documents of ``least_words`` words or more the floor(``share`` N / 100)
    of the highest scores are drawn, ties to the smaller doc_id (none last).

    Null texts have no features and weight 0.  Repeated rows are documents of
    their own, with equal scores.  Other columns don't matter; an empty table
    gives no rows.  Texts are counted and scored where they are read; only
    bucket totals and, for the ranks, about ``share`` percent of the short result
    rows are shuffled.
    """
    gains = bucket_gains(bucket_counts(docs, buckets), bucket_counts(target, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weigh(docs, gains).withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id())
    scored = materialise(scored, "scored")
    return ranked(scored, share, F.col("n_words") >= least_words)


def ranked(scored: DataFrame, share: int, fit) -> DataFrame:
    """Ranks for the highest scores among the rows that ``fit`` holds for.

    A quantile whose error is bounded screens out most rows, the rest is cut into
    ranges and numbered inside them; the sizes of the ranges before are added.
    """
    long = ["doc_id", "n_features", "weight", "score"]
    able = scored.where(fit)
    drawn = able.count() * share // 100
    if not drawn:
        return scored.select(*long, F.lit(None).cast("long").alias("rank"))
    level = able.agg(F.percentile_approx("score", max(0.0, 1 - share / 100 - 3 / ACCURACY), ACCURACY)).first()[0]
    high = able.where(F.col("score") >= level)
    if high.count() < drawn:  # can't be, by the quantile's bound
        high = able
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    placed = materialise(high.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")
    part, inside = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row a partition
    starts, so_far = [], 0
    for r in sizes:
        starts.append((r.part, so_far))
        so_far += r.n
    first = scored.sparkSession.createDataFrame(starts, "part long, start long")
    numbered = placed.withColumn("part", part.cast("long")).join(F.broadcast(first), "part").withColumn("rank", F.col("start") + inside + 1)
    last = numbered.where(F.col("rank") == drawn).first()
    before = F.struct(-F.col("score"), F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0).cast("long")), F.col("row"))
    cut = F.struct(F.lit(-last.score).cast("long"), F.lit(last.doc_id is None), F.lit(last.doc_id or 0).cast("long"), F.lit(last.row).cast("long"))
    rest = scored.where(~(fit & (before <= cut)))
    return numbered.where(F.col("rank") <= drawn).select(*long, "rank").unionAll(rest.select(*long, F.lit(None).cast("long").alias("rank")))
