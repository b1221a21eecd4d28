"""Similarity of labelled vectors: cohesion of classes, nearest neighbours, permutation test."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.functions.vectors import unit
from foldmill.operators.ranking import numbered
from foldmill.sources.shared import drop_table, materialise

#: Rows of a block, at least and at most, and the components that the larger ones may hold.
BLOCK, LARGEST, HELD = 4096, 16384, 2**21
#: Rows of a block, and of another one, that are compared at once: their similarities stay in a core's cache.
TILE, STRIP = 512, 512
#: Found pairs that a block holds before it keeps the best of them.
PENDING = 2**18
#: Similarities are rounded before they are ranked, so that ties are ties in any order of summation.
DIGITS = 9


def class_cohesion(df: DataFrame, vector: str, label: str) -> DataFrame:
    """Mean and population deviation of the cosine over pairs within and between classes, and the gap.

    No pair is formed.  For unit vectors, the sum of the cosines over the
    pairs of a set comes from the sum of its vectors, and the sum of their squares
    from the sum of its outer products; between classes is all pairs minus those
    within.  One pass, d * d sums a class.
    """
    rows = df.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label"), unit(F.col(vector)).alias("u"))

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, list] = {}
        for frame in frames:
            for name, part in frame.groupby("label"):
                u = np.array(part["u"].tolist(), float)
                own = (u * u).sum(1)
                new = [np.array([len(u), own.sum(), (own**2).sum()]), u.sum(0), (u.T @ u).ravel()]
                sums[name] = [a + b for a, b in zip(sums[name], new)] if name in sums else new
        for name, parts in sums.items():
            for kind, values in zip(("rows", "vector", "outer"), parts):
                yield pd.DataFrame({"label": name, "kind": kind, "pos": np.arange(len(values)), "value": values})

    parts = rows.mapInPandas(moments, "label string, kind string, pos long, value double")
    by_class = parts.groupBy("label", "kind", "pos").agg(F.sum("value").alias("value"))
    total = by_class.groupBy("kind", "pos").agg(F.sum("value").alias("value")).select(F.lit(None).cast("string").alias("label"), "kind", "pos", "value")

    def of(kind: str, pos: int | None = None) -> Column:
        if pos is None:
            return F.sum(F.when(F.col("kind") == kind, F.col("value") * F.col("value")))
        return F.sum(F.when((F.col("kind") == kind) & (F.col("pos") == pos), F.col("value")))

    sets = by_class.unionByName(total).groupBy("label").agg(
        (of("rows", 0) * (of("rows", 0) - 1) / 2).alias("m"), ((of("vector") - of("rows", 1)) / 2).alias("c1"), ((of("outer") - of("rows", 2)) / 2).alias("c2"))
    within, everything = F.col("label").isNotNull(), F.col("label").isNull()
    sums = sets.agg(*[F.sum(F.when(side, F.col(c)).otherwise(0.0)).alias(f"{c}_{name}") for side, name in ((within, "w"), (everything, "t")) for c in ("m", "c1", "c2")])
    m_b, c1_b, c2_b = F.col("m_t") - F.col("m_w"), F.col("c1_t") - F.col("c1_w"), F.col("c2_t") - F.col("c2_w")

    def mean(m: Column, c1: Column) -> Column:
        return F.when(m > 0, F.try_divide(c1, m))

    def deviation(m: Column, c1: Column, c2: Column) -> Column:
        return F.when(m > 0, F.sqrt(F.greatest(F.try_divide(c2, m) - F.pow(F.try_divide(c1, m), 2), F.lit(0.0))))

    stats = sums.select(
        mean(F.col("m_w"), F.col("c1_w")).alias("within_mean"), deviation(F.col("m_w"), F.col("c1_w"), F.col("c2_w")).alias("within_std"),
        mean(m_b, c1_b).alias("between_mean"), deviation(m_b, c1_b, c2_b).alias("between_std"),
    )
    return stats.withColumn("gap", F.col("within_mean") - F.col("between_mean"))


def neighbours(df: DataFrame, key: str, vector: str, k: int = 5, block: int | None = None) -> DataFrame:
    """(key, rank, neighbour, similarity): the k most similar other rows by cosine, ties to the smaller key.

    Exact, so each row meets each other one: rows are packed into blocks of about
    ``block`` (:func:`block_rows` where it isn't given), which are written once, with what each row's k best reach at least within
    its own block, and a task streams some blocks past some others, keeping the best k of either.  Two blocks meet in one task
    only.  No row is shuffled but to be packed.  Pairs are screened in single precision,
    with a margin for its rounding, and only those that may be among the best are
    worked out in double.  For tables where all pairs are too many there is
    ``graph.neighbour_graph``.  Zero vectors have similarity 0 to all; rows with a null
    key or vector take no part.  The result lies in the shared folder.
    """
    there = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    n, width = there.agg(F.count("*"), F.max(F.size(vector))).first()
    blocks = packed(there.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("u")), block or block_rows(n, width or 1), n, k)
    asked = blocks.select("block", F.col("ids").alias("own"), F.col("u").alias("query"), F.col("least").alias("own_least"))
    past = blocks.select(F.col("block").alias("past"), F.col("ids").alias("other"), F.col("u").alias("row"), F.col("least").alias("other_least"))
    found = asked.join(past.hint("shuffle_replicate_nl"), once(F.col("block"), F.col("past")))
    found = found.mapInArrow(lambda parts: best_of_blocks(parts, k), "id long, neighbour long, similarity double")
    order = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))
    near = found.withColumn("rank", order).where(F.col("rank") <= k).select(F.col("id").alias(key), "rank", "neighbour", "similarity")
    near = materialise(near, "neighbours")
    drop_table(blocks)
    return near


def block_rows(n: int, width: int) -> int:
    """Rows of a block: a larger one is sent less often for the pairs it is in, but there should be 16 of them, and a task holds two."""
    return max(BLOCK, min(LARGEST, n // 16, HELD // width))


def once(one: Column, other: Column) -> Column:
    """Whether two blocks meet in this order: the same, or else one of both orders, by a digest, so that each task has about half of its pairs."""
    return (one == other) | ((one < other) == (F.hash(F.least(one, other), F.greatest(one, other)) % 2 == 0))


def packed(rows: DataFrame, block: int, n: int | None = None, k: int | None = None) -> DataFrame:
    """(block, ids, u, least): rows (id, u) as blocks of about ``block``, keys in order and vectors in binary; written to the shared folder.

    ``least`` is what the similarity of a row's ``k`` best reaches within its block (without ``k``: null).
    """

    def pack(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in parts:
            for at in range(0, part.num_rows, block):
                held.append(part.slice(at, block))
                size += held[-1].num_rows
                if size > block + block // 2:
                    yield bundle(held)
                    held, size = [], 0
        if size:
            yield bundle(held)

    def bundle(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        part = pa.concat_batches(held)
        ids, u = part.column("id").to_numpy(), part.column("u")
        if len(set(np.diff(u.offsets.to_numpy()).tolist())) > 1:
            raise ValueError("vectors differ in length")
        order = np.argsort(ids, kind="stable")
        matrix = u.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[order]
        least = reached_within(ids[order], matrix, k).tobytes() if k else None
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (ids[order].tobytes(), matrix.tobytes(), least)], names=["ids", "u", "least"])

    blocks = max(1, math.ceil((rows.count() if n is None else n) / block))
    bundles = rows.repartition(blocks, "id").mapInArrow(pack, "ids binary, u binary, least binary")
    return materialise(bundles.select(F.monotonically_increasing_id().alias("block"), "ids", "u", "least"), "blocks")


def slices(n: int, step: int) -> list[slice]:
    return [slice(at, min(at + step, n)) for at in range(0, n, step)]


def margin(width: int) -> float:
    """What a product of unit vectors may be off by in single precision, and the rounding of a similarity."""
    return (width + 8) * 2.0**-23 + 10.0**-DIGITS


def hide(near: np.ndarray, ids: np.ndarray, others: np.ndarray) -> np.ndarray:
    """No row is its own neighbour; both keys are in order."""
    if ids[0] <= others[-1] and others[0] <= ids[-1]:
        near[ids[:, None] == others] = -np.inf
    return near


def reached(strips: Iterable[np.ndarray], k: int) -> np.ndarray:
    """What ``k`` similarities of each row reach at least: the k-th of the largest of groups of columns, which are dealt in turn."""
    groups, top = 1 << (8 * k).bit_length(), None
    for near in strips:
        if top is None:
            top = np.full((len(near), groups), -np.inf, near.dtype)
        whole = near.shape[1] // groups * groups
        if whole:
            top = np.maximum(top, near[:, :whole].reshape(len(near), -1, groups).max(1))
        rest = near.shape[1] - whole
        top[:, :rest] = np.maximum(top[:, :rest], near[:, whole:])
    return np.partition(np.where(np.isnan(top), -np.inf, top), -k, axis=1)[:, -k]


def places(hit: np.ndarray) -> np.ndarray:
    """Where a mask is set, in order; few places are, so eight are looked at together."""
    flat = hit.ravel()
    if len(flat) % 8:
        return np.flatnonzero(flat)
    words = np.flatnonzero(flat.view(np.uint64))
    word, at = np.nonzero(flat.reshape(-1, 8)[words])
    return words[word] * 8 + at


def reached_within(ids: np.ndarray, u: np.ndarray, k: int) -> np.ndarray:
    """What ``k`` similarities of each row reach at least among the rows of its own block."""
    small, parts = u.astype(np.float32), slices(len(ids), STRIP)
    found = [reached((hide(small[some] @ small[part].T, ids[some], ids[part]) for part in parts), k) for some in slices(len(ids), TILE)]
    return (np.concatenate(found) - margin(u.shape[1])).astype(np.float32)


class Best:
    """The best ``k`` rows met so far by each row of a block."""

    def __init__(self, ids: np.ndarray, k: int, least: np.ndarray | float = -np.inf):
        self.ids, self.k, self.least, self.found, self.pending = ids, k, np.broadcast_to(least, len(ids)), [], 0
        self.s, self.i = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, off: float) -> np.ndarray:
        """What a similarity in single precision must reach to be looked at."""
        worst = np.maximum(self.s[:, -1], self.least) - off
        return np.where(np.isfinite(worst), worst, -2.0).astype(np.float32)

    def add(self, i: np.ndarray, others: np.ndarray, s: np.ndarray) -> None:
        """Rows ``i`` and keys of another block with their similarities."""
        good = (s >= np.maximum(self.s[i, -1], self.least[i])) & np.isfinite(s) & (self.ids[i] != others)
        self.found.append((i[good], others[good], s[good]))
        self.pending += len(self.found[-1][0])
        if self.pending > PENDING:
            self.keep()

    def add_crowded(self, u: np.ndarray, others: np.ndarray, v: np.ndarray, some: slice) -> None:
        """As many rows are next to equal: the best k of a tile in double precision, ties to those that come first."""
        s = np.round(u[some] @ v.T, DIGITS)
        s[(self.ids[some, None] == others) | ~np.isfinite(s)] = -np.inf
        if s.shape[1] > self.k:
            last = np.partition(s, -self.k, axis=1)[:, -self.k, None]
            tie = s == last
            i, j = np.nonzero((s > last) | tie & (np.cumsum(tie, axis=1, dtype=np.int32) <= self.k))
        else:
            i, j = np.nonzero(s > -np.inf)
        self.add(i + some.start, others[j], s[i, j])

    def keep(self) -> None:
        """The best of what was found and of those before."""
        if not self.found:
            return
        i, other, s = (np.concatenate(x) for x in zip(*self.found))
        self.found, self.pending = [], 0
        better = s >= self.s[i, -1]
        i, other, s = i[better], other[better], s[better]
        touched = np.unique(i)
        i = np.r_[i, np.repeat(touched, self.k)]
        other, s = np.r_[other, self.i[touched].ravel()], np.r_[s, self.s[touched].ravel()]
        order = np.lexsort((other, -s, i))
        i, other, s = i[order], other[order], s[order]
        starts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])[: len(i)]
        place = np.arange(len(i)) - np.repeat(starts, np.diff(np.r_[starts, len(i)]))
        kept = place < self.k
        self.s[i[kept], place[kept]], self.i[i[kept], place[kept]] = s[kept], other[kept]

    def batch(self) -> pa.RecordBatch:
        q, j = np.nonzero(np.isfinite(self.s))
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.i[q, j]), pa.array(self.s[q, j])], names=["id", "neighbour", "similarity"])


def matrix_of(ids: pa.Scalar, u: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids.as_buffer(), np.int64)
    return ids, np.frombuffer(u.as_buffer(), np.float64).reshape(len(ids), -1)


def meet(a: Best, u: np.ndarray, others: np.ndarray, v: np.ndarray, b: Best | None = None) -> None:
    """Two blocks go past each other; the other one's rows keep their best in ``b``, where it is given and not the same block."""
    off, x, y = margin(u.shape[1]), u.astype(np.float32), v.astype(np.float32)
    shared = np.isin(a.ids, others).any()
    b = None if b is a else b
    for some in slices(len(a.ids), TILE):
        worst, worst_b = a.worst(off)[some, None], None if b is None else b.worst(off)
        for part in slices(len(others), STRIP):
            near = x[some] @ y[part].T
            if shared:
                hide(near, a.ids[some], others[part])
            hit = places(near >= (worst if b is None else np.minimum(worst, worst_b[part])))
            if len(hit) <= (16 + 8 * a.k) * len(near):
                i, j = hit // near.shape[1] + some.start, hit % near.shape[1] + part.start
                s = np.round(np.einsum("ij,ij->i", u[i], v[j]), DIGITS)
                a.add(i, others[j], s)
                if b is not None:
                    b.add(j, a.ids[i], s)
            else:
                a.add_crowded(u, others[part], v[part], some)
                if b is not None:
                    b.add_crowded(v, a.ids[some], u[some], part)
    a.keep()
    if b is not None:
        b.keep()


def best_of_blocks(parts: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The best ``k`` rows of the blocks that it meets for each row of a block: of both blocks of a pair, or of the asking one if the other has no number."""
    met: dict[int, Best] = {}
    for part in parts:
        names = part.schema.names
        for at in range(part.num_rows):
            row = {name: part.column(name)[at] for name in names}
            own, u = matrix_of(row["own"], row["query"])
            other, v = matrix_of(row["other"], row["row"])
            both = []
            for number, ids, least in (("block", own, "own_least"), ("past", other, "other_least")):
                if number in row and row[number].as_py() not in met:
                    met[row[number].as_py()] = Best(ids.copy(), k, np.frombuffer(row[least].as_buffer(), np.float32).copy() if least in row else -np.inf)
                both.append(met[row[number].as_py()] if number in row else None)
            meet(both[0], u, other, v, both[1])
    for best in met.values():
        yield best.batch()


def vote(near: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """(key, y_pred): the most frequent label among the neighbours, the smallest on ties."""
    votes = near.select(key, F.col("neighbour").alias("_n")).join(labels.select(F.col(key).alias("_n"), F.col(label).alias("_l")), "_n")
    counts = votes.groupBy(key, "_l").agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by("_l", F.struct(-F.col("n"), F.col("_l"))).alias("y_pred"))


def knn_predictions(df: DataFrame, key: str, vector: str, label: str, k: int = 5, near: DataFrame | None = None) -> DataFrame:
    """(key, y_true, y_pred) by leaving each row out; ``near`` are neighbours found otherwise, as of ``graph.neighbour_graph``."""
    labels = df.select(F.col(key).cast("long").alias(key), label)
    return vote(neighbours(df, key, vector, k) if near is None else near, labels, key, label).join(labels, key).select(key, F.col(label).alias("y_true"), "y_pred")


#: Rounds of the bijection of places, and the prime that its round function is taken modulo.
FEISTEL, PRIME = 4, 2**31 - 1


def shuffle_keys(perm: int, seed: int | str) -> list[tuple[int, int]]:
    """(factor, term) of each round of shuffle ``perm``, from digests."""
    return [tuple(int(hashlib.md5(f"{seed}_{perm}_{r}_{what}".encode()).hexdigest()[:7], 16) + 1 for what in "ab") for r in range(FEISTEL)]


def shuffled_place(place: np.ndarray, n: int, keys: Sequence[tuple[int, int]]) -> np.ndarray:
    """Where a shuffle of 0 .. n - 1 sends each place: a bijection that is computed, not ranked.

    The halves of a place's bits go through a Feistel network; what falls beyond
    n goes through again, until it comes back.
    """
    bits = max(1, math.ceil(math.log2(max(n, 2)) / 2))
    mask, out = np.int64((1 << bits) - 1), place.astype(np.int64)
    open_ = np.arange(len(out))
    while len(open_):
        left, right = out[open_] >> bits, out[open_] & mask
        for factor, term in keys:
            h = (right * factor + term) % PRIME
            left, right = right, left ^ ((h * h + right) % PRIME & mask)
        out[open_] = left << bits | right
        open_ = open_[out[open_] >= n]
    return out


def permutation_test(df: DataFrame, key: str, vector: str, label: str, k: int = 5, times: int = 100, seed: int | str = 42, near: DataFrame | None = None) -> DataFrame:
    """(perm, n_correct, accuracy) of the nearest-neighbour vote for shuffled labels; perm -1 is the labels as they are.

    Neighbours don't depend on labels, so they are found once, or given as ``near``.
    Rows are numbered by the digests of their keys.  A shuffle sends a row's number to another by a
    bijection, and the row gets the label that stands there when all labels are
    put in order, which the counts by label tell: no shuffle is sorted or joined.
    Rows without a label neither vote nor count.
    """
    near = neighbours(df, key, vector, k) if near is None else near
    rows = df.where(F.col(label).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(label).alias("label"))
    counts = rows.groupBy("label").agg(F.count("*").alias("n")).orderBy("label").collect()  # a row a class
    names, ends = [r["label"] for r in counts], np.cumsum([r["n"] for r in counts])
    n, all_keys = int(ends[-1]) if len(ends) else 0, [shuffle_keys(p, seed) for p in range(times)]
    codes = F.create_map(*[F.lit(x) for c, name in enumerate(names) for x in (name, c)])[F.col("label")] if names else F.lit(0)
    placed = numbered(rows.select("id", codes.alias("code")).withColumn("_all", F.lit(0)), ["_all"], F.md5(F.col("id").cast("string")), ["id"], "place").select("id", "code", "place")

    def draw(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            place = part.column("place").to_numpy() - 1
            drawn = [part.column("code").to_numpy(), *[np.searchsorted(ends, shuffled_place(place, n, keys), "right") for keys in all_keys]]
            flat = np.stack(drawn, 1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("id"), lists], names=["id", "drawn"])

    labels = placed.mapInArrow(draw, "id long, drawn array<int>")
    votes = near.select(F.col(key).alias("id"), "neighbour").join(labels.withColumnRenamed("id", "neighbour"), "neighbour")
    votes = votes.groupBy("id").agg(F.collect_list("drawn").alias("votes")).join(labels, "id")  # k lists a row

    def judge(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, asked = np.zeros(times + 1, np.int64), 0
        for part in parts:
            for at in range(0, part.num_rows, 1024):
                some = part.slice(at, 1024)
                own = some.column("drawn").flatten().to_numpy().reshape(-1, times + 1)
                lists = some.column("votes")
                starts = lists.offsets.to_numpy()[:-1] - lists.offsets[0].as_py()  # no list is empty
                cast = lists.flatten().flatten().to_numpy().reshape(-1, times + 1)
                most, best = np.zeros(own.shape, np.int32), np.zeros(own.shape, np.int32)
                for c in range(len(names)):
                    got = np.add.reduceat(cast == c, starts, axis=0, dtype=np.int32)
                    best, most = np.where(got > most, c, best), np.maximum(got, most)
                right += (best == own).sum(0)
                asked += len(own)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, times), pa.int32()), pa.array(right), pa.array(np.full(times + 1, asked))], names=["perm", "n_correct", "n"])

    sums = votes.mapInArrow(judge, "perm int, n_correct long, n long").groupBy("perm").agg(F.sum("n_correct").alias("n_correct"), F.sum("n").alias("n"))
    return sums.where("n > 0").select("perm", "n_correct", (F.col("n_correct") / F.col("n")).alias("accuracy"))


def permutation_p(results: DataFrame) -> DataFrame:
    """Observed accuracy, mean of the shuffled ones, and the share of them that reach it (no +1)."""
    drawn = F.collect_list(F.when(F.col("perm") >= 0, F.col("accuracy")))  # as many as there were shuffles
    both = results.agg(F.max(F.when(F.col("perm") == -1, F.col("accuracy"))).alias("observed"), drawn.alias("drawn"))
    total = F.aggregate("drawn", F.lit(0.0), lambda a, x: a + x)
    reach = F.size(F.filter("drawn", lambda x: x >= F.col("observed")))
    return both.select("observed", F.try_divide(total, F.size("drawn")).alias("mean_shuffled"), F.try_divide(reach.cast("double"), F.size("drawn")).alias("p"))
