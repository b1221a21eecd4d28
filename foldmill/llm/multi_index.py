"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.llm.common import batches, drop_table, materialise

#: Vectors the two codebooks are fitted on, and those of them that say how far a walk has to go, at most; every row is indexed.
FIT_ROWS, TRIAL_ROWS = 20_000, 256
#: Centroids of each half, least and most; between them an eighth of the square root of the rows.
CENTROIDS = (4, 256)
#: Recall that a walk is meant to reach, and how many entries it visits at least.
RECALL, LEAST = 0.95, 100
#: Rows, and queries, that are compared in one group.
BLOCK = 4096

#: Rounding of a squared distance by products, for each component and unit of the squared norms.
ROUNDING = 8 * np.finfo(float).eps


@dataclass(frozen=True)
class MultiIndex:
    """Two codebooks and how many rows each pair of centroids holds (centroids ** 2 numbers)."""

    first: np.ndarray
    second: np.ndarray
    sizes: np.ndarray
    dims: int

    def cells(self, vectors: np.ndarray) -> np.ndarray:
        half = self.dims // 2
        return nearest(vectors[:, :half], self.first) * len(self.second) + nearest(vectors[:, half:], self.second)

    def summed(self, query: np.ndarray) -> np.ndarray:
        """Summed squared distance of a query to each pair of centroids."""
        half = self.dims // 2
        return (((self.first - query[:half]) ** 2).sum(1)[:, None] + ((self.second - query[half:]) ** 2).sum(1)).ravel()

    def visited(self, query: np.ndarray, entries: int) -> np.ndarray:
        """Cells in order of summed distance, until they hold ``entries`` rows.

        The multi-sequence walk: with both halves' centroids sorted by distance,
        a pair is pushed once its two predecessors are popped.
        """
        half = self.dims // 2
        a = ((self.first - query[:half]) ** 2).sum(1)
        b = ((self.second - query[half:]) ** 2).sum(1)
        ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
        a, b, sizes, m = a[ia].tolist(), b[ib].tolist(), self.sizes, len(self.second)
        heap, pushed, popped, found, out = [(a[0] + b[0], 0, 0)], {(0, 0)}, set(), 0, []
        while heap and found < entries:
            _, i, j = heapq.heappop(heap)
            popped.add((i, j))
            cell = ia[i] * m + ib[j]
            if sizes[cell]:
                out.append(cell)
                found += int(sizes[cell])
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in pushed and (x == 0 or (x - 1, y) in popped) and (y == 0 or (x, y - 1) in popped):
                    pushed.add((x, y))
                    heapq.heappush(heap, (a[x] + b[y], x, y))
        return np.array(out, np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids**2).sum(1) - 2 * x @ centroids.T).argmin(1)


def kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's rounds from evenly spaced rows of the sample; an empty cluster keeps its centroid."""
    centroids = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        owner = nearest(x, centroids)
        count = np.bincount(owner, minlength=len(centroids))
        for d in range(x.shape[1]):
            total = np.bincount(owner, x[:, d], len(centroids))
            centroids[:, d] = np.where(count > 0, total / np.maximum(count, 1), centroids[:, d])
    return centroids


def usable(vector: Column, dims: int) -> Column:
    """Neither null nor of another length, no null or non-finite component, not all zero."""
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def centroids_for(n: int) -> int:
    """A power of two near an eighth of the square root of the rows."""
    least, most = CENTROIDS
    return min(most, max(least, 1 << math.ceil(math.log2(max(math.sqrt(n) / 8, 1)))))


def build_index(rows: DataFrame, n: int, dims: int, k: int, recall: float = RECALL, fit_rows: int = FIT_ROWS) -> tuple[MultiIndex, float]:
    """Codebooks fitted on the ``fit_rows`` rows whose ids hash smallest, and the share of the rows that a walk has to visit.

    The share is measured on the sample: ``TRIAL_ROWS`` of its vectors are
    searched for in it by brute force, and it is the share of the entries by which a
    walk has met ``recall`` of their neighbours.  In the whole table, where
    neighbours are nearer, the same share finds no fewer.
    """
    sample = rows.orderBy(F.xxhash64("id"), "id", "vector").limit(fit_rows).select("vector").toPandas()
    x = np.array(sample["vector"].tolist(), float).reshape(-1, dims)
    half = dims // 2
    size = max(1, min(centroids_for(n), len(x)))
    with np.errstate(over="ignore", invalid="ignore"):
        index = MultiIndex(kmeans(x[:, :half], size), kmeans(x[:, half:], size), np.zeros(size * size, np.int64), dims)
        cells, met = index.cells(x), []
        count = np.bincount(cells, minlength=size * size)
        for q in range(0, len(x), max(1, len(x) // TRIAL_ROWS)):
            far = ((x - x[q]) ** 2).sum(1)
            far[q] = np.inf
            near = np.argpartition(far, min(k, len(x)) - 1)[: min(k, len(x) - 1)]
            order = np.argsort(index.summed(x[q]), kind="stable")
            behind = np.cumsum(count[order])
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            met.append(behind[place[cells[near]]])
    reached = np.sort(np.concatenate([np.zeros(0), *met]))
    share = float(reached[min(len(reached) - 1, math.ceil(recall * len(reached)))]) / len(x) if len(reached) else 1.0
    return index, share


def search(
    vectors: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    recall: float = RECALL,
    share: float | None = None,
    least: int = LEAST,
    fit_rows: int = FIT_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """The ``k`` nearest rows (Euclidean) of every query row, among all rows but itself.

    Returns query_id, rank (from 1), the neighbour's id under ``id_col``, score.
    Every row is written once with its pair of centroids.  Each query walks the
    pairs by summed distance, inside a task, until they hold the share of all rows
    that reached ``recall`` on a sample (or ``share``, if given; ``least`` rows at least), and
    meets their entries: the rows of a first centroid are dealt into blocks of about
    ``block``, so a cell or a vector that many rows share is spread, and each query goes
    to the blocks it visits. A block's rows are sent once and come first; the
    queries stream past them, ``block`` at a time.
    Entries are reranked on the original vectors in double precision; equal
    distances go to the smaller id.

    Rows whose vector is null, zero, of another length than most, or holds null
    or non-finite components take no part on either side, nor do rows without
    an id.  A query's own row alone is no neighbour of it: rows that share its id
    are, and each of several query rows of one id has its own ranks.  Vectors of
    one component have an empty first half.  An empty table gives no rows.
    """
    spark = vectors.sparkSession
    lengths = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("d")).count()
    common = lengths.orderBy(F.desc("count"), "d").limit(1).collect()
    out_schema = f"query_id long, rank int, {id_col} long, score double"
    if not common or common[0]["d"] < 1:
        return spark.createDataFrame([], out_schema)
    dims = common[0]["d"]
    usable_rows = vectors.where(usable(F.col(vector_col), dims) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"), F.monotonically_increasing_id().alias("row"),
    )
    rows = materialise(usable_rows, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count_if("asks")).collect()[0]
    if not n_queries:
        drop_table(rows)
        return spark.createDataFrame([], out_schema)
    index, measured = build_index(rows, n, dims, k, recall, fit_rows)
    entries = max(least, k + 1, math.ceil((measured if share is None else share) * n))
    codebooks = spark.sparkContext.broadcast(index)  # CENTROIDS[1] vectors at most

    def with_cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cell=codebooks.value.cells(np.array(frame["vector"].tolist(), float).reshape(-1, dims)))

    indexed = materialise(rows.mapInPandas(with_cells, "id long, vector array<double>, asks boolean, row long, cell long"), "indexed")
    drop_table(rows)
    sizes = np.zeros(len(index.sizes), np.int64)
    for r in indexed.groupBy("cell").count().collect():  # CENTROIDS[1] ** 2 rows at most
        sizes[r["cell"]] = r["count"]
    second = len(index.second)
    walked = spark.sparkContext.broadcast(MultiIndex(index.first, index.second, sizes, dims))
    #: Into how many blocks the rows of each first centroid and the queries are dealt.
    spread = np.maximum(1, -(-sizes.reshape(-1, second).sum(1) // block))

    def walks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 256):
            first, deal, at, seconds = [], [], [], []
            for q, vector in enumerate(frame["vector"]):
                cells = walked.value.visited(np.asarray(vector, float), entries)
                for a in np.unique(cells // second):
                    first += [int(a)] * int(spread[a])
                    deal += range(spread[a])
                    at += [q] * int(spread[a])
                    seconds += [(cells[cells // second == a] % second).astype(np.int32)] * int(spread[a])
            rows = frame.iloc[at]
            yield pd.DataFrame({"first": first, "deal": deal, "asks": True, "id": rows["id"].to_numpy(), "row": rows["row"].to_numpy(), "vector": rows["vector"].to_numpy(), "seconds": seconds})

    def dealt(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            first = frame["cell"].to_numpy() // second
            seconds = (frame["cell"].to_numpy() % second).astype(np.int32)
            # rows of a table are numbered one after the other, so numbers deal alike rows evenly
            yield pd.DataFrame({"first": first, "deal": frame["row"] % spread[first], "asks": False, "id": frame["id"], "row": frame["row"], "vector": frame["vector"], "seconds": list(seconds[:, None])})

    placed = "first long, deal long, asks boolean, id long, row long, vector array<double>, seconds array<int>"
    asked = indexed.where("asks").select("id", "vector", "row").mapInPandas(walks, placed)
    entry = indexed.select("id", "vector", "row", "cell").mapInPandas(dealt, placed)
    blocks = entry.unionAll(asked).repartition("first", "deal").sortWithinPartitions("first", "deal", "asks")
    found = blocks.mapInPandas(lambda frames: best_of_blocks(frames, second, dims, k, block), "query long, query_id long, id long, score double")
    order = F.row_number().over(Window.partitionBy("query").orderBy("score", "id"))
    return found.withColumn("rank", order).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def best_of_blocks(frames: Iterator[pd.DataFrame], second: int, dims: int, k: int, block: int) -> Iterator[pd.DataFrame]:
    """Rows in order of their block, entries before queries: the entries of one block are held, and ``block`` queries at most."""
    here, entries, queries, waiting = None, [], [], 0

    def answers() -> pd.DataFrame:
        return best_of_block(pd.concat(queries), pd.concat(entries), second, dims, k)

    for frame in frames:
        key = frame["first"].to_numpy() * (1 << 32) + frame["deal"].to_numpy()
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
        for start, end in zip(cuts, [*cuts[1:], len(key)]):
            if key[start] != here:
                if queries and entries:
                    yield answers()
                here, entries, queries, waiting = key[start], [], [], 0
            part = frame.iloc[start:end]
            asks = part["asks"].to_numpy()
            if not asks.all():
                entries.append(part[~asks])
            part = part[asks]
            while len(part):
                queries.append(part.iloc[: block - waiting])
                waiting, part = waiting + len(queries[-1]), part.iloc[block - waiting :]
                if waiting == block:
                    if entries:
                        yield answers()
                    queries, waiting = [], 0
    if queries and entries:
        yield answers()


def best_of_block(asked: pd.DataFrame, entry: pd.DataFrame, second: int, dims: int, k: int) -> pd.DataFrame:
    """The best ``k`` entries that each query visits in one block of rows."""
    if not len(asked) or not len(entry):
        return pd.DataFrame({"query": [], "query_id": [], "id": [], "score": []})
    queries, x = (np.array(f["vector"].tolist(), float).reshape(-1, dims) for f in (asked, entry))
    own, have, ids = asked["row"].to_numpy(np.int64), entry["row"].to_numpy(np.int64), entry["id"].to_numpy(np.int64)
    visits = np.zeros((len(queries), second), bool)
    for q, seconds in enumerate(asked["seconds"]):
        visits[q, seconds] = True
    cell = np.array(entry["seconds"].tolist(), np.int64)[:, 0]
    top_d, top_i = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
    with np.errstate(over="ignore", invalid="ignore"):
        q_norm, x_norm = (queries**2).sum(1), (x**2).sum(1)
        for at in range(0, len(x), 256):
            part = slice(at, at + 256)
            # |q - x|^2 by products finds what can enter; what enters is measured anew
            norms = q_norm[:, None] + x_norm[part]
            rough = norms - 2 * queries @ x[part].T
            # rounding grows with the norms; NaN says nothing
            open_to = ~(rough > (top_d[:, -1] ** 2 * (1 + 1e-9))[:, None] + ROUNDING * dims * norms)
            q, e = np.nonzero(open_to & visits[:, cell[part]])
            e = e + at
            other = own[q] != have[e]
            q, e = q[other], e[other]
            if len(q):
                merge(top_d, top_i, q, distance(queries[q] - x[e]), ids[e])
    q, j = np.nonzero(np.isfinite(top_d))
    return pd.DataFrame({"query": own[q], "query_id": asked["id"].to_numpy(np.int64)[q], "id": top_i[q, j], "score": top_d[q, j]})


def distance(diff: np.ndarray) -> np.ndarray:
    """Lengths of the rows; those whose squares overflow are scaled first."""
    with np.errstate(over="ignore"):
        d = np.sqrt((diff**2).sum(1))
    far = np.flatnonzero(np.isinf(d))
    if len(far):
        top = np.abs(diff[far]).max(1)
        d[far] = top * np.sqrt(((diff[far] / top[:, None]) ** 2).sum(1))
    return d


def merge(top_d: np.ndarray, top_i: np.ndarray, q: np.ndarray, d: np.ndarray, i: np.ndarray) -> None:
    """Put candidates (q, d, i) into the sorted lists of the best, in place."""
    k = top_d.shape[1]
    touched = np.unique(q)
    q = np.r_[np.repeat(touched, k), q]
    d, i = np.r_[top_d[touched].ravel(), d], np.r_[top_i[touched].ravel(), i]
    order = np.lexsort((i, d, q))
    q, d, i = q[order], d[order], i[order]
    starts = np.searchsorted(q, touched)
    take = starts[:, None] + np.arange(k)
    top_d[touched], top_i[touched] = d[take], i[take]
