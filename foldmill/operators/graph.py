"""A neighbour graph that improves itself: rounds of neighbours of neighbours over a table of edges."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldmill.functions.vectors import unit
from foldmill.operators.similarity import DIGITS, neighbours
from foldmill.sources.shared import drop_table, materialise

#: Edges that a row keeps while the graph is improved, beside a multiple of those asked for.
DEGREE, DEGREES = 24, 3
#: Trees that the first edges come from, rows of a leaf, about, and rows that the cuts are learned from.
TREES, LEAF, SAMPLE = 16, 1024, 16384
#: Rounds at most; they end before, once fewer than this share of the edges was new in one.
ROUNDS, SETTLED = 12, 0.002
#: Nearest edges of a row that a round follows, each way, beside a share of those kept.
REACH, SHARE = 12, 6
#: Candidates for a member that one neighbourhood sends on: more come from others, or in the next round.
SENT = 8
#: A component of a unit vector is a whole number of steps while the graph is improved.
STEPS = 32767
#: Edges beyond those asked for whose similarity is worked out in double precision.
SPARE = 3


def neighbour_graph(df: DataFrame, key: str, vector: str, k: int = 5, exact_below: int = 0, rounds: int = ROUNDS, settled: float = SETTLED, exact_scores: bool = True) -> DataFrame:
    """(key, rank, neighbour, similarity): about the k most similar other rows by cosine, ties to the smaller key.

    The first edges come from ``TREES`` random trees whose leaves hold about
    ``LEAF`` rows, which are compared within.  A round brings together, for each row, its
    nearest neighbours and the rows that it is one for (a hashed sample of those,
    if they are many): pairs of which one edge is new are compared, and those
    that beat the worst edge of either end become candidates.  Each row keeps
    its best.  Rounds end once less than ``settled`` of the edges are new.  Until then vectors
    are sent in whole numbers of 16 bits, a quarter of their size; the edges that are left are scored in double precision,
    unless similarities within 1e-4 are all that is needed (not ``exact_scores``).

    Work is n times the square of a fixed degree a round, whatever n.  Tables of
    fewer than ``exact_below`` rows are searched exactly.  Rows with a null
    key or vector, or with components that aren't finite, take no part; keys are unique; zero vectors have similarity 0 to all.  Of
    more equal vectors than k, which ones are found isn't settled, but each
    similarity is.  Edges lie in the shared folder from round to round.
    """
    usable = df.where(F.col(key).isNotNull() & F.col(vector).isNotNull())
    if exact_below and usable.limit(exact_below).count() < exact_below:
        return neighbours(usable, key, vector, k)
    degree = max(DEGREE, DEGREES * k)
    units = usable.select(F.col(key).cast("long").alias("id"), unit(F.col(vector)).alias("u"))
    rows = materialise(units.mapInArrow(steps_of, "id long, q array<short>"), "unit-vectors")
    edges = materialise(best(first_edges(rows, max(DEGREE, k)), degree), "edges")
    for _ in range(rounds):
        better = materialise(best(edges.drop("rank").withColumn("fresh", F.lit(False)).unionByName(candidates(edges, rows, degree)), degree), "edges")
        drop_table(edges)
        edges = better
        total, fresh = edges.agg(F.count("*"), F.count_if("fresh")).first()
        if fresh <= settled * total:
            break
    drop_table(rows)
    if not exact_scores:
        return edges.where(F.col("rank") <= k).select(F.col("id").alias(key), "rank", "neighbour", "similarity")
    found = materialise(scored(edges.where(F.col("rank") <= k + SPARE), units), "neighbours")
    drop_table(edges)
    return best(found, k).select(F.col("id").alias(key), "rank", "neighbour", "similarity")


def steps_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors (id, u) in whole numbers of steps; those that aren't finite are left out."""
    for part in parts:
        u = unit_matrix(part.column("u"))
        whole = np.isfinite(u).all(1)
        q = np.rint(u[whole] * STEPS).astype(np.int16)
        yield pa.RecordBatch.from_arrays([part.column("id").filter(pa.array(whole)), listed(q)], names=["id", "q"])


def listed(q: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1) * q.shape[1], pa.int32()), pa.array(q.ravel()))


def scored(edges: DataFrame, units: DataFrame) -> DataFrame:
    """Edges with the similarity in double precision."""
    ends = edges.select("id", "neighbour").join(units, "id").join(units.select(F.col("id").alias("neighbour"), F.col("u").alias("v")), "neighbour")
    product = F.aggregate(F.zip_with("u", "v", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return ends.select("id", "neighbour", F.round(product, DIGITS).alias("similarity"), F.lit(False).alias("fresh"))


def best(found: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` best edges of each id, each once, ranked; what was known before isn't fresh."""
    by_id = Window.partitionBy("id").orderBy(F.desc("similarity"), "neighbour", "fresh")
    once = found.withColumn("before", F.lag("neighbour").over(by_id)).where(~F.col("neighbour").eqNullSafe(F.col("before")))
    return once.withColumn("rank", F.row_number().over(by_id)).where(F.col("rank") <= degree).select("id", "rank", "neighbour", "similarity", "fresh")


def first_edges(rows: DataFrame, most: int) -> DataFrame:
    """(id, neighbour, similarity, fresh): the ``most`` best of each row's leaf in every tree."""
    n = rows.count()
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < (SAMPLE << 20) / max(n, 1)).limit(2 * SAMPLE).select("q").toArrow().column("q").combine_chunks()
    depth = max(0, math.ceil(math.log2(max(n, 1) / LEAF))) if len(sample) else 0
    trees = [cuts(unit_matrix(sample), depth, seed) for seed in range(TREES)] if depth else [None]

    def dealt(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = unit_matrix(part.column("q"))
            for t, tree in enumerate(trees):
                leaf = leaves(x, tree) + (t << depth)
                yield pa.RecordBatch.from_arrays([pa.array(leaf), *part.columns], names=["centre", "id", "q"])

    def compared(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.concat_batches(parts)
        for run in np.array_split(np.arange(part.num_rows), math.ceil(part.num_rows / (4 * LEAF))):
            some = part.slice(int(run[0]), len(run))
            yield edges_of(some.column("id").to_numpy(), unit_matrix(some.column("q")), most)

    lying = rows.mapInArrow(dealt, "centre long, id long, q array<short>").repartition("centre").sortWithinPartitions("centre")
    return lying.mapInArrow(lambda parts: by_centre(parts, compared), "id long, neighbour long, similarity double").withColumn("fresh", F.lit(True))


def cuts(x: np.ndarray, depth: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A direction a level, and where each node of it is cut: at the median of the sample ``x``."""
    random, node, tree = np.random.RandomState(seed), np.zeros(len(x), np.int64), []
    for level in range(depth):
        direction = random.standard_normal(x.shape[1])
        along = x @ direction
        at = np.full(1 << level, np.median(along))
        order = np.lexsort((along, node))
        names, first, size = np.unique(node[order], return_index=True, return_counts=True)
        at[names] = along[order][first + size // 2]
        tree.append((direction, at))
        node = 2 * node + (along >= at[node])
    return tree


def leaves(x: np.ndarray, tree: list[tuple[np.ndarray, np.ndarray]] | None) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    for direction, at in tree or []:
        node = 2 * node + (x @ direction >= at[node])
    return node


def by_centre(parts: Iterator[pa.RecordBatch], settle: Callable[[list[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """``settle`` of the rows of each centre, which lie together."""
    open_: list[pa.RecordBatch] = []
    for part in parts:
        if not part.num_rows:
            continue
        centre = part.column("centre").to_numpy()
        starts = np.flatnonzero(np.r_[True, centre[1:] != centre[:-1]])
        if open_ and open_[0].column("centre")[0].as_py() != centre[0]:
            yield from settle(open_)
            open_ = []
        for a, b in zip(starts, [*starts[1:], len(centre)]):
            open_.append(part.slice(a, b - a))
            if b < len(centre):
                yield from settle(open_)
                open_ = []
    if open_:
        yield from settle(open_)


def unit_matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(float)


def edges_of(ids: np.ndarray, u: np.ndarray, most: int, worst: np.ndarray | None = None, fresh: np.ndarray | None = None) -> pa.RecordBatch:
    """The ``most`` best pairs of each of some rows, vectors in steps; with ``worst`` and ``fresh`` only what beats it, one end being fresh."""
    s = np.round(u @ u.T / STEPS**2, DIGITS)  # the product is a whole number, the same in any order
    np.fill_diagonal(s, -np.inf)
    s[ids[:, None] == ids] = -np.inf
    if worst is not None:
        s[~(fresh[:, None] | fresh)] = -np.inf
        s[s <= worst[:, None]] = -np.inf
    most = min(most, len(ids))
    near = np.argpartition(-s, most - 1, axis=1)[:, :most]
    value = np.take_along_axis(s, near, 1)
    i, j = np.nonzero(np.isfinite(value))
    return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(ids[near[i, j]]), pa.array(value[i, j])], names=["id", "neighbour", "similarity"])


def candidates(edges: DataFrame, rows: DataFrame, degree: int) -> DataFrame:
    """(id, neighbour, similarity, fresh) from every row's neighbourhood.

    A neighbourhood holds a row's nearest neighbours and at most about as many rows that it is
    one for: of rows that are neighbours of very many, a share by hash is
    taken before anything is put in order.  Where no edge is new, there is nothing to compare.
    """
    reach = max(REACH, degree // SHARE)
    edges_near = edges.where(F.col("rank") <= reach)
    there = edges_near.select("id", F.col("neighbour").alias("member"), "fresh")
    back = edges_near.select(F.col("neighbour").alias("id"), F.col("id").alias("member"), "fresh")
    known = back.groupBy("id").agg(F.count("*").alias("n"))
    drawn = F.pmod(F.xxhash64("id", "member"), F.lit(1 << 20)) < F.lit(2 * reach << 20) / F.col("n")
    by_hash = Window.partitionBy("id").orderBy(F.desc("fresh"), F.xxhash64("member", "id"))
    back = back.join(known, "id").where(drawn).withColumn("place", F.row_number().over(by_hash)).where(F.col("place") <= reach).select("id", "member", "fresh")
    hood = there.unionAll(back).repartition("id").groupBy("id", "member").agg(F.max("fresh").alias("fresh"))
    hood = hood.withColumn("any", F.max("fresh").over(Window.partitionBy("id"))).where("any").drop("any")
    worst = edges.groupBy("id").agg(F.when(F.count("*") == degree, F.min("similarity")).otherwise(-2.0).alias("worst"))
    facts = rows.join(worst, "id").select(F.col("id").alias("member"), "q", "worst")
    lying = hood.withColumnRenamed("id", "centre").join(facts, "member").repartition("centre").sortWithinPartitions("centre")

    def settle(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = parts[0] if len(parts) == 1 else pa.concat_batches(parts)
        if part.num_rows > 1:
            yield edges_of(part.column("member").to_numpy(), unit_matrix(part.column("q")), SENT, part.column("worst").to_numpy(), part.column("fresh").to_numpy(zero_copy_only=False))

    found = lying.select("centre", "member", "fresh", "worst", "q").mapInArrow(lambda parts: by_centre(parts, settle), "id long, neighbour long, similarity double")
    return found.withColumn("fresh", F.lit(True))
