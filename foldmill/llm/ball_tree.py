"""Centroid clustering of integer vectors, filtered by ball trees that each task builds over its own rows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import materialise

#: Vectors of one tree, and of a leaf at most.
BLOCK, LEAF = 4096, 32
#: Bounds of balls are doubles: a ball is given away only beyond this share of their size, else its rows decide exactly.
SLACK = 1e-9
#: Components up to this give exact distances in doubles, where a matrix product is quick; larger ones take integers.
IN_DOUBLES = 1 << 20

TREE = "ids array<long>, points array<long>, first array<int>, size array<int>, left array<int>, radius array<double>, sums array<long>, squares array<long>"
FOUND = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def largest_component(width: int) -> int:
    """Components up to this keep every squared distance below 2^63."""
    return int((2.0**62 / width) ** 0.5) // 2


@dataclass
class BallTree:
    """A metric tree: rows in the order of its leaves; by node its rows, children, radius, sum and sum of squares.

    Node 0 is the root, the second child of a node stands behind the first (``left``, -1 for leaves).
    """

    ids: pa.Array
    points: np.ndarray
    first: np.ndarray
    size: np.ndarray
    left: np.ndarray
    radius: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def of(cls, ids: pa.Array, points: np.ndarray, leaf: int = LEAF) -> BallTree:
        """Split at the median along the line between two far rows, until ``leaf`` rows are left."""
        order, real = np.arange(len(points)), points.astype(float)
        first, size, left = [0], [len(points)], []
        radius = []
        node = 0
        while node < len(first):
            rows = order[first[node] : first[node] + size[node]]
            away = np.sqrt(((real[rows] - real[rows].mean(0)) ** 2).sum(1))
            radius.append(float(away.max()))
            if size[node] <= leaf or radius[-1] == 0:
                left.append(-1)
            else:
                one = real[rows[away.argmax()]]
                other = real[rows[((real[rows] - one) ** 2).sum(1).argmax()]]
                half = size[node] // 2
                cut = np.argpartition(real[rows] @ (other - one), half)
                order[first[node] : first[node] + size[node]] = rows[cut]
                left.append(len(first))
                first += [first[node], first[node] + half]
                size += [half, size[node] - half]
            node += 1
        points = points[order]
        starts, ends = np.array(first), np.array(first) + np.array(size)
        upto = np.concatenate([np.zeros((1, points.shape[1]), np.int64), points.cumsum(0)])
        square = np.concatenate([[0], (points * points).sum(1).cumsum()])
        return cls(ids.take(pa.array(order)), points, starts, np.array(size), np.array(left), np.array(radius), upto[ends] - upto[starts], square[ends] - square[starts])

    def record(self) -> list[pa.Array]:
        def one(values, kind: pa.DataType) -> pa.Array:
            flat = values.cast(kind) if isinstance(values, pa.Array) else pa.array(np.asarray(values).ravel(), kind)
            return pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat)

        return [one(self.ids, pa.int64()), one(self.points, pa.int64()), one(self.first, pa.int32()), one(self.size, pa.int32()), one(self.left, pa.int32()), one(self.radius, pa.float64()), one(self.sums, pa.int64()), one(self.squares, pa.int64())]

    @classmethod
    def read(cls, part: pa.RecordBatch, row: int) -> BallTree:
        def values(name: str) -> pa.Array:
            return part.column(name)[row].values

        ids, flat = values("ids"), {n: values(n).to_numpy(zero_copy_only=False) for n in ("points", "first", "size", "left", "radius", "sums", "squares")}
        n, m = len(ids), len(flat["first"])
        return cls(ids, flat["points"].reshape(n, -1), flat["first"], flat["size"], flat["left"], flat["radius"], flat["sums"].reshape(m, -1), flat["squares"])

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes that lie with one centroid as a whole and that centroid; the other rows and theirs.

        By the triangle inequality every row of a ball is nearer to one centroid
        than to another if the ball's centre is, by more than the ball's
        diameter.  Ties and whatever is close to one go down to the leaves.
        """
        real, level = centroids.astype(float), np.array([0])
        nodes, owners, rows = [], [], [np.zeros(0, np.int64)]
        while len(level):
            centre = self.sums[level] / self.size[level, None]
            away = np.sqrt(np.maximum((centre**2).sum(1)[:, None] - 2 * centre @ real.T + (real**2).sum(1), 0))
            best = away.argmin(1)
            near = np.take_along_axis(away, best[:, None], 1)[:, 0]
            np.put_along_axis(away, best[:, None], np.inf, 1)
            scale = np.sqrt((centre**2).sum(1) + (real**2).sum(1).max()) + self.radius[level]
            # the square root of a difference of squares is right to the root of a double's precision only
            whole = away.min(1) - near > 2 * self.radius[level] + scale * (SLACK + 1e-6)
            nodes.append(level[whole])
            owners.append(best[whole])
            open_ = level[~whole]
            inner = self.left[open_] >= 0
            rows += [np.arange(self.first[x], self.first[x] + self.size[x]) for x in open_[~inner]]
            level = np.concatenate([self.left[open_[inner]], self.left[open_[inner]] + 1])
        left_over = np.concatenate(rows)
        return np.concatenate(nodes), np.concatenate(owners), left_over, distances(self.points[left_over], centroids).argmin(1)


def distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to integer centroids."""
    if max(np.abs(points).max(initial=0), np.abs(centroids).max(initial=0)) <= IN_DOUBLES and points.shape[1] <= 1024:
        a, b = points.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * a @ b.T + (b * b).sum(1)).astype(np.int64)
    out = np.empty((len(points), len(centroids)), np.int64)
    for k, c in enumerate(centroids):
        out[:, k] = ((points - c) ** 2).sum(1)
    return out


def integer_vectors(df: DataFrame, vector: str, width: int, scale: int) -> DataFrame:
    """(vec_id, point): vectors of ``width`` finite components, each turned into floor(``scale`` * component)."""
    v, bad = F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    kept = df.where(F.col(vector).isNotNull() & (F.size(v) == width)).where(~F.exists(v, bad))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("point"))


def ball_trees(points: DataFrame, width: int) -> DataFrame:
    """One row a tree, over at most ``BLOCK`` rows that one task has read; nothing is shuffled."""
    most = largest_component(width)

    def build(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [part.split()[0] for part in TREE.split(", ")]
        for part in parts:
            for at in range(0, part.num_rows, BLOCK):
                rows = part.slice(at, BLOCK)
                x = rows.column("point").flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, width)
                if np.abs(x).max() > most or x.min() == np.iinfo(np.int64).min:
                    raise ValueError(f"a component beyond {most}: squared distances would leave 64 bits")
                yield pa.RecordBatch.from_arrays(BallTree.of(rows.column("vec_id"), x).record(), names=names)

    return points.mapInArrow(build, TREE)


def totals(trees: DataFrame, centroids: np.ndarray) -> dict[int, tuple[int, int, list[int]]]:
    """Rows, sum of squares and component sums by cluster: one row a cluster comes back."""
    k, width = centroids.shape

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                tree = BallTree.read(part, at)
                n, squares, sums = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((k, width), np.int64)
                nodes, owners, rows, own = tree.assign(centroids)
                np.add.at(n, owners, tree.size[nodes])
                np.add.at(squares, owners, tree.squares[nodes])
                np.add.at(sums, owners, tree.sums[nodes])
                for c in np.unique(own):
                    x = tree.points[rows[own == c]]
                    n[c] += len(x)
                    squares[c] += (x * x).sum()
                    sums[c] += x.sum(0)
                some = np.flatnonzero(n)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * width, pa.int32()), pa.array(sums[some].ravel(), pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(squares[some]), flat], names=["cluster", "n", "squares", "sums"])

    parts = trees.mapInArrow(partial, "cluster int, n long, squares long, sums array<long>")
    wide = "decimal(38,0)"
    found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.sum(F.col("squares").cast(wide)).alias("squares"), *[F.sum(F.get("sums", F.lit(i)).cast(wide)).alias(f"s{i}") for i in range(width)])
    return {r.cluster: (int(r.n), int(r.squares), [int(r[f"s{i}"]) for i in range(width)]) for r in found.collect()}


def cluster(df: DataFrame, vector: str = "embedding", clusters: int = 16, rounds: int = 3, width: int = 64, scale: int = 64, seed: str = "1") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly ``width`` components, none null or not finite.
    Components become floor(``scale`` * x), and all that follows is exact in
    integers.  The first centroids are the kept vectors whose
    sha256("``seed``:vec_id") is smallest (equal hashes, as of repeated ids: by
    components; a null id counts as no text).  In each round every vector goes
    to its nearest centroid, the smaller number on ties, and centroids with
    vectors become floor(sum / count).  Vectors are assigned once more at the end.

    Trees are built once, by the tasks that read the vectors, and written to
    the shared folder; a round reads them and sends one row for each tree and
    cluster on.  The driver holds ``clusters`` times ``width`` numbers.
    Repeated rows each count; fewer vectors than ``clusters`` make fewer
    clusters; no vectors give no rows.  Other columns don't matter.  A component
    so large that a squared distance would leave 64 bits is an error, as is an
    inertia beyond them.
    """
    points = integer_vectors(df, vector, width, scale)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    start = points.withColumn("digest", digest).orderBy("digest", "point").limit(clusters).collect()
    if not start:
        return df.sparkSession.createDataFrame([], FOUND)
    centroids = np.array([r.point for r in start], np.int64)
    trees = materialise(ball_trees(points, width), "trees")
    for _ in range(rounds):
        for c, (n, _, sums) in totals(trees, centroids).items():
            centroids[c] = [s // n for s in sums]
    inertia = {}
    for c, (n, squares, sums) in totals(trees, centroids).items():
        own = [int(x) for x in centroids[c]]
        # sums of squares may wrap within a task; modulo 2^64 the inertia, which fits, is right all the same
        inertia[c] = (squares - 2 * sum(a * b for a, b in zip(own, sums)) + n * sum(a * a for a in own)) % 2**64
    return labelled(trees, centroids, inertia)


def labelled(trees: DataFrame, centroids: np.ndarray, inertia: dict[int, int]) -> DataFrame:
    """Every vector with its cluster and what is said of it."""
    total = sum(inertia.values())
    if total >= 2**63:
        raise OverflowError("the inertia leaves 64 bits")
    digests = [hashlib.sha256(",".join(str(int(x)) for x in c).encode()).hexdigest() for c in centroids]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(part.num_rows):
                tree = BallTree.read(part, at)
                nodes, owners, rows, own = tree.assign(centroids)
                where = np.empty(len(tree.points), np.int64)
                where[rows] = own
                for x, c in zip(nodes, owners):
                    where[tree.first[x] : tree.first[x] + tree.size[x]] = c
                far = ((tree.points - centroids[where]) ** 2).sum(1)
                columns = [tree.ids, pa.array(where, pa.int32()), pa.array(far), pa.array([inertia[c] for c in where], pa.int64()), pa.array([total] * len(where), pa.int64()), pa.array([digests[c] for c in where])]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in FOUND.split(", ")])

    return trees.mapInArrow(run, FOUND)
