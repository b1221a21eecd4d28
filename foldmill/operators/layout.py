"""Rows in two dimensions, so that near neighbours stay near: a layout of the neighbour graph."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.sources.shared import drop_table, materialise

#: Rows of a block, whose places are improved together in one task.
BLOCK = 4096
#: Steps of the power method, between times at which its vectors are made orthogonal again.
POWER, APART = 12, 4
#: Passes over a block's edges in all, times that blocks exchange places, and places drawn to push away from, by edge.
PASSES, EXCHANGES, PUSHES = 300, 10, 5
#: Places of the whole layout that every block pushes away from, beside its own.
FAR = 2048
#: Edges of one row, about: of more, a share by hash is kept on its side (not on the others').
EDGES = 256


def bandwidths(edges: DataFrame) -> DataFrame:
    """(a, b, w): each row's edges with weights exp(-(distance - smallest) / bandwidth).

    The bandwidth is found by bisection, so that a row's weights sum to log2 of its number of edges.
    """
    lists = edges.groupBy("id").agg(F.sort_array(F.collect_list(F.struct((1 - F.col("similarity")).alias("d"), "neighbour"))).alias("e"))

    def weigh(frames):
        for frame in frames:
            for size, part in frame.groupby(frame["e"].map(len)):
                d = np.array([[x["d"] for x in e] for e in part["e"]], float).reshape(len(part), size)
                d = np.maximum(d - d[:, :1], 0.0)
                goal, lo, hi = max(math.log2(size), 1e-3), np.full(len(d), 1e-12), np.full(len(d), 1e3)
                for _ in range(60):
                    mid = np.sqrt(lo * hi)
                    much = np.exp(-d / mid[:, None]).sum(1) > goal
                    lo, hi = np.where(much, lo, mid), np.where(much, mid, hi)
                w = np.exp(-d / hi[:, None])
                yield pd.DataFrame({"a": np.repeat(part["id"].to_numpy(), size), "b": [x["neighbour"] for e in part["e"] for x in e], "w": w.ravel()})

    return lists.mapInPandas(weigh, "a long, b long, w double")


def symmetric(weights: DataFrame) -> DataFrame:
    """(a, b, w) in both directions: w + w' - w w' of the two weights; thinned where a row has very many."""
    both = weights.select("a", "b", "w", F.lit(0.0).alias("v")).unionAll(weights.select(F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.0), F.col("w")))
    joined = both.repartition("a").groupBy("a", "b").agg(F.sum("w").alias("w"), F.sum("v").alias("v")).select("a", "b", (F.col("w") + F.col("v") - F.col("w") * F.col("v")).alias("w"))
    many = joined.withColumn("n", F.count("*").over(Window.partitionBy("a")))
    return many.where(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 20)) < F.lit(EDGES << 20) / F.col("n")).select("a", "b", "w")


def drawn(*what) -> Column:
    """A number from -1 to 1 by hash."""
    return F.pmod(F.xxhash64(*what), F.lit(1 << 30)) / F.lit(float(1 << 29)) - 1.0


def leading_vectors(edges: DataFrame, seed: int) -> DataFrame:
    """(id, x, y): two leading eigenvectors of the normalised weights, but the trivial one, by power steps over the edges."""
    size = materialise(edges.groupBy("a").agg(F.sqrt(F.sum("w")).alias("root")), "sizes")
    now = materialise(size.select(F.col("a").alias("id"), "root", drawn(F.col("a"), F.lit(seed)).alias("x"), drawn(F.col("a"), F.lit(seed + 1)).alias("y")), "vectors")
    for step in range(1, POWER + 1):
        there = now.select(F.col("id").alias("b"), (F.col("x") / F.col("root")).cast("float").alias("bx"), (F.col("y") / F.col("root")).cast("float").alias("by"))
        sums = edges.join(there, "b").groupBy("a").agg(F.sum(F.col("w") * F.col("bx")).alias("sx"), F.sum(F.col("w") * F.col("by")).alias("sy"))
        nearer = now.join(sums.withColumnRenamed("a", "id"), "id").select("id", "root", ((F.col("x") + F.col("sx") / F.col("root")) / 2).alias("x"), ((F.col("y") + F.col("sy") / F.col("root")) / 2).alias("y"))
        nearer = materialise(nearer, "vectors")
        drop_table(now)
        now = nearer
        if step % APART == 0:
            s = now.agg(*[F.sum(F.col(p) * F.col(q)).alias(f"{p}_{q}") for p, q in (("root", "root"), ("x", "root"), ("y", "root"), ("x", "x"), ("x", "y"), ("y", "y"))]).first()
            rr = s.root_root
            cx, cy = s.x_root / rr, s.y_root / rr
            xx, xy, yy = s.x_x - cx * cx * rr, s.x_y - cx * cy * rr, s.y_y - cy * cy * rr
            over = xy / xx if xx > 0 else 0.0
            nx, ny = math.sqrt(max(xx, 1e-300)), math.sqrt(max(yy - over * xy, 1e-300))
            x, y = F.col("x") - cx * F.col("root"), F.col("y") - cy * F.col("root")
            now = now.select("id", "root", (x / nx).alias("x"), ((y - over * x) / ny).alias("y"))
    top = now.agg(F.max(F.abs(F.col("x") / F.col("root"))), F.max(F.abs(F.col("y") / F.col("root")))).first()
    out = [(F.col(c) / F.col("root") * (10.0 / max(t, 1e-300)) + 1e-3 * drawn(F.col("id"), F.lit(c))).alias(c) for c, t in zip("xy", top)]
    return now.select("id", *out)


def curve(least: float) -> tuple[float, float]:
    """a and b of 1 / (1 + a d^2b), next to 1 up to the distance ``least`` and exp(-(d - least)) beyond, by least squares."""
    d = np.linspace(0, 3, 300)[1:]
    goal = np.where(d < least, 1.0, np.exp(-(d - least)))
    a, b = 1.0, 1.0
    for _ in range(200):
        power = d ** (2 * b)
        f = 1 / (1 + a * power)
        j = np.stack([-power * f * f, -2 * a * np.log(d) * power * f * f], 1)
        step = np.linalg.lstsq(j.T @ j + 1e-6 * np.eye(2), j.T @ (goal - f), rcond=None)[0]
        a, b = max(1e-3, a + 0.5 * step[0]), max(1e-2, b + 0.5 * step[1])
    return a, b


def improved(frame: pd.DataFrame, far: np.ndarray, a: float, b: float, passes: int, rate: tuple[float, float], seed: int) -> pd.DataFrame:
    """New places of a block's rows: edges pull, drawn places push; rows of other blocks stay where they are.

    ``frame`` has a, ax, ay, b, bx, by, w of every edge from a row of the block.
    """
    frame = frame.sort_values(["a", "b"], kind="stable")
    ids, first = np.unique(frame["a"].to_numpy(), return_index=True)
    own = frame[["ax", "ay"]].to_numpy()[first]
    source, target = np.searchsorted(ids, frame["a"].to_numpy()), np.searchsorted(ids, frame["b"].to_numpy())
    inside = (target < len(ids)) & (ids[np.minimum(target, len(ids) - 1)] == frame["b"].to_numpy())
    fixed = frame[["bx", "by"]].to_numpy()[~inside]
    target = np.where(inside, target, 0)
    target[~inside] = len(ids) + np.arange(len(fixed))
    places = np.concatenate([own, fixed, far])
    weight = frame["w"].to_numpy() / frame["w"].max()
    pool = np.r_[np.arange(len(ids)), len(ids) + len(fixed) + np.arange(len(far))]
    random = np.random.RandomState(seed)

    def push_or_pull(at: np.ndarray, other: np.ndarray, strength: np.ndarray, attract: bool, lr: float) -> None:
        diff = places[at] - places[other]
        d2 = np.maximum((diff**2).sum(1), 1e-9)
        scale = -2 * a * b * d2 ** (b - 1) / (1 + a * d2**b) if attract else 2 * b / ((1e-3 + d2) * (1 + a * d2**b))
        move = np.clip(diff * scale[:, None], -4, 4) * (strength * lr)[:, None]
        np.add.at(places, at, move)

    for p in range(passes):
        lr = rate[0] + (rate[1] - rate[0]) * p / passes
        used = np.flatnonzero(random.random_sample(len(weight)) < weight)
        random.shuffle(used)
        for some in np.array_split(used, max(1, min(8, len(used) // 64))):
            # both ends of an edge have it, so each is pulled by its own
            push_or_pull(source[some], target[some], np.ones(len(some)), True, lr)
            at = np.repeat(source[some], PUSHES)
            other = pool[random.randint(0, len(pool), len(at))]
            push_or_pull(at, other, (other != at).astype(float), False, lr)
    return pd.DataFrame({"id": ids, "x": places[: len(ids), 0], "y": places[: len(ids), 1]})


def mover(far: np.ndarray, shape: tuple[float, float], passes: int, rate: tuple[float, float], seed: int):
    """:func:`improved` as a function of a block's number, its rows with their lists of edges, and the places (b, x, y) outside that those lead to."""

    def move(key: tuple, own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        if not len(own):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "x": np.zeros(0), "y": np.zeros(0)})
        ids, places = np.r_[own["id"].to_numpy(), outside["b"].to_numpy()].astype(np.int64), np.r_[own[["x", "y"]].to_numpy(), outside[["x", "y"]].to_numpy()]
        order = np.argsort(ids)
        size = own["to"].map(len).to_numpy()
        b, w = np.concatenate(own["to"].to_list()), np.concatenate(own["w"].to_list()).astype(float)
        at = order[np.minimum(np.searchsorted(ids, b, sorter=order), len(ids) - 1)]
        ends = {"a": np.repeat(ids[: len(own)], size), "b": b, "w": w, "bx": places[at, 0], "by": places[at, 1]}
        ends |= {"ax": np.repeat(places[: len(own), 0], size), "ay": np.repeat(places[: len(own), 1], size)}
        return improved(pd.DataFrame(ends)[ids[at] == b], far, *shape, passes, rate, (seed + int(key[0])) % 2**32)

    return move


def neighbour_layout(edges: DataFrame, least: float = 0.3, passes: int = PASSES, seed: int = 42, block: int = BLOCK) -> DataFrame:
    """(id, x, y) from the neighbour edges (id, neighbour, similarity), as of :func:`graph.neighbour_graph`.

    Edges get weights by each row's own bandwidth, joined with those of the other
    direction.  Places start from the leading eigenvectors of the weights.  Rows are
    then dealt into blocks by their places, along one axis and the other in turn;
    a task moves a block's rows, by pulls along edges and pushes from drawn places, while what lies in other
    blocks stays; after each exchange the blocks are dealt anew.  Every draw is
    by hash or seed, so runs agree as far as sums in another order do.  No table is
    gathered: the driver sees ``FAR`` places, drawn by hash.  A table without edges gives no rows.
    """
    wired = materialise(symmetric(bandwidths(edges)).withColumn("w", F.col("w").cast("float")), "weights")
    if wired.isEmpty():
        return wired.select(F.col("a").alias("id"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    places = materialise(leading_vectors(wired, seed), "places")
    edges_of = F.sort_array(F.collect_list(F.struct("b", "w")))
    lists = materialise(wired.groupBy(F.col("a").alias("id")).agg(edges_of.alias("e")).select("id", F.col("e.b").alias("to"), F.col("e.w").alias("w")), "lists")
    drop_table(wired)
    n = places.count()
    blocks = max(1, math.ceil(n / block))
    a, b = curve(least)
    rounds = 1 if blocks == 1 else EXCHANGES
    for r in range(rounds):
        if blocks == 1:
            dealt, far = places.withColumn("block", F.lit(0)), np.zeros((0, 2))
        else:
            # more blocks than asked for do no harm
            axis, other = ("x", "y") if r % 2 == 0 else ("y", "x")
            dealt = materialise(places.repartitionByRange(blocks, axis, other, "id").withColumn("block", F.spark_partition_id()), "dealt")
            seen = dealt.where(F.pmod(F.xxhash64("id", F.lit(r)), F.lit(1 << 20)) < (FAR << 20) / n).orderBy("id").limit(2 * FAR).select("x", "y").collect()
            far = np.array([(p.x, p.y) for p in seen], float).reshape(-1, 2)
        # a place goes once to each other block that has an edge to it
        own = lists.join(dealt, "id")
        asked = lists.select("id", "to").join(dealt.select("id", "block"), "id").select(F.explode("to").alias("b"), "block").repartition("b").distinct()
        outside = asked.join(dealt.select(F.col("id").alias("b"), "x", "y", F.col("block").alias("home")), "b").where("block <> home").select(F.col("block").alias("to_block"), "b", "x", "y")
        rate = (1 - r / rounds, 1 - (r + 1) / rounds)

        move = mover(far, (a, b), max(1, passes // rounds), rate, seed * 1_000_003 + r * 10_007)
        moved = materialise(own.groupBy("block").cogroup(outside.groupBy("to_block")).applyInPandas(move, "id long, x double, y double"), "places")
        drop_table(places)
        if blocks > 1:
            drop_table(dealt)
        places = moved
    drop_table(lists)
    return places
