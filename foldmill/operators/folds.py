"""Cross-validation folds that keep classes even and groups whole."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.operators.ranking import numbered


def shuffled(key: Column, seed: int | str = 42) -> Column:
    """A digest that orders keys at random, the same in every run."""
    return F.md5(F.concat(key.cast("string"), F.lit(f"_{seed}")))


def majority_label(df: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label): the most frequent label of each group, the smallest on ties; nulls don't vote."""
    counts = df.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    return counts.groupBy(group).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label))


def stratified_folds(df: DataFrame, key: str, label: str, n: int = 5, seed: int | str = 42) -> DataFrame:
    """``df`` with a fold (0 .. n - 1) that spreads each class evenly: fold sizes by class differ by one at most."""
    rows = numbered(df, [label], shuffled(F.col(key), seed), [key], "_number")
    return rows.withColumn("fold", ((F.col("_number") - 1) % n).cast("int")).drop("_number")


def group_folds(df: DataFrame, group: str, label: str, n: int = 5, seed: int | str = 42) -> DataFrame:
    """(group, label, fold): groups folded by their majority label."""
    return stratified_folds(majority_label(df, group, label), group, label, n, seed)


def balanced_group_folds(df: DataFrame, group: str, label: str, n: int = 5, seed: int | str = 42) -> DataFrame:
    """(group, profile, fold): folds even in rows of every class, not just in groups.

    Groups with the same number of rows of each class form a stratum, named
    by its profile; each stratum is dealt to the folds in turn, in random
    order.  Groups of a stratum are interchangeable, so any class's rows differ
    between folds by no more than one group a stratum.
    """
    counts = df.groupBy(group, label).agg(F.count("*").alias("n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("l"), "n")))  # one entry a class
    profile = counts.groupBy(group).agg(F.to_json(pairs).alias("profile"))
    start = F.conv(F.substring(F.md5("profile"), 1, 6), 16, 10).cast("long")
    rows = numbered(profile, ["profile"], shuffled(F.col(group), seed), [group], "_number")
    return rows.withColumn("fold", ((F.col("_number") - 1 + start) % n).cast("int")).drop("_number")


#: Kinds of groups (equal rows of each class) that are placed one after the other; there may be more.
KINDS = 20_000
#: A group with more than this share of a fold's rows of some class is always among them.
LARGE = 0.02
#: Times that all kinds are placed again.
SWEEPS = 8


def placed_kinds(kinds: Sequence[tuple[Sequence[int], int]], totals: Sequence[int], n: int) -> list[list[int]]:
    """How many of each kind's groups go to each fold, for kinds (rows by class, groups) in the order given.

    A kind's groups go where its classes are short of an even share, as water
    fills a vessel: shares of real numbers first, whose whole parts are taken; what
    is left is placed one by one where the squared relative distance from even shares grows least.
    Then each kind is taken out and placed again among all the others, ``SWEEPS`` times, where that is better.
    """
    even = np.array(totals, float) / n
    scale = np.where(even > 0, 1 / np.maximum(even, 1e-300), 0.0)
    held = np.zeros((n, len(even)))

    def place(p: np.ndarray, groups: int) -> np.ndarray:
        short, weight = ((even - held) * scale**2) @ p, (p * scale) @ (p * scale)
        given = np.zeros(n, np.int64)
        if groups > 1 and weight > 0:
            order = np.sort(short)[::-1]
            # the level m at which sum(max(0, short - m)) / weight is the number of groups
            levels = (np.cumsum(order) - groups * weight) / np.arange(1, n + 1)
            level = levels[max(k for k in range(n) if k == 0 or order[k] > levels[k])]
            given = np.floor(np.maximum(0.0, short - level) / weight + 1e-9).astype(np.int64)
            while given.sum() > groups:
                given[given.argmax()] -= 1
        for _ in range(groups - int(given.sum())):
            # (held + p - even)^2 - (held - even)^2 by fold; then the fold with fewest rows
            now = held + given[:, None] * p
            worse = np.round((((2 * (now - even) + p) * p) * scale**2).sum(1), 9)
            given[min(range(n), key=lambda f: (worse[f], now[f].sum(), f))] += 1
        return given

    def distance() -> float:
        return float((((held - even) * scale) ** 2).sum())

    out = []
    for rows, groups in kinds:
        p = np.array(rows, float)
        out.append(place(p, groups))
        held += out[-1][:, None] * p
    for _ in range(SWEEPS):
        before = distance()
        for k, (rows, groups) in enumerate(kinds):
            p, old, was = np.array(rows, float), out[k], distance()
            held -= old[:, None] * p
            out[k] = place(p, groups)
            held += out[k][:, None] * p
            if distance() > was - 1e-12:
                held += (old - out[k])[:, None] * p
                out[k] = old
        if distance() > before - 1e-9:
            break
    return [g.tolist() for g in out]


def greedy_group_folds(df: DataFrame, group: str, label: str, n: int = 5, seed: int | str = 42) -> DataFrame:
    """(group, profile, fold): whole groups, placed so that every class is spread evenly even if few groups hold most of it.

    Groups with equal rows of each class are of a kind.  The kinds with a group that
    holds more than ``LARGE`` of a fold's rows of a class, of which there can only be a fixed
    number, and the most frequent others are placed by
    :func:`placed_kinds`, largest groups first, with the rows of each fold and class as state; a kind's
    groups take their folds in hashed order.  Kinds beyond ``KINDS`` are dealt in turn.
    Rows without a group or label are left out.
    """
    known = df.where(F.col(group).isNotNull() & F.col(label).isNotNull())
    counts = known.groupBy(group, label).agg(F.count("*").alias("n"))
    totals = {r["l"]: r["n"] for r in counts.groupBy(F.col(label).cast("string").alias("l")).agg(F.sum("n").alias("n")).collect()}  # a row a class
    names = sorted(totals)
    pairs = F.sort_array(F.collect_list(F.struct(F.col(label).cast("string").alias("l"), "n")))  # one entry a class
    profiles = counts.groupBy(group).agg(F.to_json(pairs).alias("profile"), F.sum("n").alias("rows"), F.max(F.col("n") / quota(label, totals, n)).alias("part"))
    kinds = profiles.groupBy("profile").agg(F.count("*").alias("groups"), F.first("rows").alias("rows"), F.first("part").alias("part"))
    top = kinds.orderBy(F.desc(F.col("part") > LARGE), F.desc("groups"), "profile").limit(KINDS).collect()
    top.sort(key=lambda r: (-r.part, -r.rows, r.profile))
    rows = [[dict((x["l"], x["n"]) for x in json.loads(r.profile)).get(c, 0) for c in names] for r in top]
    given = placed_kinds([(p, r.groups) for p, r in zip(rows, top)], [totals[c] for c in names], n)
    ends = [(r.profile, np.cumsum(g).tolist()) for r, g in zip(top, given)]
    table = df.sparkSession.createDataFrame(ends, "profile string, ends array<long>")
    numbers = numbered(profiles.select(group, "profile"), ["profile"], shuffled(F.col(group), seed), [group], "_number")
    placed = F.size(F.filter("ends", lambda e: e < F.col("_number")))
    in_turn = ((F.col("_number") - 1 + F.conv(F.substring(F.md5("profile"), 1, 6), 16, 10).cast("long")) % n).cast("int")
    found = numbers.join(F.broadcast(table), "profile", "left")  # KINDS rows at most
    return found.select(group, "profile", F.when(F.col("ends").isNull(), in_turn).otherwise(placed).alias("fold"))


def quota(label: str, totals: dict[str, int], n: int) -> Column:
    """An even fold's rows of the class; null if there are no rows at all."""
    if not totals:
        return F.lit(None).cast("double")
    return F.create_map(*[F.lit(x) for c, m in totals.items() for x in (c, m / n)])[F.col(label).cast("string")]


def assign_folds(df: DataFrame, folds: DataFrame, group: str) -> DataFrame:
    """``df`` with its groups' folds; rows of unknown groups get null."""
    return df.join(folds.select(group, "fold"), group, "left")


def split_name(fold: Column, test_fold: Column, n: int = 5) -> Column:
    """test, val (the next fold, cyclically) or train; null without a fold."""
    return F.when(fold.isNull(), None).when(fold == test_fold, "test").when(fold == (test_fold + 1) % n, "val").otherwise("train")


def split_table(df: DataFrame, n: int = 5) -> DataFrame:
    """Every row once for each test fold, with test_fold and split."""
    each = df.withColumn("test_fold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return each.withColumn("split", split_name(F.col("fold"), F.col("test_fold"), n))


def leaking_groups(df: DataFrame, group: str) -> DataFrame:
    """Groups that lie in more than one fold, with their folds; none is right."""
    return df.groupBy(group).agg(F.countDistinct("fold").alias("n_folds"), F.sort_array(F.collect_set("fold")).alias("folds")).where("n_folds > 1")


def shared_groups(df: DataFrame, group: str, test_fold: int) -> DataFrame:
    """Groups that lie both in a test fold and outside it; none is right."""
    inside, outside = df.where(F.col("fold") == test_fold).select(group), df.where(F.col("fold") != test_fold).select(group)
    return inside.intersect(outside)


def unassigned(df: DataFrame) -> DataFrame:
    """Rows without a fold; none is right."""
    return df.where(F.col("fold").isNull())


def check_folds(df: DataFrame, group: str) -> None:
    """Raise if a row has no fold or a group lies in several."""
    if not unassigned(df).isEmpty():
        raise ValueError("rows without a fold")
    if not leaking_groups(df, group).isEmpty():
        raise ValueError("groups in more than one fold")
