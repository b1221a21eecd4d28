"""Sharding by a k-d tree over metadata, cut at distributed weighted medians."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldmill.llm.common import drop_table, materialise

#: Fixed bytes of a document besides its text.
OVERHEAD = 16
#: A cut may miss its share of the bytes by this part of what goes to its smaller side; beyond AGAIN times that it is searched again.
TOLERANCE, AGAIN = 0.002, 4
#: Buckets that number a shard's rows side by side.
BUCKETS = 64
#: A row's place on a dimension is a string of hex digits: 4 of the value and 16 of the text's hashes, the same for equal texts;
#: rows of groups that have to be divided go on with 16 of the id's hash and 16 of the row's number, others with zeros.
LENGTH, OWN_DIGITS = 52, 32
#: Groups of equal texts of more than 1 / HEAVY of a shard are broadcast (there are HEAVY * shards at most), others are joined.
HEAVY = 16
#: Digits by which the search goes on: 256 sums for each node.
AT_ONCE = 2
#: Comes after every hex digit.
AFTER = "g"


@dataclass
class Node:
    """A node of the tree that is being cut: it takes shards first .. first + shards - 1."""

    first: int
    shards: int
    bytes: int = 0
    dim: int = 0
    prefix: str = ""
    below: int = 0  # bytes before the prefix
    cut: str = ""  # rows whose place comes before it go left
    aside: str = ""  # start of the places of a group that goes to the side of its own
    aside_left: bool = False
    aside_bytes: int = 0  # that it brings to the left
    error: float = float("inf")  # bytes by which the best cut so far misses
    best: tuple[str, str, bool] = ("", "", False)  # that cut, with the group set aside


def hexed(x: Column, digits: int) -> Column:
    return F.lpad(F.hex(x), digits, "0")


def scaled(x: Column) -> Column:
    """A hash of a label, as a number below 2 ** 16; null is 0."""
    return F.coalesce(F.crc32(x.cast("string").cast("binary")) % 65535 + 1, F.lit(0))


def by_node(values: dict[int, int | str]) -> Column:
    """A value for each row by its node; null for other nodes."""
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("node")]


def place(level: list[Node], dims: int) -> Column:
    """Where a row stands on the dimension along which its node is cut."""
    dim = by_node({n.first: n.dim + 1 for n in level})
    return F.concat(F.element_at(F.array(*[F.col(f"d{d}") for d in range(dims)]), dim), F.col("tail"))


def is_aside(level: list[Node], dims: int) -> Column:
    """Whether a row belongs to the group that its node sets aside."""
    start = by_node({n.first: n.aside for n in level})
    return (start != "") & F.coalesce(F.startswith(place(level, dims), start), F.lit(False))


def search(rows: DataFrame, searching: list[Node], dims: int, slack: float) -> None:
    """Find each node's cut, two digits at a time.

    One aggregate a round adds up the bytes by node and digits, of the rows that
    share the digits so far; 256 sums for each node reach the driver.
    """
    for done in range(0, LENGTH, AT_ONCE):
        here = rows.select("node", "size", "divided", "group", place(searching, dims).alias("place"), by_node({n.first: n.prefix for n in searching}).alias("prefix"))
        if any(n.aside for n in searching):
            here = here.where(~is_aside(searching, dims))
        sums = (
            here.where(F.substring("place", 1, done) == F.col("prefix"))
            .groupBy("node", F.substring("place", done + 1, AT_ONCE).alias("digits"))
            .agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.max("divided").alias("divided"), (F.min("group") == F.max("group")).alias("one"))
        )
        by: dict[int, list[tuple[str, int, bool]]] = {}
        for r in sums.collect():
            end = r["n"] == 1 or (r["one"] and not r["divided"]) or done + AT_ONCE >= LENGTH
            by.setdefault(r["node"], []).append((r["digits"], r["b"], end))
        searching = [n for n in searching if not settle(n, sorted(by.get(n.first, [])), slack)]
        if not searching:
            break


def settle(n: Node, sums: list[tuple[str, int, bool]], slack: float) -> bool:
    """Note the node's cut if a border is near enough to its share of the bytes, else go some digits on.

    ``sums`` has, for the digits that follow, the bytes and whether there is but
    one group (or row) to them.
    """
    if not sums:
        n.best = (n.prefix, n.aside, n.aside_left)
        n.error = 0.0
        return True
    goal, before = n.bytes * (n.shards // 2) / n.shards - n.aside_bytes, n.below
    for digits, b, end in sums:
        if before + b >= goal:
            break
        before += b
    low, high = abs(goal - before), abs(before + b - goal)
    slack *= n.shards // 2
    if min(low, high) > slack and not end:
        n.prefix += digits
        n.below = before
        return False
    if min(low, high) < n.error:
        n.error, n.best = min(low, high), (n.prefix + digits + ("" if low <= high else AFTER), n.aside, n.aside_left)
    # what stands at the cut is set aside, should another search follow
    n.aside, n.aside_left, n.aside_bytes = n.prefix + digits, high < low, b if high < low else 0
    n.prefix, n.below = "", 0
    return True


def grow(meta: DataFrame, shards: int, dims: int) -> DataFrame:
    """``meta`` with the shard of each row in the column node, split level by level.

    For all nodes of a level one aggregate gives the extent of each dimension,
    and the widest is cut at the weighted quantile.  Where a large group stands at
    the cut, a second search without it may come nearer: the group then goes
    to the side it belongs to more and the cut makes up for it.  The driver holds the nodes
    of a level, whatever the input; a level's outcome is written to the shared folder.
    """
    total = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).collect()[0]["b"]
    slack = TOLERANCE * total / shards  # for each shard of the smaller side
    rows, level = meta.withColumn("node", F.lit(0)), [Node(0, shards)]
    while level := [n for n in level if n.shards > 1]:
        wide = [(F.conv(F.max(f"d{d}"), 16, 10).cast("int") - F.conv(F.min(f"d{d}"), 16, 10).cast("int")).alias(f"w{d}") for d in range(dims)]
        at = rows.where(F.col("node").isin([n.first for n in level]))
        found = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("bytes"), *wide).collect()}
        for n in level:
            r = found.get(n.first)
            n.bytes = r["bytes"] if r else 0
            n.dim = max(range(dims), key=lambda d: (r[f"w{d}"], -d)) if r else 0
        search(rows, level, dims, slack)
        again = [n for n in level if n.error > AGAIN * slack * (n.shards // 2)]
        if again:
            search(rows, again, dims, slack)
        for n in level:
            n.cut, n.aside, n.aside_left = n.best
        right = by_node({n.first: n.first + n.shards // 2 for n in level})
        beyond = place(level, dims) >= by_node({n.first: n.cut for n in level})
        goes = F.when(is_aside(level, dims), ~by_node({n.first: n.aside_left for n in level})).otherwise(beyond)
        before, rows = rows, materialise(rows.withColumn("node", F.coalesce(F.when(goes, right), F.col("node"))), "shards")
        drop_table(before)
        level = [c for n in level for c in (Node(n.first, n.shards // 2), Node(n.first + n.shards // 2, n.shards - n.shards // 2))]
    return rows


def grouped(meta: DataFrame, shards: int) -> DataFrame:
    """``meta`` with the place of each row: equal texts share one, that of the group's smallest source and language.

    Groups larger than a shard have to be divided: their rows follow one another.
    """
    share = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).collect()[0]["b"] / shards
    key = ["group", "size"]
    found = meta.groupBy(*key).agg(F.count("*").alias("n"), F.min("source").alias("first_source"), F.min("lang").alias("first_lang")).where("n > 1")
    groups = materialise(found.withColumn("divided", F.col("n") * F.col("size") > share), "groups")
    heavy = F.col("n") * F.col("size") * HEAVY > share
    flagged = meta.join(F.broadcast(groups.where(heavy)), key, "left")  # HEAVY * shards rows at most
    few = flagged.where(F.col("n").isNull()).select(*meta.columns).join(groups.where(~heavy), key, "left")
    rows = flagged.where(F.col("n").isNotNull()).unionByName(few)
    divided = F.coalesce("divided", F.lit(False))
    digits = F.when(divided, F.concat("id_hash", hexed(F.col("number"), 16))).otherwise("0" * OWN_DIGITS)
    placed = rows.select(
        "doc_id", "size", "text_crc32", "id_hash", divided.alias("divided"), "d0",
        hexed(F.coalesce("first_source", "source"), 4).alias("d1"), hexed(F.coalesce("first_lang", "lang"), 4).alias("d2"),
        "group", F.concat(hexed(F.col("group"), 16), digits).alias("tail"),
    )
    out = materialise(placed, "places")
    drop_table(groups)
    return out


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, overhead: int = OVERHEAD) -> DataFrame:
    """Put every document into one of ``shards`` shards of near equal bytes.

    ``docs`` needs doc_id, text, lang and source; other columns are not read.
    Give ``shards``, or ``target_bytes`` for as many as that takes.  Returns
    doc_id, size (UTF-8 bytes of the text plus ``overhead``), text_crc32, shard,
    and slot (gapless from 0 within the shard).

    The metadata dimensions are the text's length (logarithmic), its source and its
    language.  A node of the tree is cut along the dimension in which it is
    widest, at the weighted median (for an odd number of shards, the quantile).
    Rows that tie are ordered by hashes of the text.  Equal texts have one place,
    whatever their sources and languages, and no cut passes through them; only a
    group larger than a shard is divided, by a hash of the id and then the row's number,
    so that rows alike in everything are spread too.

    Null texts count as empty (crc32 0); null sources, languages and ids are
    values of their own; an empty table gives no rows.  A rerun may swap rows
    that are alike in text and id, which the result doesn't show.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    text = F.coalesce("text", F.lit(""))
    meta = materialise(
        docs.select(
            "doc_id",
            (length + overhead).alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.shiftleft(F.crc32(text.cast("binary")), 32).bitwiseOR(F.shiftrightunsigned(F.xxhash64(text), 32)).alias("group"),
            hexed(F.least(F.floor(F.log2((length + 1).cast("double")) * 2048), F.lit(65535)).cast("long"), 4).alias("d0"),
            scaled(F.col("source")).alias("source"),
            scaled(F.col("lang")).alias("lang"),
            hexed(F.xxhash64("doc_id"), 16).alias("id_hash"),
            F.monotonically_increasing_id().alias("number"),
        ),
        "metadata",
    )
    if shards is None:
        total = meta.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b")).collect()[0]["b"]
        shards = max(1, -(-total // (target_bytes or 1)))
    placed = grouped(meta, shards)
    drop_table(meta)
    placed = grow(placed, shards, 3).select("doc_id", "size", "text_crc32", "id_hash", F.col("node").alias("shard"))
    # A row's slot: its number inside a bucket of its shard, after the buckets before; shards * BUCKETS counts.
    placed = placed.withColumn("bucket", F.conv(F.substring("id_hash", -2, 2), 16, 10).cast("int") % BUCKETS)
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("start"))
    inside = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("id_hash", "doc_id", "text_crc32", "size")) - 1
    numbered = placed.withColumn("inside", inside).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("inside")).cast("long").alias("slot"))
