"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact intersection."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldmill.llm.common import batches, drop_table, map_texts, materialise

#: Edges of the size bands grow by this factor.
BAND = 1.5
#: Rounds that compare each document with one other of its tiles, before all that is left.
STAR_ROUNDS = 2
#: Members of a tile that are compared in full; those of larger tiles have to share a rare shingle too.
FULL = 256
#: Sets of a block: pairs of sets that share a key are made by pairs of blocks.
BLOCK = 256
#: Texts that one head is compared with in one place.
SHARED = 256
MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)
    take = min(width, len(words))
    x = np.full(len(words) - take + 1, take, np.uint64)
    for k in range(take):
        x = mixed(x * MIX + h[k : len(words) - take + 1 + k])
    return np.unique(x)


def bitmap(values: np.ndarray) -> np.ndarray:
    """Parity bitmap, one to two bits an element: bit i is whether an odd number of elements hash to i."""
    bits = 64 << max(0, math.ceil(math.log2(max(len(values), 1) / 64)))
    count = np.bincount((values >> np.uint64(7)).astype(np.int64) % bits, minlength=bits)
    return np.packbits((count & 1).astype(np.uint8), bitorder="little").view(np.int64)


def band_of(n: int) -> int:
    """Band b holds the sizes of which b is the rounded-down logarithm."""
    b = int(math.log(n) / math.log(BAND) + 1e-9)
    while n < math.ceil(BAND**b):
        b -= 1
    while n >= math.ceil(BAND ** (b + 1)):
        b += 1
    return b


def tiles_of(values: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys of the tiles a set belongs to: any two sets that link, and differ, share one at least.

    Sets that link differ in d <= (sum of sizes) * (den - num) / (den + num)
    elements.  For each band that the larger of a pair may be in, the hash space
    is dealt into more parts than d can be; some part then holds the same
    elements in both, and the part's content is the key.  Parts with at most one
    element are poor keys, and empty ones say nothing; as parts outnumber d by some,
    both kinds are left out, or the empty ones alone, unless a set has so many of them that the equal
    parts might all be among them.  Of two sets the one that leaves out more has
    an equal part among the rest, and the other keeps that part too.
    """
    n = len(values)
    top = n * den // num  # the largest partner
    most = (n + top) * (den - num) // (den + num)
    if most == 0:
        return np.zeros(0, np.int64)  # only equal sets link
    h = mixed(values)
    keys = []
    for band in range(band_of(n), band_of(top) + 1):
        largest = math.ceil(BAND ** (band + 1)) - 1
        bound = 2 * largest * (den - num) // (den + num)
        parts = bound + max(2, bound // 8) + 1
        part = ((values >> np.uint64(11)) % np.uint64(parts)).astype(np.int64)
        count = np.bincount(part, minlength=parts)
        content = np.zeros(parts, np.uint64)
        np.add.at(content, part, h)
        spare = parts - most  # parts that are equal in any two sets that link, at least
        least = next((k for k in (2, 1) if (count < k).sum() < spare), 0)
        at = np.flatnonzero(count >= least)
        keys.append(mixed(content[at] * MIX + at.astype(np.uint64) * np.uint64(1024) + np.uint64(band)))
    return np.concatenate(keys).view(np.int64)


def link(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """den * |a and b| >= num * |a or b| for two sorted arrays."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return den * both >= num * (len(a) + len(b) - both)


def signed64(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n, h1, h2 (of the whole set) and bitmap of every document."""

    def signed(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in texts]
        raw = [s.tobytes() for s in sets]
        return {
            "n": [len(s) for s in sets],
            "h1": [signed64(xxhash.xxh64_intdigest(r, 1)) for r in raw],
            "h2": [signed64(xxhash.xxh64_intdigest(r, 2)) for r in raw],
            "bitmap": [bitmap(s) for s in sets],
        }

    return map_texts(ids_and_texts(docs), "n long, h1 long, h2 long, bitmap array<long>", lambda: signed)


def set_tiles(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(rep, keys): the tiles of each distinct set, under the smallest id that has it."""

    def tiled(texts: list[str | None]) -> dict[str, list]:
        sets = [shingle_set(t, width) for t in texts]
        raw = [s.tobytes() for s in sets]
        return {
            "h1": [signed64(xxhash.xxh64_intdigest(r, 1)) for r in raw],
            "h2": [signed64(xxhash.xxh64_intdigest(r, 2)) for r in raw],
            "keys": [tiles_of(s, num, den) if len(s) else s.view(np.int64) for s in sets],
        }

    named = ids_and_texts(docs).where("doc_id is not null")
    found = map_texts(named, "h1 long, h2 long, keys array<long>", lambda: tiled, most=256).where("size(keys) > 0")
    return found.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys")).select("rep", "keys")


def shared_tiles(sets: DataFrame, made: list[DataFrame]) -> DataFrame:
    """(key, rep, head) of the tiles that several sets share; the head is the smallest.

    Rows are dealt by ranges of key and set, so that a tile of many sets is cut
    like any other run of rows, and are read in order: a tile that lies in one
    partition is settled there.  The first and last tile of each partition may go
    on in others; their heads come from pre-aggregated minima.  The table
    that the tiles are read from is added to ``made``.
    """
    rows = sets.select(F.explode("keys").alias("key"), "rep").repartitionByRange("key", "rep").sortWithinPartitions("key", "rep")

    def settled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, rep, first = np.zeros(0, np.int64), np.zeros(0, np.int64), True

        def told(key: np.ndarray, rep: np.ndarray, cut: bool) -> pd.DataFrame:
            """Rows of whole tiles; with ``cut`` all of them may go on elsewhere, else the first tile may if ``first``."""
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, int)
            sizes = np.diff(np.r_[starts, len(key)])
            open_end = np.full(len(starts), cut) | (first & (np.arange(len(starts)) == 0))
            keep = open_end | (rep[starts] != rep[starts + sizes - 1])
            at = np.repeat(keep, sizes)
            return pd.DataFrame({"key": key[at], "rep": rep[at], "head": np.repeat(rep[starts], sizes)[at], "cut": np.repeat(open_end, sizes)[at]})

        for frame in frames:
            key, rep = np.r_[key, frame["key"].to_numpy()], np.r_[rep, frame["rep"].to_numpy()]
            last = int(np.searchsorted(key, key[-1])) if len(key) else 0
            if last:
                yield told(key[:last], rep[:last], False)
                key, rep, first = key[last:], rep[last:], False
        yield told(key, rep, True)

    local = materialise(rows.mapInPandas(settled, "key long, rep long, head long, cut boolean"), "tiles")
    made.append(local)
    border = local.where("cut")
    ends = border.groupBy("key").agg(F.min("head").alias("head"), F.max("rep").alias("last")).where("head <> last").select("key", "head")
    return local.where(~F.col("cut")).select("key", "rep", "head").unionAll(border.select("key", "rep").join(ends, "key").select("key", "rep", "head"))


def differing_bits(a: Column, b: Column) -> Column:
    """Bits in which two bitmaps differ; the longer is folded to the length of the shorter."""

    def folded(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    xor = F.zip_with(folded(a, b), folded(b, a), lambda p, q: F.bit_count(p.bitwiseXOR(q)))
    return F.aggregate(xor, F.lit(0), lambda total, x: total + x)


def may_link(na: Column, nb: Column, a: Column, b: Column, num: int, den: int) -> Column:
    """Whether sizes and bitmaps leave room for a link.

    Differing bits are at most the differing elements, so the overlap is at most
    (na + nb - bits) / 2.
    """
    total = na + nb
    sizes = (F.least(na, nb) * den >= F.greatest(na, nb) * num)
    return sizes & ((total - differing_bits(a, b)) * (num + den) >= total * (2 * num))


def components(edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that each end of the ``edges(a, b)`` reaches.

    Every node hooks onto its smallest neighbour, chains are cut short by
    pointer jumping, edges move to the roots, until none is left.  All of it is
    joins and pre-aggregated minima over tables in the shared folder.
    """

    def neighbours(e: DataFrame) -> DataFrame:
        return e.select(F.col("a").alias("id"), F.col("b").alias("other")).unionAll(e.select("b", "a"))

    def follow(p: DataFrame, q: DataFrame) -> DataFrame:
        return p.join(q.select(F.col("id").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("id", F.coalesce("next", "comp").alias("comp"))

    result, made = None, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        made.append(materialise(df, name))
        return made[-1]

    while True:
        parent = kept(neighbours(edges).groupBy("id").agg(F.least("id", F.min("other")).alias("comp")), "parents")
        changed = True
        while changed:
            shorter = kept(follow(parent, parent), "parents")
            changed = not shorter.join(parent.withColumnRenamed("comp", "was"), "id").where("comp <> was").isEmpty()
            parent = shorter
        result = parent if result is None else kept(follow(result, parent), "components")
        moved = (
            edges.join(parent.select(F.col("id").alias("a"), F.col("comp").alias("ra")), "a")
            .join(parent.select(F.col("id").alias("b"), F.col("comp").alias("rb")), "b")
            .where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        )
        edges = kept(moved, "edges")
        if edges.isEmpty():
            for t in made:
                if t is not result:
                    drop_table(t)
            return result


def verify(pairs: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link, by exact intersection; ``texts`` has id and text.

    Members go to their head, ``SHARED`` of them to one place about; the head's text goes once
    to each place, where it comes first and its set is made once.
    """
    sized = pairs.join(pairs.groupBy("a").count(), "a").select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / SHARED)).alias("place"))
    own = texts.select(F.col("id").alias("b"), "text")
    members = sized.join(own, "b").select("a", "place", "b", "text")
    heads = sized.select("a", "place").distinct().join(own.withColumnRenamed("b", "a"), "a").select("a", "place", F.lit(None).cast("long").alias("b"), "text")

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, heads = None, []
        for frame in frames:
            found = []
            for a, place, b, text in zip(frame["a"], frame["place"], frame["b"], frame["text"]):
                if (a, place) != here:
                    here, heads = (a, place), []
                values = shingle_set(text, width)
                if b != b or b is None:  # a head; rows that share its id may have other texts
                    heads.append(values)
                elif any(link(h, values, num, den) for h in heads):
                    found.append((a, int(b)))
            yield pd.DataFrame(found, columns=["a", "b"])

    placed = heads.unionByName(members).repartition("a", "place").sortWithinPartitions("a", "place", F.col("b").asc_nulls_first())
    return placed.mapInPandas(linked, "a long, b long")


def rare_pairs(sets: DataFrame, texts: DataFrame, width: int, num: int, den: int, made: list[DataFrame]) -> DataFrame:
    """(a, b): pairs of ``sets(node, rep, h1, h2, comp, n, bitmap)`` in different components that share a rare shingle and may link.

    For tiles that many unlike sets share, say by a passage that stands in all of
    them.  Shingles are ordered by how many of the sets hold them, rarest first; sets
    that link share at least one of the first n - ceil(n * num / den) + 1 of either.
    An id may have several sets; each is a node, with its own first shingles.
    The tables that the pairs are read from are added to ``made``.
    """

    def shingles(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches(frames, 256):
            found = [shingle_set(t, width) for t in frame["text"]]
            h1, h2 = ([signed64(xxhash.xxh64_intdigest(f.tobytes(), k)) for f in found] for k in (1, 2))
            yield pd.DataFrame({"rep": frame["id"].to_numpy(), "h1": h1, "h2": h2, "shingles": [f.view(np.int64) for f in found]})

    rows = texts.join(sets.select(F.col("rep").alias("id")).distinct(), "id").select("id", "text")
    rows = rows.mapInPandas(shingles, "rep long, h1 long, h2 long, shingles array<long>")
    rows = rows.join(sets.select("node", "rep", "h1", "h2"), ["rep", "h1", "h2"]).dropDuplicates(["rep", "h1", "h2"])
    rows = materialise(rows.select("node", F.explode("shingles").alias("shingle")), "shingles")
    known = rows.join(rows.groupBy("shingle").agg(F.count("*").alias("holders")), "shingle")
    total, place = F.count("*").over(Window.partitionBy("node")), F.row_number().over(Window.partitionBy("node").orderBy("holders", "shingle"))
    first = known.withColumn("total", total).withColumn("place", place).where(F.col("place") <= F.col("total") - F.ceil(F.col("total") * num / den) + 1)
    first = materialise(first.select("shingle", "node"), "prefixes")
    crowded = materialise(first.groupBy("shingle").count().where(F.col("count") > BLOCK).select("shingle"), "crowded")
    made += [rows, first, crowded]
    pairs = pairs_within(first.join(crowded, "shingle", "left_anti").join(sets, "node"), "shingle", num, den)
    if crowded.isEmpty():
        return pairs
    return pairs.unionAll(pairs_by_blocks(first.join(crowded, "shingle", "left_semi").join(sets, "node"), "shingle", num, den, made))


def pairs_within(side: DataFrame, key: str, num: int, den: int) -> DataFrame:
    """(a, b): pairs of the rows of ``side(key, rep, comp, n, bitmap)`` that share a key, lie in different components and may link.

    For keys of few rows; see :func:`pairs_by_blocks`.
    """
    a = side.select(key, F.col("rep").alias("a"), F.col("comp").alias("ca"), F.col("n").alias("na"), F.col("bitmap").alias("ma"))
    b = side.select(key, F.col("rep").alias("b"), F.col("comp").alias("cb"), F.col("n").alias("nb"), F.col("bitmap").alias("mb"))
    room = may_link(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), num, den)
    return a.join(b, (a[key] == b[key]) & (F.col("ca") < F.col("cb")) & room).select("a", "b").distinct()


def pairs_by_blocks(side: DataFrame, key: str, num: int, den: int, made: list[DataFrame]) -> DataFrame:
    """As :func:`pairs_within`, for keys of many rows.

    The rows of a key are cut by size into bands, of which only equal and
    neighbouring ones can link, and a band into blocks of about ``BLOCK``; each pair of
    blocks is a join key of its own, so that no key's pairs are made in one task.
    The table of block counts is added to ``made``.
    """
    ratio = math.log(den / num) if num < den else 1.0
    rows = side.select(key, "rep", "comp", "n", "bitmap", F.floor(F.log(F.col("n").cast("double")) / ratio + 1e-9).alias("band"))
    sizes = materialise(rows.groupBy(key, "band").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "blocks")
    made.append(sizes)

    def beside(mark: str, other: str, steps: tuple[int, int]) -> DataFrame:
        """Rows under the numbers of their own band and block, once for each block of the bands ``steps`` away."""
        own = rows.join(sizes, [key, "band"]).select(
            key, F.col("rep").alias(mark), F.col("comp").alias(f"c{mark}"), F.col("n").alias(f"n{mark}"), F.col("bitmap").alias(f"m{mark}"),
            F.col("band").alias(f"band_{mark}"), F.pmod(F.xxhash64("rep"), F.col("blocks")).alias(f"block_{mark}"),
            F.explode(F.array(*[F.col("band") + F.lit(s) for s in steps])).alias(f"band_{other}"))
        there = sizes.select(key, F.col("band").alias(f"band_{other}"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias(f"block_{other}"))
        return own.join(there, [key, f"band_{other}"])

    met = beside("a", "b", (0, 1)).join(beside("b", "a", (0, -1)), [key, "band_a", "block_a", "band_b", "block_b"])
    # within a band both orders meet, across bands one does
    once = (F.col("ca") < F.col("cb")) | ((F.col("band_a") < F.col("band_b")) & (F.col("ca") > F.col("cb")))
    return met.where(once & may_link(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), num, den)).select("a", "b").distinct()


def same_id(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes that belong together as rows with one id have both sets; most tables have none."""
    rows = members.where("n > 0 and doc_id is not null").select("doc_id", "h1", "h2")
    several = rows.groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("lo"), F.max(F.struct("h1", "h2")).alias("hi")).where("lo <> hi").select("doc_id")
    reps = rows.join(several, "doc_id").join(nodes.select("h1", "h2", "rep"), ["h1", "h2"]).select("doc_id", F.col("rep").alias("b")).distinct()
    return reps.join(reps.groupBy("doc_id").agg(F.min("b").alias("a")), "doc_id").where("a < b").select("a", "b").distinct()


def jaccard_components(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Components of the documents whose shingle sets have Jaccard similarity >= num / den.

    ``docs`` needs doc_id (whole numbers) and text.  Returns one row a document:
    doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Equal sets become one node.  Nodes meet in tiles (see :func:`tiles_of`), and
    only nodes of one tile are ever compared: sizes first, then bitmaps, then the
    sorted arrays.  As components are asked for, a tile is done once its nodes
    are in one component: the first rounds compare each node with the one node,
    heading a tile, that shares most tiles with it; then all pairs of tiles
    that still lie in different components are compared, those of tiles of more than
    ``FULL`` nodes only where they share a rare shingle, as nodes that link do
    (:func:`rare_pairs`).  No pair of nodes that links can be missed, and no
    group of copies, nor of texts with a passage in common, is expanded into its pairs.

    Null, empty and blank texts have 0 shingles and stay alone; fewer words than
    ``width`` make one shingle; rows that share an id count as one document; a
    null id is linked with nothing and has a null component; an empty table
    gives no rows.
    """
    members = materialise(signatures(docs, width), "members")
    nodes = members.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bitmap").alias("bitmap"))
    done: list[DataFrame] = []
    tiles = shared_tiles(set_tiles(docs, width, num, den), done)
    same = materialise(same_id(members, nodes), "same-id")
    done.append(same)
    met = tiles.select(F.col("rep").alias("id")).unionAll(same.select("a")).unionAll(same.select("b")).distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(met, "id")
    # An id that repeated rows share may have several texts; each of them is compared.
    texts = texts.where("text is not null").withColumn("hash", F.xxhash64("text", F.reverse("text")))
    texts = materialise(texts.dropDuplicates(["id", "hash"]).drop("hash"), "texts")
    marks = materialise(nodes.select(F.col("rep").alias("id"), "h1", "h2", "n", "bitmap").join(met, "id"), "marks")
    links, comp = None, met.select("id", F.col("id").alias("comp"))
    done += [texts, marks]

    def joined_up(links: DataFrame) -> DataFrame:
        joined = components(links)
        comp = materialise(met.join(joined, "id", "left").select("id", F.coalesce("comp", "id").alias("comp")), "comp")
        done.extend([joined, comp])
        return comp

    if not same.isEmpty():
        links, comp = same, joined_up(same)
    for turn in range(STAR_ROUNDS + 1):
        labelled = tiles.join(comp.withColumnRenamed("id", "rep"), "rep")
        if turn:
            open_tiles = labelled.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
            # Heads change from round to round: the node whose id hashes smallest.
            heads = labelled.groupBy("key").agg(F.min_by(F.struct("rep", "comp"), F.xxhash64(F.lit(turn), "rep")).alias("h"))
            labelled = materialise(labelled.join(open_tiles.join(heads, "key"), "key").select("key", "rep", "comp", F.col("h.rep").alias("head"), F.col("h.comp").alias("head_comp")), "open")
            done.append(labelled)
            if labelled.isEmpty():
                break
        if turn < STAR_ROUNDS:
            shared = labelled.where("rep <> head" if not turn else "comp <> head_comp").groupBy("rep", "head").count()
            pairs = shared.groupBy("rep").agg(F.max_by("head", F.struct("count", -F.col("head"))).alias("a")).select("a", F.col("rep").alias("b"))
            pairs = pairs.join(marks.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("bitmap").alias("ma")), "a")
            pairs = pairs.join(marks.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("bitmap").alias("mb")), "b")
            pairs = pairs.where(may_link(F.col("na"), F.col("nb"), F.col("ma"), F.col("mb"), num, den)).select("a", "b")
        else:
            side = labelled.select("key", "rep", "comp").join(marks.withColumnRenamed("id", "rep"), "rep")
            large = materialise(labelled.groupBy("key").count().where(F.col("count") > FULL).select("key"), "large")
            pairs = pairs_within(side.join(large, "key", "left_anti"), "key", num, den)
            done.append(large)
            if not large.isEmpty():
                crowd = side.join(large, "key", "left_semi").select("rep", "h1", "h2", "comp", "n", "bitmap").dropDuplicates(["rep", "h1", "h2"])
                crowd = materialise(crowd.withColumn("node", F.monotonically_increasing_id()), "crowd")
                done.append(crowd)
                pairs = pairs.unionAll(rare_pairs(crowd, texts, width, num, den, done)).distinct()
        pairs = materialise(pairs, "pairs")  # named three times by what verifies them
        new = materialise(verify(pairs, texts, width, num, den), "links")
        done += [pairs, new]
        if new.isEmpty():
            continue
        links = new if links is None else links.unionAll(new)
        comp = joined_up(links)
    of_set = nodes.select("h1", "h2", "rep").join(comp.withColumnRenamed("id", "rep"), "rep", "left").select("h1", "h2", F.coalesce("comp", "rep").alias("comp"))
    # Alone: no words, or no id.  A set that many documents have is one row on the other side.
    of_set = materialise(of_set, "of-set")
    for t in done:  # the result needs only the members and their sets
        drop_table(t)
    return members.join(of_set, ["h1", "h2"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("comp"))).otherwise(F.col("doc_id")).alias("component_id"),
    )
