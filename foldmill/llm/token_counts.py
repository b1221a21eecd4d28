"""Token counts by rank-synchronous merging of ragged arrays."""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import map_texts

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
#: Words that one worker keeps counted; then it starts anew.
KEPT_WORDS = 800_000
#: Longer pre-tokens are cut further, where no piece can join them.
LONG = 32
#: What is still longer then is merged by a queue of its pairs: rounds over all of it would cost the square of its length.
QUEUED = 512
NONE = np.int32(2**31 - 1)


class PieceMerger:
    """Counts byte-fallback BPE pieces of a sentencepiece model, many pre-tokens at once."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        size = sp.vocab_size()
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        score = {sp.id_to_piece(i): sp.get_score(i) for i in normal}
        self.names = list(score)
        self.ids = {p: k for k, p in enumerate(self.names)}
        # Equal scores share a rank; among them the leftmost pair goes first.
        levels = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        self.rank = np.array([levels[score[p]] for p in self.names], np.int32)
        left, right, made = [], [], []
        worst = np.full(len(self.names), NONE, np.int32)  # the best rank of what a piece can grow into at once
        for p, k in self.ids.items():
            for cut in range(1, len(p)):
                a, b = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(k)
                    worst[a], worst[b] = min(worst[a], self.rank[k]), min(worst[b], self.rank[k])
        #: Pieces of which every occurrence can be merged at once: whatever they grow into ranks later.
        self.at_once = worst > self.rank
        key = np.array(left, np.int64) * len(self.names) + np.array(right, np.int64)
        order = np.argsort(key)
        self.pair_key = np.append(key[order], np.int64(2**62))
        self.pair_made = np.append(np.array(made, np.int64)[order], 0)
        points = {ord(p): k for p, k in self.ids.items() if len(p) == 1}
        self.of_point = np.full(0x110000, -1, np.int32)
        self.of_point[list(points)] = list(points.values())
        self.byte_len = np.ones(0x110000, np.int8)
        for start, n in ((0x80, 2), (0x800, 3), (0x10000, 4)):
            self.byte_len[start:] = n
        grown = "".join(p for p in self.names if len(p) > 1)
        #: Line ends are never part of a longer piece, so lines are counted apart.
        self.lines_apart = "\n" not in grown
        self.words_apart = not any(SPACE in p.lstrip(SPACE) for p in self.names)
        #: Neighbouring characters inside pieces; between any two others no merge ever reaches.
        self.inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in self.names for a, b in zip(p, p[1:])] + [2**62], np.int64))
        self.kept: dict[str, int] = {}
        self.ranks, self.made_of = self.rank.tolist(), {}  # for count_long, filled when it is first asked for
        # Where pieces of spaces alone come last and tie, a run fills up from the left with the longest of them.
        spaces = [len(p) for p in self.names if len(p) > 1 and p == SPACE * len(p)]
        top = max(spaces, default=0)
        last = all(self.rank[self.ids[SPACE * n]] == self.rank.max() for n in spaces)
        pure = all(p == SPACE * len(p) and len(p) <= top for p in self.names if p.startswith(SPACE * 2))
        self.full_run = top if top and last and pure and self.count([SPACE * top])[0] == 1 else 0

    def made_by(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece each pair merges into, -1 for none; unknown characters (-1) never merge."""
        key = a.astype(np.int64) * len(self.names) + b
        at = np.searchsorted(self.pair_key, key)
        return np.where((self.pair_key[at] == key) & (a >= 0) & (b >= 0), self.pair_made[at], -1).astype(np.int32)

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token; ``words`` are escaped and not empty.

        All pre-tokens lie end to end in one array of piece ids.  In each round
        every pre-token finds the best rank among its neighbouring pairs and
        applies it: at all its places where that can't matter for what follows,
        else at the leftmost one.  Pre-tokens without a pair leave the arrays.
        """
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        total = np.zeros(len(words), np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        piece = self.of_point[points]
        # Characters outside the vocabulary stand for their bytes.
        np.add.at(total, owner, np.where(piece < 0, self.byte_len[points], 1))
        while len(piece) > 1:
            made = np.full(len(piece), -1, np.int32)
            made[:-1] = np.where(owner[1:] == owner[:-1], self.made_by(piece[:-1], piece[1:]), -1)
            rank = np.where(made >= 0, self.rank[made], NONE)
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(owner)])
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < NONE, sizes)
            if not live.any():
                break
            hit = live & (rank == np.repeat(best, sizes))
            # Leftmost hit of each pre-token
            place = np.flatnonzero(hit)
            first = np.zeros(len(piece), bool)
            first[place[np.r_[True, owner[place][1:] != owner[place][:-1]]]] = True
            hit &= first | self.at_once[made]
            # A piece that may only be merged leftmost hides the other hits of its pre-token
            place = np.flatnonzero(hit)
            lead = place[np.maximum.accumulate(np.where(first[place], np.arange(len(place)), 0))]
            hit[place[~(first[place] | self.at_once[made[lead]])]] = False
            # Of hits that overlap in a row every other one counts, from the left
            place = np.flatnonzero(hit)
            run = np.r_[True, np.diff(place) != 1]
            head = place[np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))]
            place = place[(place - head) % 2 == 0]
            piece = piece.copy()
            piece[place] = made[place]
            keep = live
            keep[place + 1] = False
            total -= np.bincount(owner[place], minlength=len(total))
            piece, owner = piece[keep], owner[keep]
        return total

    def count_long(self, word: str) -> int:
        """Tokens of one long pre-token, by the same order of merges: best rank first, of equal ones the leftmost.

        A queue holds each pair that can be merged; pairs that have changed since are passed over.
        """
        if not self.made_of:
            self.made_of.update(zip(self.pair_key[:-1].tolist(), self.pair_made[:-1].tolist()))
        made_of, rank, size, n = self.made_of, self.ranks, len(self.names), len(word)
        points = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        at = self.of_point[points]
        total = int(np.where(at < 0, self.byte_len[points], 1).sum())
        made = self.made_by(at[:-1], at[1:])
        first = np.flatnonzero(made >= 0)
        queue = (self.rank[made[first]].astype(np.int64) * n + first).tolist()
        heapq.heapify(queue)
        wanted = np.where(made >= 0, self.rank[made], -1).tolist() + [-1]  # rank of the pair that begins at a place
        piece, after, before = at.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            r, i = divmod(heapq.heappop(queue), n)
            if wanted[i] != r:
                continue
            j = after[i]
            new = piece[i] = made_of[piece[i] * size + piece[j]]
            total -= 1
            wanted[j], wanted[i], k, p = -1, -1, after[j], before[i]
            after[i] = k
            if k < n:
                before[k] = i
                other = piece[k]
                grown = made_of.get(new * size + other, -1) if other >= 0 else -1
                if grown >= 0:
                    wanted[i] = rank[grown]
                    heapq.heappush(queue, wanted[i] * n + i)
            if p >= 0:
                other = piece[p]
                grown = made_of.get(other * size + new, -1) if other >= 0 else -1
                wanted[p] = rank[grown] if grown >= 0 else -1
                if grown >= 0:
                    heapq.heappush(queue, wanted[p] * n + p)
        return total

    def texts(self, texts: list[str]) -> list[int]:
        """Tokens of each whole text."""
        split = [self.segments(t) for t in texts]
        fresh = list({w for words in split for w in words if w not in self.kept})
        if len(self.kept) + len(fresh) > KEPT_WORDS:
            self.kept.clear()
            fresh = list({w for words in split for w in words})
        self.kept.update((w, self.count_long(w)) for w in fresh if len(w) > QUEUED)
        short = [w for w in fresh if len(w) <= QUEUED]
        for start in range(0, len(short), 50_000):
            part = short[start : start + 50_000]
            self.kept.update(zip(part, self.count(part).tolist()))
        get = self.kept.__getitem__
        totals = [sum(map(get, words)) for words in split]
        for w in fresh:  # what is kept stays small: LONG characters a word
            if len(w) > LONG:
                del self.kept[w]
        return totals

    def segments(self, text: str) -> list[str]:
        """Pre-tokens that no piece crosses; long ones are cut after full runs and between characters that stand together in no piece."""
        words = self.words(text)
        if max(map(len, words), default=0) <= LONG:
            return words
        out: list[str] = []
        for w in words:
            if len(w) <= LONG:
                out.append(w)
                continue
            if self.full_run and w.startswith(SPACE * 2):
                full = (len(w) - len(w.lstrip(SPACE)) - 1) // self.full_run
                out += [SPACE * self.full_run] * full
                w = w[full * self.full_run :]
            points = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            pair = points[:-1] << 21 | points[1:]
            cuts = np.flatnonzero(self.inside[np.searchsorted(self.inside, pair)] != pair) + 1
            out += [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)])]
        return out

    def words(self, text: str) -> list[str]:
        """The text, escaped, cut before words and at line ends."""
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.words_apart:
            return [text]
        if not self.lines_apart:
            return SEGMENT.findall(text)
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            if SPACE + SPACE in line:
                out += SEGMENT.findall(line)
            elif line:
                head, *rest = line.split(SPACE)
                out += [head] * bool(head)
                out += [SPACE + w for w in rest]
        return out


@lru_cache(maxsize=2)
def merger(model_file: str) -> PieceMerger:
    return PieceMerger(model_file)


def count_tokens(docs: DataFrame, model_file: str, limit: int = 4096) -> DataFrame:
    """Tokens of every whole text, as the sentencepiece model at ``model_file`` gives them.

    ``docs`` needs doc_id and text.  Returns doc_id, n_bytes, n_tokens and
    over_limit (n_tokens > ``limit``).  No begin or end token is counted, and
    strings like "<s>" in a text are ordinary text.

    A null text counts as empty: 0 bytes, 0 tokens.  Repeated rows give repeated
    results; an empty table gives no rows.  The vocabulary file is read on each
    worker from a path that all have.
    """
    def start():
        counter = merger(model_file)
        return lambda texts: {"n_tokens": counter.texts([t or "" for t in texts])}

    sized = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    counted = map_texts(sized, "n_tokens long", start, keep=("doc_id", "n_bytes"), most=256)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
