"""License scans: exact phrases, and short notices with a few edits."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import regex
from pyspark.sql import DataFrame

from foldmill.llm.common import map_texts

#: Base phrases: their words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Short notices, lower case, searched with bounded edits.
NOTICES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
    ("licensed under the apache license, version 2.0", "apache"),
    ("licensed under the gnu general public license", "gpl"),
    ("under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by-nc 4.0", "cc-by-nc"),
    ("licensed under cc by-sa 4.0", "cc-by-sa"),
    ("creative commons attribution", "cc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "all-rights-reserved"),
)
#: One edit for so many characters of a notice.
CHARS_PER_EDIT = 10
#: Windows of one notice in a text that go straight to the regular expression, and that have their distances taken at once.
FEW, AT_ONCE = 4, 4096

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Every byte that isn't part of a word becomes a space.
SPACED = bytes(b if b >= 0x80 or chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" else 0x20 for b in range(256))

SCHEMA = (
    "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
    "score double, spans array<struct<label:string,start:int,stop:int,edits:int>>"
)


def seeds(notice: str, edits: int) -> list[tuple[int, str]]:
    """``edits + 1`` pieces of a notice and where they begin: with at most ``edits`` edits one stays whole."""
    n, parts = len(notice), edits + 1
    cuts = [i * n // parts for i in range(parts + 1)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:])]


@lru_cache(maxsize=4)
def _search(notices: tuple[tuple[str, str], ...], per_edit: int):
    """The automaton of all seeds and, for each notice, its compiled bounded-error pattern."""
    machine, compiled, owners = ahocorasick.Automaton(), [], {}
    for k, (notice, label) in enumerate(notices):
        edits = len(notice) // per_edit
        # BESTMATCH: the fewest edits; the bound counts insertions, deletions and substitutions together
        compiled.append((regex.compile(rf"(?b)(?:{regex.escape(notice)}){{e<={edits}}}"), len(notice), edits, label))
        for at, piece in seeds(notice, edits):
            owners.setdefault(piece, []).append((k, at))
    for piece, who in owners.items():
        machine.add_word(piece, (len(piece), who))
    machine.make_automaton()
    return machine, compiled


def within(codes: np.ndarray, places: list[tuple[int, int]], notice: str, edits: int) -> np.ndarray:
    """Whether each window (start, stop) of a text, given as code points, holds the notice with ``edits`` edits at most.

    The table of edit distances, a row for each sign of the notice, for many
    windows at once; what can't match never reaches the regular expression.
    """
    out, width = [], max(b - a for a, b in places)
    steps = np.arange(width + 1, dtype=np.int16)
    for at in range(0, len(places), AT_ONCE):
        part = np.array(places[at : at + AT_ONCE])
        index = part[:, :1] + np.arange(width)
        signs = np.where(index < part[:, 1:], codes[np.minimum(index, len(codes) - 1)], 0)
        before = np.zeros((len(part), width + 1), np.int16)  # the notice may begin anywhere
        for k, sign in enumerate(notice, 1):
            row = np.full_like(before, k)
            np.minimum(before[:, :-1] + (signs != ord(sign)), before[:, 1:] + 1, out=row[:, 1:])
            before = np.minimum.accumulate(row - steps, axis=1) + steps
        out.append(before.min(1) <= edits)
    return np.concatenate(out)


def fuzzy_spans(low: str, notices: Sequence[tuple[str, str]] = NOTICES, per_edit: int = CHARS_PER_EDIT) -> list[tuple[str, int, int, int]]:
    """(label, start, stop, edits) of the notices found in a lower-cased text.

    A seed found at a place says where its notice would begin, give or take the
    edits; only such windows are matched, each by itself, so a text costs the
    same for each seed however many stand in it.  Where there are more than a
    few windows, edit distances taken for all of them at once (:func:`within`)
    leave the regular expression those that match.  A window is too short for
    two matches; matches of one notice don't overlap.
    """
    machine, compiled = _search(tuple(notices), per_edit)
    windows: dict[int, set[tuple[int, int]]] = {}
    for end, (length, who) in machine.iter(low):
        for k, at in who:
            _, size, edits, _ = compiled[k]
            start = end - length + 1 - at
            windows.setdefault(k, set()).add((max(0, start - edits), min(start + size + edits, len(low))))
    found, codes = [], None
    for k, places in windows.items():
        pattern, size, edits, label = compiled[k]
        done, known, ordered = 0, {}, sorted(places)
        if len(ordered) > FEW:
            codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32) if codes is None else codes
            ordered = [p for p, near in zip(ordered, within(codes, ordered, notices[k][0], edits)) if near]
        for a, b in ordered:
            a = max(a, done)
            if b - a < size - edits:
                continue
            window = low[a:b]
            if window not in known:  # a notice that a text repeats is matched once
                m = pattern.search(window)
                known[window] = (m.start(), m.end(), sum(m.fuzzy_counts)) if m else None
            if known[window]:
                start, stop, e = known[window]
                found.append((label, a + start, a + stop, e))
                done = a + stop
    # Of notices that overlap the one with the fewest edits stands, then the longest, then the first label.
    kept: list[tuple[int, int, str, int]] = []  # by start; none overlaps another
    for label, a, b, e in sorted(set(found), key=lambda x: (x[3], x[1] - x[2], x[0], x[1])):
        i = bisect_left(kept, (a,))
        if (i == 0 or kept[i - 1][1] <= a) and (i == len(kept) or b <= kept[i][0]):
            kept.insert(i, (a, b, label, e))
    return [(label, a, b, e) for a, b, label, e in kept]


def scan_text(text: str | None, phrases: Sequence[tuple[str, str]] = PHRASES, notices: Sequence[tuple[str, str]] = NOTICES, per_edit: int = CHARS_PER_EDIT) -> tuple:
    """Everything :func:`scan_licenses` returns for one text, but for its id."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    n_words = len(raw.translate(SPACED).split())
    low = raw.decode("utf-8", "surrogatepass")
    places, base, spans = [], set(), []
    if any(p.split(" ")[-1] in low for p, _ in phrases):
        words = [(m.group(), m.start(), m.end()) for m in WORD.finditer(low)]
        where: dict[str, list[int]] = {}
        for i, (w, _, _) in enumerate(words):
            where.setdefault(w, []).append(i)
        for phrase, label in phrases:
            parts = phrase.split(" ")
            for i in where.get(parts[0], ()):
                if [w for w, _, _ in words[i : i + len(parts)]] == parts:
                    places.append(i)
                    base.add(label)
                    spans.append((label, words[i][1], words[i + len(parts) - 1][2], 0))
    near = fuzzy_spans(low, notices, per_edit)
    sizes = {label: max(len(n) for n, x in notices if x == label) for _, label in notices}
    score = max([1.0] * bool(places) + [1.0 - e / sizes[label] for label, _, _, e in near], default=0.0)
    everything = sorted(set(spans + near), key=lambda x: (x[1], x[2], x[0]))
    return (
        n_words, len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)),
        ",".join(sorted(base | {x[0] for x in near})), score,
        [{"label": l, "start": a, "stop": b, "edits": e} for l, a, b, e in everything],
    )


def scan_licenses(
    docs: DataFrame,
    phrases: Sequence[tuple[str, str]] = PHRASES,
    notices: Sequence[tuple[str, str]] = NOTICES,
    per_edit: int = CHARS_PER_EDIT,
) -> DataFrame:
    """Exact license phrases and fuzzy short notices of every whole text.

    ``docs`` needs doc_id and text.  Returns one row a document: doc_id, n_words,
    n_base, first_word, last_word (places of the base phrases, in words),
    base_labels, labels (with the notices'), score, and spans (label, start,
    stop in code points, edits).  The score is 1 where a base phrase stands,
    else 1 - edits / notice length of the best notice, else 0.

    Null and empty texts have no words, labels "" and score 0; repeated rows
    give repeated results; equal phrases at one place count once for each
    phrase; an empty table gives no rows.
    """
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
    phrases, notices = tuple(phrases), tuple(notices)

    def scan(texts: list[str | None]) -> dict[str, list]:
        rows = [scan_text(t, phrases, notices, per_edit) for t in texts]
        return {c: [r[k] for r in rows] for k, c in enumerate(columns)}

    return map_texts(docs, SCHEMA, lambda: scan)
