"""String functions: ids, keys, paths and ordered clean-up of free text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foldmill.functions.vectors import bound

#: Case-insensitive, Unicode-aware, with "." and "$" at plain line feeds only.
FLAGS = "(?iuUd)"


def strip(text: Column) -> Column:
    """Without white space of any kind at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def collapse(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return strip(F.regexp_replace(text, r"(?U)\s+", " "))


def first_token(text: Column) -> Column:
    """What stands before the first white space: directory "P1 left" is patient "P1"."""
    return F.element_at(F.split(strip(text), r"(?U)\s+"), 1)


def key_part(key: Column, n: int, sep: str = "__") -> Column:
    """The n-th part (from 0) of a composite key; null past the last."""
    return F.get(F.split(key, sep), F.lit(n))


def composite_key(*parts: Column, sep: str = "__") -> Column:
    """Parts joined by ``sep``; null if any part is null, unlike ``concat_ws``."""
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws(sep, *[p.cast("string") for p in parts]))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent(path: Column, levels: int = 1) -> Column:
    """Name of the folder ``levels`` above a file."""
    return F.element_at(F.split(path, "/"), -1 - levels)


def before_folder(path: Column, folder: str) -> Column:
    """Everything before the last "/folder" of each row's own path; null where there is none."""
    found = F.regexp_extract(path, rf"^(.*)/{folder}(?:/|$)", 1)
    return F.when(path.rlike(rf"/{folder}(?:/|$)"), found)


def rebase(path: Column, old: Column, new: Column) -> Column:
    """``path`` with every plain occurrence of ``old`` as ``new``."""
    return F.replace(path, old, new)


def join_fields(*fields: Column, sep: str = "\n") -> Column:
    """Fields that aren't null or empty, joined and stripped; the empty string if none is left."""
    kept = F.filter(F.array(*[F.coalesce(f, F.lit("")) for f in fields]), lambda x: x != "")
    return strip(F.array_join(kept, sep))


#: Letters that are only themselves, in either case, for what a rule needs; anything else ends a literal.
LITERAL = frozenset("abcdefghijklmnopqrstuvwxyz0123456789 áéíóúàèìòùäëïöüâêîôûñç")
#: Rules that are run or left out together.
TOGETHER = 8
#: Characters that a rule without regard to case takes for an i or an s though lower-casing doesn't.
FOLDED = ("İıſ", "iis")


def required_literal(rule: str) -> str | None:
    """The longest run of plain characters, in lower case, that stands in every match of a rule; null if none is sure.

    Only what stands outside groups and classes and isn't optional counts; a rule
    of alternatives has none.
    """
    runs, run, at = [], "", 0

    def beyond_class(i: int) -> int:
        """The place after a class whose bracket has been read; a closing one may come first in it."""
        i += rule[i : i + 1] == "^"
        i += 1
        while i < len(rule) and rule[i] != "]":
            i += 2 if rule[i] == "\\" else 1
        return i + 1

    def end() -> None:
        nonlocal run
        runs.append(run)
        run = ""

    while at < len(rule):
        c, plain = rule[at], ""
        at += 1
        if c == "|":
            return None
        if c == "\\":
            plain, at = (rule[at : at + 1] if not rule[at : at + 1].isalnum() else ""), at + 1
        elif c == "[":
            at = beyond_class(at)
        elif c == "(":
            depth = 1
            while at < len(rule) and depth:
                here = rule[at]
                depth += (here == "(") - (here == ")")
                at = at + 2 if here == "\\" else beyond_class(at + 1) if here == "[" else at + 1
        elif c not in ".^$*+?{":
            plain = c
        if c in "*+?{":
            end()
            if c == "{":
                at = rule.index("}", at) + 1
            continue
        after = rule[at : at + 1]
        if plain.lower() not in LITERAL or not plain or after in ("*", "?", "{"):
            end()
        else:
            run += plain.lower()
            if after == "+":
                end()
    end()
    longest = max(runs, key=len)
    return longest if len(longest) > 1 else None


def strip_terms(text: Column, rules: Sequence[str], flags: str = FLAGS) -> Column:
    """Delete the matches of each rule in turn, then collapse white space.

    Order matters: what one rule leaves is what the next one sees, so the rules
    can't be one alternation.  Rules each with a literal that stands in all its matches are only run, a group at a time, on texts
    that hold one of them; the text is put in lower case for that once, and again after each group that ran.  Null is the empty string.
    """

    def folded(t: Column) -> Column:
        return F.lower(F.translate(t, *FOLDED))

    def told(t: Column) -> Column:
        return bound(t, lambda x: F.struct(x.alias("text"), folded(x).alias("low")))

    def step(state: Column, some: Sequence[str]) -> Column:
        needed = [required_literal(rule) if flags == FLAGS else None for rule in some]
        run = lambda s: told(reduce(lambda t, rule: F.regexp_replace(t, flags + rule, ""), some, s["text"]))
        if None in needed:
            return bound(state, run)
        # if no rule of the group can match first, none can at all
        return bound(state, lambda s: F.when(reduce(lambda x, y: x | y, [F.contains(s["low"], F.lit(n)) for n in dict.fromkeys(needed)]), run(s)).otherwise(s))

    groups: list[list[str]] = []
    for rule in rules:
        if not groups or len(groups[-1]) == TOGETHER or (required_literal(rule) is None) != (required_literal(groups[-1][-1]) is None):
            groups.append([])
        groups[-1].append(rule)
    return collapse(reduce(step, groups, told(F.coalesce(text, F.lit(""))))["text"])


def missing_as_null(text: Column) -> Column:
    """Null for the marks of a missing value in CSV files: NaN, NA, nan and nothing."""
    return F.when(~strip(text).isin("", "NaN", "nan", "NA", "N/A", "null", "None"), text)


def whole_number(text: Column) -> Column:
    """An integer from text, null if it isn't one; "2.0" counts as 2."""
    return text.try_cast("double").try_cast("int")


def identifier(value: Column) -> Column:
    """An id as stripped text; ids read as floats lose their ".0"."""
    return F.regexp_replace(strip(value.cast("string")), r"^(\d+)\.0$", "$1")


def percentage(share: Column, digits: int = 1) -> Column:
    return F.concat(F.format_number(share * 100, digits), F.lit("%"))
