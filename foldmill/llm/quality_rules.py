"""Quality classifier: a sparse ensemble of rules over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldmill.llm.common import unused

#: Labelled rows the rules are fitted on, at most: those whose ids hash smallest.
FIT_ROWS = 20_000
#: Trees, their depth, the candidate cuts of a statistic, and the fewest rows of a leaf.
TREES, DEPTH, CUTS, LEAF = 24, 3, 24, 20
#: Weight of the lasso penalty, per row, and rounds of the fit.
PENALTY, ROUNDS = 5e-4, 600
#: Documents of a score of this or more are predicted good.
CUT_OFF = 0.3


#: What is counted in a text, each in one pass of a pattern.
COUNTED = {
    "words": r"[^\x20\x09-\x0D]+",
    "symbols": r"[#$%&*|<>{}\[\]~^_=+\\/@`]",
    "bars": r"\|",
    "exclamations": r"[!?]",
    "digits": r"[0-9]",
    "sentence_ends": r"\.",
    "commas": r"[,;:]",
    "line_ends": r"\n",
    "capitals": r"\p{Lu}",
    "repeats": r"(?<![^\s])(\S+)(?= \1(?:\s|$))",
    "marked_words": r"[#$%&*]{2,}|!{2,}",
}


def counts(text: Column) -> dict[str, Column]:
    """Counts of a whole text; they stay in the JVM and need no array of the words."""
    return {"chars": F.char_length(text)} | {name: F.regexp_count(text, F.lit(p)) for name, p in COUNTED.items()}


def statistics(of: dict[str, Column]) -> dict[str, Column]:
    """Statistics from the counts: the number of words, and shares of the words or characters, 0 where there are none."""

    def share(x: Column, n: Column) -> Column:
        return F.coalesce(F.try_divide(x.cast("double"), n.cast("double")), F.lit(0.0))

    by_word = {"repeats", "marked_words"}
    out = {"words": of["words"].cast("double"), "word_length": share(of["chars"], of["words"])}
    return out | {n: share(of[n], of["words" if n in by_word else "chars"]) for n in COUNTED if n != "words"}


@dataclass(frozen=True)
class RuleModel:
    """``rules``: conjunctions of (statistic, "<=" or ">", value), each with a weight."""

    rules: tuple[tuple[tuple[tuple[str, str, float], ...], float], ...]
    intercept: float

    def score(self, of: dict[str, Column]) -> Column:
        """The model as one column over the columns of its statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            met = F.lit(True)
            for name, side, value in rule:
                met = met & ((of[name] <= value) if side == "<=" else (of[name] > value))
            total = total + F.when(met, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


def tree_rules(x: np.ndarray, residual: np.ndarray, names: list[str], cuts: list[np.ndarray], depth: int) -> list[tuple]:
    """Paths (inner ones too) of a least-squares tree, greedily grown on ranked cuts."""
    out: list[tuple] = []

    def split(rows: np.ndarray, path: tuple) -> None:
        if path:
            out.append(path)
        if len(path) == depth or len(rows) < 2 * LEAF:
            return
        y, best = residual[rows], (1e-9, None)
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            bin_of = np.searchsorted(cuts[f], x[rows, f], side="left")
            n = np.bincount(bin_of, minlength=len(cuts[f]) + 1).cumsum()[:-1]
            s = np.bincount(bin_of, y, len(cuts[f]) + 1).cumsum()[:-1]
            ok = (n >= LEAF) & (len(rows) - n >= LEAF)
            gain = np.where(ok, s**2 / np.maximum(n, 1) + (y.sum() - s) ** 2 / np.maximum(len(rows) - n, 1), -1) - y.sum() ** 2 / len(rows)
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], (f, float(cuts[f][k])))
        if best[1] is None:
            return
        f, value = best[1]
        left = x[rows, f] <= value
        split(rows[left], (*path, (names[f], "<=", value)))
        split(rows[~left], (*path, (names[f], ">", value)))

    split(np.arange(len(x)), ())
    return out


def leaf_values(met: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """For each row the mean residual of the smallest rule it meets."""
    size = np.where(met, met.sum(0), len(met) + 1)
    at = size.argmin(1)
    mean = (met * residual[:, None]).sum(0) / np.maximum(met.sum(0), 1)
    return np.where(met.any(1), mean[at], 0.0)


def holds(rule: tuple, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, side, value in rule:
        column = x[:, names.index(name)]
        out &= column <= value if side == "<=" else column > value
    return out


def fit_rules(x: np.ndarray, y: np.ndarray, names: list[str]) -> RuleModel:
    """Boosted trees give candidate rules; lasso logistic regression keeps few of them."""
    if not len(y) or y.min() == y.max():
        prior = 0.0 if not len(y) else (4.0 if y[0] else -4.0)
        return RuleModel((), prior)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])) for f in range(x.shape[1])]
    # quantiles of the rarer class find cuts that few rows lie beyond
    rare = x[y == (0 if y.mean() > 0.5 else 1)]
    cuts = [np.unique(np.r_[c, np.quantile(rare[:, f], np.linspace(0, 1, CUTS + 2)[1:-1])]) for f, c in enumerate(cuts)]
    margin, found = np.full(len(y), np.log(y.mean() / (1 - y.mean()))), {}
    for t in range(TREES):
        # each tree sees all but a few of the statistics, in turn
        usable = [c if (f + t) % 4 else c[:0] for f, c in enumerate(cuts)]
        residual = y - 1 / (1 + np.exp(-margin))
        rules = tree_rules(x, residual, names, usable, DEPTH)
        if not rules:
            continue
        met = np.stack([holds(r, x, names) for r in rules], 1)
        margin = margin + 2.0 * leaf_values(met, residual)
        for k, r in enumerate(rules):
            found.setdefault(met[:, k].tobytes(), (r, met[:, k]))  # rules that hold for the same rows are one
    rules = [r for r, _ in found.values()]
    z = np.stack([m for _, m in found.values()], 1).astype(np.float64)
    # Accelerated proximal gradient; the penalty leaves the intercept alone.
    w, b, step = np.zeros(z.shape[1]), float(np.log(y.mean() / (1 - y.mean()))), 4.0 / (1 + np.linalg.norm(z, 2) ** 2 / len(y))
    vw, vb, t = w, b, 1.0
    for _ in range(ROUNDS):
        g = 1 / (1 + np.exp(-(z @ vw + vb))) - y
        nw = vw - step * (z.T @ g) / len(y)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb, nt = vb - step * g.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return RuleModel(tuple((r, float(round(v, 6))) for r, v in zip(rules, w) if abs(v) >= 1e-6), float(round(b, 6)))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", fit_rows: int = FIT_ROWS) -> RuleModel:
    """Fit on labelled rows.

    ``labels`` needs doc_id and ``label``; null labels and null ids are not
    used.  The bounded sample is chosen among the labels before any text is
    read, and only statistics, not texts, reach the driver.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # fit_rows rows at most
    rows = counted(texts).toPandas()
    names = list(statistics({n: F.lit(0) for n in ["chars", *COUNTED]}))
    rows = rows.sort_values(["doc_id", *names]).reset_index(drop=True)
    return fit_rules(rows[names].to_numpy(float), rows["y"].to_numpy(float), names)


def counted(texts: DataFrame) -> DataFrame:
    """doc_id, y and the statistics of ``texts``.

    The counts come out of a generator of one row each, which neither a
    projection nor a filter is moved through: each pattern runs once a text.
    """
    row = F.struct(*[c.alias(f"count {n}") for n, c in counts(F.coalesce(F.col("text"), F.lit(""))).items()])
    own = [F.col(f"`{c}`") for c in texts.columns]
    measured = texts.select(*own, F.inline(F.array(row)))
    stats = statistics({n: F.col(f"`count {n}`") for n in ["chars", *COUNTED]})
    return measured.select("doc_id", "y", *[c.alias(n) for n, c in stats.items()])


def scored(docs: DataFrame, model: RuleModel, name: str) -> DataFrame:
    """``docs`` with the score; only what the rules ask for is counted, each once a text (see :func:`counted`)."""
    used = {name for rule, _ in model.rules for name, _, _ in rule}
    needed = {"chars", "words"} | (used & COUNTED.keys())
    own = [F.col(f"`{c}`") for c in docs.columns]
    inner = {n: unused(f"count {n}", docs) for n in needed}
    row = F.struct(*[c.alias(inner[n]) for n, c in counts(F.coalesce(F.col("text"), F.lit(""))).items() if n in needed])
    measured = docs.select(*own, F.inline(F.array(row)))
    of = statistics({n: F.col(f"`{inner[n]}`") if n in needed else F.lit(0) for n in ["chars", *COUNTED]})
    return measured.select(*own, model.score(of).alias(name))


def score_quality(docs: DataFrame, model: RuleModel, cut_off: float = CUT_OFF) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (1 if score >= ``cut_off``) of every whole text.

    The rules are compiled into one column expression over the text's
    statistics.  ``docs`` needs doc_id and text.  Null texts are scored as empty
    ones; repeated rows score alike; an empty table gives no rows.
    """
    found = scored(docs.select("doc_id", "text"), model, "score")
    return found.select("doc_id", "score", (F.col("score") >= cut_off).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, cut_off: float = CUT_OFF) -> DataFrame:
    """The rows of ``docs``, all columns, that the model doesn't reject."""
    name = unused("rule score", docs)
    return scored(docs, model, name).where(F.col(f"`{name}`") >= cut_off).select(*[F.col(f"`{c}`") for c in docs.columns])
