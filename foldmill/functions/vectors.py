"""Functions of vectors held as arrays of numbers; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once a row, however often it is named inside (lambdas would work it out for each element)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 with a zero vector."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    whole = bound(F.struct(doubles(v).alias("v")), lambda s: F.struct(s["v"].alias("v"), norm(s["v"]).alias("size")))
    return bound(whole, lambda s: F.when(s["size"] > 0, F.transform(s["v"], lambda x: x / s["size"])).otherwise(s["v"]))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of the token vectors whose mask is 1; zeros if there are none."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.lit(1e-9))
    first = F.transform(F.element_at(tokens, 1), lambda x: x.cast("double") * 0)
    summed = F.aggregate(
        F.zip_with(tokens, mask, lambda t, m: F.transform(t, lambda x: x.cast("double") * m.cast("double"))),
        first,
        lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b),
    )
    return F.transform(summed, lambda x: x / n)


def mean_of_rows(matrix: Column) -> Column:
    """Mean over the first axis: patches or tokens of one item."""
    ones = F.transform(matrix, lambda _: F.lit(1))
    return masked_mean(matrix, ones)


def argmax(p: Column) -> Column:
    """Index (from 0) of the first largest number."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def one_hot(label: Column, k: int) -> Column:
    """k indicators; all 0 for null or unknown labels."""
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda c: F.coalesce((c == label).cast("int"), F.lit(0)))


def linear_grid(n: int) -> Column:
    """n even steps from 0 to 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i / float(n - 1))


def min_max(v: Column, mask: Column | None = None) -> Column:
    """Scaled to 0..1 by the extent of the masked entries and clipped; constant ones stay unscaled, others become 0."""
    inside = v if mask is None else F.filter(F.zip_with(v, mask, lambda x, m: F.when(m != 0, x)), lambda x: x.isNotNull())
    ends = F.struct(v.alias("v"), F.array_min(inside).alias("low"), F.array_max(inside).alias("high"))

    def scale(s: Column) -> Column:
        low, high = s["low"], s["high"]
        return F.transform(s["v"], lambda x: F.least(F.greatest(F.when(high > low, (x - low) / (high - low)).otherwise(x), F.lit(0.0)), F.lit(1.0)))

    scaled = bound(ends, scale)
    return scaled if mask is None else F.zip_with(scaled, mask, lambda x, m: F.when(m != 0, x).otherwise(0.0))


def softmax(v: Column) -> Column:
    raised = bound(F.struct(v.alias("v"), F.array_max(v).alias("top")), lambda s: F.transform(s["v"], lambda x: F.exp(x - s["top"])))
    whole = bound(F.struct(raised.alias("e")), lambda s: F.struct(s["e"].alias("e"), total(s["e"]).alias("sum")))
    return bound(whole, lambda s: F.transform(s["e"], lambda x: x / s["sum"]))


def attention(query: Column, keys: Column) -> Column:
    """Weights of one query over the keys: softmax of scaled products."""
    scale = F.sqrt(F.size(query).cast("double"))
    return softmax(F.transform(keys, lambda k: dot(query, k) / scale))


def head_mean(weights: Column) -> Column:
    """Mean over the heads of an array of weights by head."""
    return mean_of_rows(weights)


def square(values: Column) -> Column:
    """The values as rows of a square, the first one on top; null unless their number is a square."""

    def shaped(s: Column) -> Column:
        side, v = s["side"], s["v"]
        rows = F.transform(F.sequence(F.lit(1), side), lambda i: F.slice(v, (i - 1) * side + 1, side))
        return F.when((side > 0) & (side * side == F.size(v)), rows)

    return bound(F.struct(values.alias("v"), F.round(F.sqrt(F.size(values).cast("double"))).cast("int").alias("side")), shaped)


def attention_map(queries: Column, keys: Column) -> Column:
    """Weights of each head's query over its keys, averaged over the heads, as a square."""
    return square(head_mean(F.zip_with(queries, keys, attention)))
