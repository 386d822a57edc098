"""Scalar measures as column expressions: ratios, logarithms, inequality, agreement, edit similarity."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    """Null for NaN, so that aggregates skip it."""
    return F.when(~F.isnan(c), c)


def plogp(p: Column) -> Column:
    """p log2 p, 0 at 0."""
    return F.when(p > 0, p * F.log2(p)).otherwise(0.0)


def log_ratio(p: Column, q: Column) -> Column:
    return F.when((p > 0) & (q > 0), F.log(p / q))


def odds(p: Column) -> Column:
    return F.try_divide(p, 1 - p)


def gini(values: Column, slots: int | None = None) -> Column:
    """Gini coefficient of an array of doubles, padded with zeros to `slots`; null if it is empty or sums to 0."""
    padded = values if slots is None else F.concat(values, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), F.lit(slots) - F.size(values))))
    ordered = F.array_sort(padded)
    n = F.size(ordered)
    weighted = F.aggregate(F.transform(ordered, lambda x, i: (2.0 * (i + 1) - n - 1) * x), F.lit(0.0), lambda a, x: a + x)
    return F.try_divide(weighted, n * F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x))


def entropy(shares: Column) -> Column:
    """Shannon entropy in bits of an array of shares."""
    return -F.aggregate(F.transform(shares, plogp), F.lit(0.0), lambda a, x: a + x)


def kappa(observed: Column, expected: Column) -> Column:
    return F.try_divide(observed - expected, 1 - expected)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two strings, row by row of the dynamic programme."""
    chars = F.filter(F.split(b, ""), lambda c: c != "")
    start = F.array_repeat(F.lit(0), F.size(chars) + 1)

    def row(before: Column, ch: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(chars)), F.array(F.lit(0)),
            lambda now, j: F.concat(now, F.array(F.when(F.element_at(chars, j) == ch, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(now, -1))))),
        )

    full = F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), start, row)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0).otherwise(F.element_at(full, -1))


def indel_ratio(a: Column, b: Column) -> Column:
    """2 LCS / (n + m); 1 for two empty strings."""
    total = F.length(a) + F.length(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * common_subsequence(a, b) / total)


def encode_labels(label: Column, codes: Iterable[tuple[str, str]]) -> Column:
    """One character for each label; an unknown label is an error."""
    out = F.when(label.isNull(), F.lit(None).cast("string"))
    for name, code in codes:
        out = out.when(label == name, code)
    return out.otherwise(F.raise_error(F.concat(F.lit("no code for label "), label)))


def sentinel_status(value: Column, low: float | None, high: float | None) -> Column:
    """ok, low, high or null, for a bounded feature."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), "null")
    if low is not None:
        out = out.when(value < low, "low")
    if high is not None:
        out = out.when(value > high, "high")
    return out.otherwise("ok")


def with_sentinels(value: Column, low: float | None, high: float | None, *, below: float = -999.0, above: float = 999.0) -> Column:
    """The in-band convention: `below` and `above` for values out of bounds."""
    status = sentinel_status(value, low, high)
    return F.when(status == "low", below).when(status == "high", above).when(status == "ok", value)
