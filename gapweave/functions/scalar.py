"""Column expressions shared by the operators. All run inside codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def ratio(num: Column, den: Column, default: float | None = 0.0) -> Column:
    """num / den, ``default`` where the denominator is zero."""
    q = F.try_divide(num.cast("double"), den.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def sigmoid(x: str | Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-c(x)))


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))


def nan_to_zero(x: str | Column) -> Column:
    return F.coalesce(F.nanvl(c(x), F.lit(0.0)), F.lit(0.0))


def clean_nan(x: str | Column) -> Column:
    """NaN becomes NULL, the only form of 'missing' used past ingest."""
    return F.when(F.isnan(c(x)), None).otherwise(c(x))


def threshold_label(p: str | Column, t: float | Column = 0.5) -> Column:
    t = t if isinstance(t, Column) else F.lit(float(t))
    return F.when(c(p) < t, 0).otherwise(1)


def half_even(p: str | Column) -> Column:
    """Round a probability to a label; one half goes to 0."""
    return F.bround(c(p), 0)


def linear(terms: dict[str, float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for name, w in terms.items():
        out = out + F.col(name) * F.lit(float(w))
    return out


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def euclidean(a: Column, b: Column) -> Column:
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(sq, F.lit(0.0), lambda s, x: s + x))


def nan_euclidean(a: Column, b: Column) -> Column:
    """Distance over coordinates present on both sides, scaled to full width.

    NULL when no coordinate is shared.
    """
    sq = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    both = F.filter(sq, lambda v: v.isNotNull())
    total = F.aggregate(both, F.lit(0.0), lambda s, x: s + x)
    return F.sqrt(F.try_divide(total * F.size(a), F.size(both).cast("double")))


def softmax_array(x: Column) -> Column:
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda s, v: s + v)
    return F.transform(e, lambda v: v / total)


def observed_mask(cols: Iterable[str]) -> Column:
    """Bitmask of observed columns; bit i stands for the i-th column."""
    out = F.lit(0).cast("long")
    for i, name in enumerate(cols):
        out = out + F.when(F.col(name).isNotNull(), F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out

