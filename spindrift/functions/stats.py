"""Statistics as column expressions; every one works in `agg` and, where it says so, over a window."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantile(x: Column, q: float) -> Column:
    """Exact quantile with linear interpolation at q (n - 1)."""
    return F.percentile(x, F.lit(q))


def lower_median(name: str) -> Column:
    """The middle value, the smaller of two."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {name})")


def median(x: Column) -> Column:
    """The middle value, the mean of two."""
    return F.percentile(x, F.lit(0.5))


def ratio(part: Column, whole: Column) -> Column:
    """NULL where the whole is zero."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def share(flag: Column, among: Column | None = None) -> Column:
    """Share of rows with a flag, among those with another."""
    if among is None:
        return ratio(F.count_if(flag), F.count(F.lit(1)))
    return ratio(F.count_if(flag & among), F.count_if(among))


def weighted_mean(x: Column, weight: Column, eps: float = 1e-8, dims: int = 1) -> Column:
    return F.sum(x * weight) / (dims * F.sum(weight) + eps)


def huber(d: Column, delta: float) -> Column:
    a = F.abs(d)
    return F.when(a <= delta, 0.5 * d * d).otherwise(delta * (a - 0.5 * delta))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def logit(p: Column) -> Column:
    """NULL outside of (0, 1)."""
    return F.when((p > 0) & (p < 1), F.ln(p / (1.0 - p)))


def softmax(xs: Column) -> Column:
    """Of an array; shifted by its maximum."""
    top = F.array_max(xs)
    e = F.transform(xs, lambda v: F.exp(v - top))
    return F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))
