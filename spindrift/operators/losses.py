"""Masked, trimmed and robust losses as one-row aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import huber, weighted_mean
from .quantiles import quantile_table


def with_threshold(df: DataFrame, loss: str, q: float) -> DataFrame:
    """Adds the loss's quantile as a column; one number, computed once and sent to every task."""
    return df.crossJoin(F.broadcast(quantile_table(df, {"threshold": (F.col(loss), q)})))


def masked_loss(df: DataFrame, loss: Column, mask: Column | None, q: float = 1.0, normalise: bool = True) -> DataFrame:
    """One row, `loss`: the masked mean of losses below their q-quantile.

    With a mask and q = 1 nothing is trimmed.  Without a mask the largest losses
    go even at q = 1, as the comparison is strict; nothing left gives NULL.
    """
    rows = df.select(loss.alias("l"), (F.lit(1.0) if mask is None else mask.cast("double")).alias("m"))
    if mask is None or q < 1:
        rows = with_threshold(rows, "l", q).where("l < threshold")
    if mask is None:
        return rows.agg(F.avg("l").alias("loss"))
    l, m = F.col("l"), F.col("m")  # noqa: E741
    return rows.agg((weighted_mean(l, m) if normalise else F.avg(l * m)).alias("loss"))


def masked_l1(df: DataFrame, pred: str, target: str, mask: Column | None = None, q: float = 1.0, normalise: bool = True) -> DataFrame:
    return masked_loss(df, F.abs(F.col(pred) - F.col(target)), mask, q, normalise)


def masked_mse(df: DataFrame, pred: str, target: str, mask: Column | None = None, q: float = 1.0, normalise: bool = True) -> DataFrame:
    return masked_loss(df, (F.col(pred) - F.col(target)) ** 2, mask, q, normalise)


def masked_huber(df: DataFrame, pred: str, target: str, delta: float, mask: Column, dims: int = 1) -> DataFrame:
    return df.agg(weighted_mean(huber(F.col(pred) - F.col(target), delta), mask, dims=dims).alias("loss"))


def total_loss(terms: dict[str, tuple[float, DataFrame]]) -> DataFrame:
    """Weighted sum of one-row losses: `(name, weight, loss, total)`."""
    rows = None
    for name, (weight, df) in terms.items():
        one = df.select(F.lit(name).alias("name"), F.lit(weight).alias("weight"), F.col("loss"))
        rows = one if rows is None else rows.unionAll(one)
    return rows.crossJoin(F.broadcast(rows.agg(F.sum(F.col("weight") * F.coalesce("loss", F.lit(0.0))).alias("total"))))


def mean_scale_variance(df: DataFrame, scales: list[str]) -> DataFrame:
    """The mean of each row's sample variance over its scales."""
    mean = sum((F.col(s) for s in scales[1:]), F.col(scales[0])) / len(scales)
    var = sum(((F.col(s) - mean) ** 2 for s in scales[1:]), (F.col(scales[0]) - mean) ** 2) / (len(scales) - 1)
    return df.agg(F.avg(var).alias("loss"))


def coefficient_sparsity(df: DataFrame, coefs: str) -> DataFrame:
    """1 - mean of the sum of squared coefficients."""
    return df.agg((1.0 - F.avg(F.aggregate(coefs, F.lit(0.0), lambda a, c: a + c * c))).alias("loss"))


def depth_range_hinge(df: DataFrame, frame: str, depth: str, reference: str, top: float = 0.98) -> DataFrame:
    """Depths outside a frame's reference range, its minimum to its upper quantile; each side's mean over the rows that exceed it."""
    limits = quantile_table(df, {"low": (F.col(reference), 0.0), "high": (F.col(reference), top)}, [frame])
    rows = df.join(F.broadcast(limits), frame)
    d = F.col(depth)
    below, above = F.avg(F.when(d < F.col("low"), F.col("low") - d)), F.avg(F.when(d > F.col("high"), d - F.col("high")))
    return rows.agg((F.coalesce(below, F.lit(0.0)) + F.coalesce(above, F.lit(0.0))).alias("loss"))
