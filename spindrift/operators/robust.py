"""Robust statistics over tables: exact quantiles at any size, scene scale, alignment of two measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stats import median, ratio
from .quantiles import medians, quantile_table, quantile_values

def exact_quantile(df: DataFrame, x: str, q: float) -> float | None:
    """Quantile at q (n - 1), linearly interpolated, of any number of values."""
    found = quantile_values(df, {"x": (F.col(x), q)})
    return found[()]["x"] if found else None


def spread(points: DataFrame, axes: list[str], low: float = 0.05, high: float = 0.95) -> DataFrame:
    """One row: the mean point, and as scale the largest half-width between two quantiles."""
    limits = quantile_table(points, {f"{side}_{a}": (F.col(a), q) for a in axes for side, q in (("low", low), ("high", high))})
    halves = [(F.col(f"high_{a}") - F.col(f"low_{a}")) / 2 for a in axes]
    means = points.agg(*(F.avg(a).alias(f"c{a}") for a in axes))
    return means.crossJoin(F.broadcast(limits.select((F.greatest(*halves) if len(halves) > 1 else halves[0]).alias("scale"))))


def up_rotation(up: g.Cols) -> g.Cols:
    """Rotation that takes an upward direction to (0, -1, 0): by the cross product, its square weighed by 1 / (1 + cosine)."""
    u = g.unit(up)
    target = [F.lit(0.0), F.lit(-1.0), F.lit(0.0)]
    v, c = g.cross(u, target), g.dot(u, target)
    k = [F.lit(0.0), -v[2], v[1], v[2], F.lit(0.0), -v[0], -v[1], v[0], F.lit(0.0)]
    k2 = g.matmul(k, k, 3)
    eye = [F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)]
    return [e + a + F.try_divide(b, 1.0 + c) for e, a, b in zip(eye, k, k2, strict=True)]


def align_scale_shift(df: DataFrame, key: str, mono: str, reference: str) -> DataFrame:
    """`(key, scale, shift)`: scale is the median ratio of deviations from the medians, shift the median of what it leaves.

    Keys are few and large: each median comes from histograms, and joins the rows again as a small table.
    """
    middles = F.broadcast(medians(df, {"m0": F.col(mono), "r0": F.col(reference)}, [key]))
    quotient = F.try_divide(F.col(reference) - F.col("r0") + 1e-8, F.col(mono) - F.col("m0") + 1e-8)
    scales = medians(df.join(middles, key), {"scale": quotient}, [key])
    shifts = medians(df.join(F.broadcast(scales), key), {"shift": F.col(reference) - F.col("scale") * F.col(mono)}, [key])
    return scales.join(F.broadcast(shifts), key)


def nested_median_ratio(df: DataFrame, frame: str, a: Column, b: Column, valid: Column, least: int = 1024, default: float = 1.0) -> DataFrame:
    """One row, `scale`: the median over frames with more than `least` valid rows of their median ratio."""
    by_frame = df.where(valid).groupBy(frame).agg(median(ratio(a, b)).alias("r"), F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return by_frame.agg(F.coalesce(median(F.col("r")), F.lit(default)).alias("scale"))


def cluster_centres(df: DataFrame, label: str, dims: list[str], least: int = 0) -> DataFrame:
    """Lower median by dimension of each cluster of more than `least` rows."""
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return sizes.join(F.broadcast(medians(df, {d: F.col(d) for d in dims}, [label], lower=True)), label).select(label, *dims, "n")


def centre_weights(df: DataFrame, label: str, dims: list[str], visible: str | None = None) -> DataFrame:
    """Adds `dist`, relative to the cluster's lower median of it, and `weight`, exp(-dist) over the cluster's mean; 0 beyond the 0.9 quantile of all.

    With `visible`, whether or how often a row is seen, weights are multiplied by it.
    """
    centres = medians(df, {f"m_{d}": F.col(d) for d in dims}, [label], lower=True)
    far = df.join(F.broadcast(centres), label).withColumn("raw", g.norm([F.col(d) - F.col(f"m_{d}") for d in dims])).drop(*(f"m_{d}" for d in dims))
    dist = far.join(F.broadcast(medians(far, {"middle": F.col("raw")}, [label], lower=True)), label)
    dist = dist.withColumn("dist", F.try_divide(F.col("raw"), F.col("middle"))).drop("raw", "middle")
    means = dist.groupBy(label).agg(F.avg(F.exp(-F.col("dist"))).alias("mean_e"))
    weight = F.exp(-F.col("dist")) / (F.col("mean_e") + 1e-6)
    weight = weight if visible is None else weight * (F.col(visible).cast("double") + 1e-6)
    limit = exact_quantile(dist, "dist", 0.9)
    kept = F.when(F.col("dist").isNull() | (F.col("dist") > F.lit(limit)), 0.0).otherwise(weight)
    return dist.join(means, label).withColumn("weight", kept).drop("mean_e")


def outlier_cut(df: DataFrame, track: str, dist: str, visible: str, q: float = 0.95) -> DataFrame:
    """Tracks seen at least once whose mean distance is below the tracks' q-quantile."""
    by_track = df.groupBy(track).agg(F.avg(dist).alias("d"), F.bool_or(visible).alias("seen"))
    limit = quantile_table(by_track, {"limit": (F.col("d"), q)})
    return by_track.crossJoin(F.broadcast(limit)).where(F.col("seen") & (F.col("d") < F.col("limit"))).select(track, "d")


def bounding_box(df: DataFrame, axes: list[str], grow: float = 1.25) -> DataFrame:
    return df.agg(*(e for a in axes for e in (F.min(a).alias(f"min_{a}"), F.max(a).alias(f"max_{a}"))), *(((F.max(a) - F.min(a)) * grow).alias(f"size_{a}") for a in axes))


def camera_radius(df: DataFrame, axes: list[str]) -> DataFrame:
    """One row, `radius`: the farthest camera's distance from the cameras' mean."""
    centre = df.agg(*(F.avg(a).alias(f"c_{a}") for a in axes))
    return df.crossJoin(F.broadcast(centre)).agg(F.max(g.norm([F.col(a) - F.col(f"c_{a}") for a in axes])).alias("radius"))


def intrinsics(df: DataFrame, names: list[str]) -> DataFrame:
    """Mean and median camera over frames."""
    means = df.agg(*(F.avg(n).alias(f"mean_{n}") for n in names))
    both = means.crossJoin(F.broadcast(medians(df, {f"median_{n}": F.col(n) for n in names})))
    return both.select(*(c for n in names for c in (f"mean_{n}", f"median_{n}")))
