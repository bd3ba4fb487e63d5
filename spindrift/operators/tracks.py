"""Operators on tracks, rows `(track_id, t, ...)`; one exchange by track serves all windows of a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stats import sigmoid
from .quantiles import quantile_table


def order(track: str = "track_id", t: str = "t") -> W:
    return W.partitionBy(track).orderBy(t)


def decode_visibility(df: DataFrame, occlusion: Column, distance: Column) -> DataFrame:
    """Adds `visible`, `invisible` and `confidence`, the latter 0 where the point is neither."""
    seen, sure = 1 - sigmoid(occlusion), 1 - sigmoid(distance)
    out = df.withColumns({"visible": seen * sure > 0.5, "invisible": (1 - seen) * sure > 0.5, "sure": sure})
    return out.withColumn("confidence", F.when(F.col("visible") | F.col("invisible"), F.col("sure")).otherwise(0.0)).drop("sure")


def decode_occlusion(df: DataFrame, occlusion: Column, distance: Column) -> DataFrame:
    """Adds `visible` alone: the earlier rule, which tells nothing of points known to be hidden."""
    return df.withColumn("visible", (1 - sigmoid(occlusion)) * (1 - sigmoid(distance)) > 0.5)


def motion_scores(df: DataFrame, query: int, dims: list[str], track: str = "track_id", t: str = "t") -> DataFrame:
    """`(track, score)`: a track's greatest distance from where it is at `query`."""
    base = df.where(F.col(t) == query).select(track, *(F.col(d).alias(f"q_{d}") for d in dims))
    return df.join(base, track).groupBy(track).agg(F.max(g.norm([F.col(d) - F.col(f"q_{d}") for d in dims])).alias("score"))


def pin_query_points(df: DataFrame, queries: DataFrame, dims: list[str], track: str = "track_id", t: str = "t") -> DataFrame:
    """Tracks that pass through their query points `(track, t, dims)` exactly."""
    known = queries.select(track, t, *(F.col(d).alias(f"q_{d}") for d in dims))
    held = df.join(known, [track, t], "left")
    return held.withColumns({d: F.coalesce(f"q_{d}", d) for d in dims}).drop(*(f"q_{d}" for d in dims))


def valid_tracks(df: DataFrame, length: int, track: str = "track_id", visible: str = "visible", share: float = 0.05, q: float = 0.1) -> DataFrame:
    """`(track, visible_count)` of tracks seen at least min(int(share * length), q-quantile of the counts) times."""
    counts = df.groupBy(track).agg(F.count_if(visible).alias("visible_count"))
    limit = quantile_table(counts, {"q": (F.col("visible_count"), q)}).select(F.least(F.lit(float(int(share * length))), F.col("q")).alias("limit"))
    return counts.crossJoin(F.broadcast(limit)).where(F.col("visible_count") >= F.col("limit")).drop("limit")


def interpolate_masked(df: DataFrame, value: str, visible: str, track: str = "track_id", t: str = "t", block: int | None = None) -> DataFrame:
    """Adds `filled`: hidden values on the line between the visible ones around them, beyond them the nearest.

    NULL where a track, or its block of steps, has no visible value.
    """
    keys = [F.col(track)] + ([F.floor(F.col(t) / block)] if block else [])
    w = W.partitionBy(*keys).orderBy(t)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    seen = F.when(F.col(visible), F.struct(F.col(t).alias("t"), F.col(value).alias("v")))
    held = df.withColumns({"a": F.last(seen, ignorenulls=True).over(back), "b": F.first(seen, ignorenulls=True).over(ahead)})
    a, b, now = F.col("a"), F.col("b"), F.col(t)
    line = F.when(a["t"] == b["t"], a["v"]).otherwise(a["v"] + (b["v"] - a["v"]) * (now - a["t"]) / (b["t"] - a["t"]))
    return held.withColumn("filled", F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(line)).drop("a", "b")


def carry_outward(df: DataFrame, value: Column, start: Column, keys: list[str], t: str = "t") -> DataFrame:
    """Adds `carried`: going out from `start` in both directions, missing values repeat the last one met."""
    back = W.partitionBy(*keys, F.col(t) >= start).orderBy(F.abs(F.col(t) - start)).rowsBetween(W.unboundedPreceding, 0)
    at_start = F.first(F.when(F.col(t) == start, value), ignorenulls=True).over(W.partitionBy(*keys))
    held = df.withColumns({"own": F.last(value, ignorenulls=True).over(back), "origin": at_start})
    return held.withColumn("carried", F.coalesce("own", "origin")).drop("own", "origin")


def second_difference(df: DataFrame, dims: list[str], keys: list[str], t: str = "t") -> DataFrame:
    """Rows with both neighbours and `accel`, the length of 2 x - previous - next."""
    w = W.partitionBy(*keys).orderBy(t)
    parts = [2 * F.col(d) - F.lag(d).over(w) - F.lead(d).over(w) for d in dims]
    return df.withColumn("accel", g.norm(parts)).where(F.col("accel").isNotNull())


def accel_loss(df: DataFrame, dims: list[str], keys: list[str], t: str = "t") -> DataFrame:
    return second_difference(df, dims, keys, t).agg(F.avg("accel").alias("loss"))


def smoothness_loss(bases: DataFrame, rot: list[str], transl: list[str], keys: list[str], rot_weight: float = 1.0, transl_weight: float = 2.0) -> DataFrame:
    """Weighted sum of the rotations' and translations' acceleration losses; both windows share one exchange."""
    w = W.partitionBy(*keys).orderBy("t")
    bend = lambda dims: g.norm([2 * F.col(d) - F.lag(d).over(w) - F.lead(d).over(w) for d in dims])
    both = bases.select(bend(rot).alias("r"), bend(transl).alias("s"))
    return both.agg((rot_weight * F.avg("r") + transl_weight * F.avg("s")).alias("loss"))


def velocity_directions(df: DataFrame, dims: list[str], eps: float = 1e-5, track: str = "track_id", t: str = "t") -> DataFrame:
    """`(track, t, u_*)`: unit direction of each step; a still point has a short one."""
    w = order(track, t)
    v = df.select(track, t, *((F.col(d) - F.lag(d).over(w)).alias(f"v_{d}") for d in dims)).where(F.col(f"v_{dims[0]}").isNotNull())
    size = g.norm([F.col(f"v_{d}") for d in dims]) + eps
    return v.select(track, t, *((F.col(f"v_{d}") / size).alias(f"u_{d}") for d in dims))


def direction_vectors(df: DataFrame, dims: list[str], **kw) -> DataFrame:
    """`(track, features)`: a track's directions one after the other, for clustering."""
    d = velocity_directions(df, dims, **kw)
    rows = F.array_sort(F.collect_list(F.struct("t", F.array(*(F.col(f"u_{x}") for x in dims)).alias("u"))))
    return d.groupBy(d.columns[0]).agg(F.flatten(F.transform(rows, lambda r: r["u"])).alias("features"))


def ray_velocity_penalty(df: DataFrame, dims: list[str], centre: list[Column], keys: list[str], t: str = "t") -> DataFrame:
    """Mean squared projections of the steps before and after a point on its ray from the camera."""
    w = W.partitionBy(*keys).orderBy(t)
    here = [F.col(d) for d in dims]
    ray = g.unit(g.sub(here, centre))
    before, after = [F.col(d) - F.lag(d).over(w) for d in dims], [F.lead(d).over(w) - F.col(d) for d in dims]
    both = df.select(g.dot(before, ray).alias("b"), g.dot(after, ray).alias("a")).where("a IS NOT NULL AND b IS NOT NULL")
    return both.agg((F.avg(F.col("b") ** 2) + F.avg(F.col("a") ** 2)).alias("loss"))


def canonical_frame(df: DataFrame, t: str = "t", visible: str = "visible") -> DataFrame:
    """The frame with most visible points, the first of several."""
    counts = df.groupBy(t).agg(F.count_if(visible).alias("n"))
    return counts.agg(F.max_by(t, F.struct(F.col("n"), -F.col(t))).alias("frame"), F.max("n").alias("visible_count"))


def trailing_window(df: DataFrame, dims: list[str], back: int = 20, track: str = "track_id", t: str = "t") -> DataFrame:
    """Adds the centre of each point's last `back` + 1 places and the number of them."""
    w = order(track, t).rowsBetween(-back, 0)
    return df.withColumns({f"trail_{d}": F.avg(d).over(w) for d in dims} | {"trail_n": F.count(F.lit(1)).over(w)})


def cumulative_times(df: DataFrame, key: str, seq: str, seconds: str, loop: bool = False) -> DataFrame:
    """Adds `at`, the time at which each key frame is reached; a loop adds the first one again at the end."""
    rows = df
    if loop:
        last = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), seq).alias("r"), F.max(seq).alias("end"))
        rows = df.unionByName(last.select("r.*", "end").withColumn(seq, (F.col("end") + 1).cast(df.schema[seq].dataType)).drop("end"))
    w = W.partitionBy(key).orderBy(seq)
    waits = rows.withColumn("wait", F.when(F.row_number().over(w) == 1, 0.0).otherwise(F.col(seconds)))
    return waits.withColumn("at", F.sum("wait").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("wait")
