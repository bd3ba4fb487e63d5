"""Sampling, ranking, densification and label operators; random choice is by hash of the row, so it repeats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def hashed_order(id_: Column, seed: int = 0) -> Column:
    """A portable pseudo-random key: a multiplicative congruence over a prime, whose factor scatters small numbers too."""
    return ((id_ % 2147483647).cast("long") * 742938285 + seed) % 2147483647


def top_k(df: DataFrame, score: str, id_: str, k: int) -> DataFrame:
    return df.orderBy(F.desc(score), id_).limit(k)


def balanced_top_k(df: DataFrame, cell: list[str], score: str, id_: str, k: int) -> DataFrame:
    """k rows taken in turn from all cells, each cell giving its best one first.

    Ranks beyond k cannot be taken, which bounds what is sorted at the end.
    """
    rank = F.row_number().over(W.partitionBy(*cell).orderBy(F.desc(score), id_))
    return df.withColumn("rank_in_cell", rank).where(F.col("rank_in_cell") <= k).orderBy("rank_in_cell", *cell).limit(k)


def quota_sample(df: DataFrame, frame: str, id_: str, total: int, seed: int = 0, last_takes_rest: bool = True) -> DataFrame:
    """total // frames rows of each frame, the last frame taking the remainder, by hashed order."""
    frames = df.groupBy(frame).agg(F.lit(1).alias("one")).agg(F.count("*").alias("frames"), F.max(frame).alias("last"))
    each = F.floor(F.lit(total) / F.col("frames"))
    quota = F.when((F.col(frame) == F.col("last")) & F.lit(last_takes_rest), F.lit(total) - each * (F.col("frames") - 1)).otherwise(each)
    rank = F.row_number().over(W.partitionBy(frame).orderBy(hashed_order(F.col(id_), seed), id_))
    return df.withColumn("pick", rank).crossJoin(F.broadcast(frames)).where(F.col("pick") <= quota).drop("frames", "last")


def ceil_quota_sample(df: DataFrame, query: str, id_: str, total: int, seed: int = 0) -> DataFrame:
    """ceil(total / queries) rows of each query in order of query, until `total` are taken."""
    n = df.select(query).distinct().agg(F.count("*").alias("queries"))
    rank = F.row_number().over(W.partitionBy(query).orderBy(hashed_order(F.col(id_), seed), id_))
    picked = df.withColumn("pick", rank).crossJoin(F.broadcast(n)).where(F.col("pick") <= F.ceil(F.lit(total) / F.col("queries"))).drop("queries")
    return picked.orderBy(query, "pick").limit(total)


def thin(df: DataFrame, frame: str, id_: str, by: int = 8, least: int = 64, seed: int = 0) -> DataFrame:
    """max(n // by, least) rows of each frame of n."""
    w = W.partitionBy(frame)
    ranked = df.withColumns({"pick": F.row_number().over(w.orderBy(hashed_order(F.col(id_), seed), id_)), "n": F.count(F.lit(1)).over(w)})
    return ranked.where(F.col("pick") <= F.greatest(F.floor(F.col("n") / by), F.lit(least))).drop("n")


def thin_and_cap(df: DataFrame, frame: str, id_: str, total: int, by: int = 8, least: int = 64, seed: int = 0) -> DataFrame:
    """The thinned frames, and of them no more than `total` rows, by hashed order."""
    return thin(df, frame, id_, by, least, seed).drop("pick").orderBy(hashed_order(F.col(id_), seed + 1), id_).limit(total)


def shuffled(df: DataFrame, id_: str, n: int, seed: int) -> DataFrame:
    """n rows in an order that looks random and is the same each time."""
    return df.orderBy(hashed_order(F.col(id_), seed), id_).limit(n)


def random_frames(items: DataFrame, id_: str, frames: int, n: int, seed: int = 0) -> DataFrame:
    """`(.., target)`: n different frames of `frames` for each item, by hashed order of item and frame; no rows are exchanged."""
    keyed = F.transform(F.sequence(F.lit(0), F.lit(frames - 1)), lambda t: F.struct(hashed_order(F.col(id_) * frames + t, seed).alias("key"), t.alias("t")))
    return items.withColumn("target", F.explode(F.transform(F.slice(F.array_sort(keyed), 1, n), lambda s: s["t"])))


def on_grid(points: DataFrame, frames: DataFrame, mask: str, step: int = 1) -> DataFrame:
    """Points `(frame, y, x)` on masked pixels of the grid: a semi-join, so a pixel's copies never multiply a point."""
    return points.join(query_grid(frames, mask, step).select("frame", "y", "x"), ["frame", "y", "x"], "left_semi")


def original_labels(df: DataFrame, dense: DataFrame, label: str, dense_id: str = "dense_id") -> DataFrame:
    """Rows with their dense number turned back into the label."""
    return df.join(dense.select(dense_id, label), dense_id).drop(dense_id)


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def paired_by_stem(left: DataFrame, right: DataFrame, path: str = "path") -> DataFrame:
    """`(stem, left, right)` of files whose names are alike but for folder and ending; a left one without a partner fails."""
    from ..sources.files import stem

    named = lambda df, side: df.select(stem(F.col(path)).alias("stem"), F.col(path).alias(side))
    return require_matches(named(left, "left"), named(right, "right"), ["stem"])


def cap_by_hash(df: DataFrame, key: str, id_: str, most: int, seed: int = 0) -> DataFrame:
    """Up to `most` rows of each key, by hashed order."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(hashed_order(F.col(id_), seed), id_))
    return df.withColumn("pick", rank).where(F.col("pick") <= most)


def cap_by_stride(df: DataFrame, key: str, id_: str, most: int) -> DataFrame:
    """Every s-th row of each key, s = max(1, n // most), and no more than `most` of them."""
    w = W.partitionBy(key)
    ranked = df.withColumns({"i": F.row_number().over(w.orderBy(id_)) - 1, "n": F.count(F.lit(1)).over(w)})
    step = F.greatest(F.lit(1), F.floor(F.col("n") / most))
    return ranked.where((F.col("i") % step == 0) & (F.floor(F.col("i") / step) < most)).drop("i", "n")


def query_grid(frames: DataFrame, mask: str, step: int = 4) -> DataFrame:
    """`(frame, point_id, x, y)` of every step-th pixel both ways where the mask holds."""
    ys, xs = F.sequence(F.lit(0), F.col("h") - 1, F.lit(step)), F.sequence(F.lit(0), F.col("w") - 1, F.lit(step))
    rows = frames.select("frame", "w", F.col(mask).alias("m"), F.explode(ys).alias("y"), xs.alias("xs")).select("frame", "w", "m", "y", F.explode("xs").alias("x"))
    return rows.where(F.get("m", F.col("y") * F.col("w") + F.col("x"))).select("frame", (F.col("y") * F.col("w") + F.col("x")).alias("point_id"), "x", "y")


def densify(df: DataFrame, split: Column, duplicate: Column, log_scales: list[str], shrink: float = 1.6) -> DataFrame:
    """Rows that aren't split, a second one of those duplicated, and two smaller ones of those split; `copy` numbers them.

    One pass: each row is turned into as many as it becomes.
    """
    parts = F.when(split, F.array(F.lit(2), F.lit(3))).otherwise(F.array(F.lit(0)))
    rows = df.withColumn("_split", split).withColumn("copy", F.explode(F.concat(parts, F.when(duplicate, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))))
    smaller = {s: F.when(F.col("copy") >= 2, F.col(s) - F.log(F.lit(shrink))).otherwise(F.col(s)) for s in log_scales}
    return rows.withColumns(smaller).drop("_split")


def cull(df: DataFrame, drop: Column) -> DataFrame:
    return df.where(~F.coalesce(drop, F.lit(False)))


def cull_with(df: DataFrame, drop: Column, others: list[DataFrame], id_: str) -> list[DataFrame]:
    """The rows that stay, and of other tables about the same rows, such as running statistics, those of rows that stay."""
    kept = cull(df, drop)
    return [kept, *(o.join(kept.select(id_).distinct(), id_, "left_semi") for o in others)]


def control_predicates(df: DataFrame, grad: Column, scale: Column, radius: Column, opacity: Column, *, grad_limit: float, scale_limit: float, screen_limit: float, least_opacity: float, cull_scale: Column, by_screen: bool, by_scale: bool) -> DataFrame:
    """Adds `should_split`, `should_dup` and `should_cull` from running statistics."""
    high, big = grad > grad_limit, scale > scale_limit
    wide = radius > screen_limit if by_screen else F.lit(False)
    drop = opacity < least_opacity
    if by_scale:
        drop = drop | (scale > cull_scale) | wide
    return df.withColumns({"should_split": high & (big | wide), "should_dup": high & ~big, "should_cull": drop})


def control_schedule(steps: DataFrame, *, frames: int, warmup: int = 200, every: int = 100, reset_every: int = 3000, stop_densify: int = 4000, stop: int = 4000) -> DataFrame:
    """Adds to each step whether statistics are complete and which of densify, cull and reset run."""
    s, phase = F.col("step"), F.col("step") % reset_every
    ready = (s > warmup) & (s % every == 0) & (s < stop)
    return steps.withColumns({"ready": ready, "densify": ready & (s < stop_densify) & (phase > frames), "cull": ready & (phase > min(3 * frames, 1000)), "reset": ready & (phase == 0)})


def running_stats(df: DataFrame, step: str, id_: str, grad: str, radius: str, every: int = 100) -> DataFrame:
    """`(window, id, grad_sum, vis_count, grad_avg, max_radius)`: statistics of visible rows, begun anew every so many steps."""
    seen = df.where(F.col(radius) > 0).groupBy(F.floor(F.col(step) / every).alias("window"), id_)
    out = seen.agg(F.sum(grad).alias("grad_sum"), F.count(F.lit(1)).alias("vis_count"), F.max(radius).alias("max_radius"))
    return out.withColumn("grad_avg", F.col("grad_sum") / F.greatest("vis_count", F.lit(1)))


def dense_labels(df: DataFrame, label: str) -> DataFrame:
    """`(label, dense_id)` numbering distinct labels from 1; what is ranked is the labels, never the rows."""
    return df.select(label).where(F.col(label).isNotNull()).distinct().withColumn("dense_id", F.row_number().over(W.orderBy(label)))


def one_hot(df: DataFrame, keys: list[str], label: str, labels: list) -> DataFrame:
    return df.groupBy(*keys).agg(*(F.max((F.col(label) == v).cast("int")).alias(f"is_{v}") for v in labels))


def overlay(masks: DataFrame, pixel: list[str], layer: str, obj: str) -> DataFrame:
    """The object of the topmost layer at each pixel."""
    return masks.groupBy(*pixel).agg(F.max_by(obj, layer).alias(obj))


def missing_work(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys have no output yet."""
    return work.join(done.select(*keys).distinct(), keys, "left_anti")


def require_matches(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join that fails on a left row without a partner, when that row is read."""
    known = right.withColumn("_found", F.lit(True))
    joined = left.join(known, keys, "left")
    check = F.when(F.col("_found"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no match for "), F.concat_ws(", ", *keys))).cast("boolean"))
    return joined.where(check).drop("_found")
