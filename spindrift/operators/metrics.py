"""Tracking and image quality metrics; a metric over groups is the mean of the groups' values where it says so."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.stats import ratio, share
from .quantiles import ranked_values

PIXEL_THRESHOLDS = (4.0, 8.0, 16.0, 32.0, 64.0)


def _unpivot(df: DataFrame, thresholds: Sequence[float], keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Columns name_0, name_1, ... to rows, one for each threshold."""
    rows = F.array(*(F.struct(F.lit(t).alias("threshold"), *(F.col(f"{n}_{i}").alias(n) for n in names)) for i, t in enumerate(thresholds)))
    return df.select(*keys, F.explode(rows).alias("r")).select(*keys, "r.*")


def pck(points: DataFrame, group: str, sq_error: str, visible: str, evaluated: str, thresholds=PIXEL_THRESHOLDS) -> DataFrame:
    """`(threshold, frac_correct, mean_group_pck)`: share of visible evaluated points within a threshold, over all and as the mean of groups.

    All thresholds are counted in one pass, so rows are never multiplied by them.
    """
    scored = points.where(F.col(evaluated) & F.col(visible))
    counts = [F.count_if(F.col(sq_error) < t * t).alias(f"n_{i}") for i, t in enumerate(thresholds)]
    by_group = scored.groupBy(group).agg(*counts, F.count(F.lit(1)).alias("all"))
    wide = by_group.agg(*(e for i in range(len(thresholds)) for e in (ratio(F.sum(f"n_{i}"), F.sum("all")).alias(f"frac_correct_{i}"), F.avg(ratio(F.col(f"n_{i}"), F.col("all"))).alias(f"mean_group_pck_{i}"))))
    return _unpivot(wide, thresholds, [], ["frac_correct", "mean_group_pck"])


def jaccard(points: DataFrame, sq_error: str, target: str, pred: str, evaluated: str, thresholds=PIXEL_THRESHOLDS) -> DataFrame:
    """`(threshold, jaccard, average_jaccard, occlusion_accuracy)`; a false positive is visible in the prediction, and hidden or too far in truth."""
    p, v = F.col(pred), F.col(target)
    aggs: list[Column] = [share(p == v).alias("occlusion_accuracy")]
    for i, t in enumerate(thresholds):
        near = F.col(sq_error) < t * t
        aggs.append(ratio(F.count_if(near & v & p), F.count_if(v) + F.count_if(p & ~(v & near))).alias(f"jaccard_{i}"))
    wide = points.where(F.col(evaluated)).agg(*aggs)
    mean = sum((F.col(f"jaccard_{i}") for i in range(1, len(thresholds))), F.col("jaccard_0")) / len(thresholds)
    return _unpivot(wide.withColumn("average_jaccard", mean), thresholds, ["average_jaccard", "occlusion_accuracy"], ["jaccard"])


def psnr(pixels: DataFrame, keys: Sequence[str], errors: Sequence[Column], mask: Column, clamp_mask: bool = False) -> DataFrame:
    """Masked peak signal-to-noise ratio of each image; a perfect or unmasked image has none (NULL)."""
    total = F.sum(mask)
    count = F.greatest(total, F.lit(1.0)) if clamp_mask else total
    sse = F.sum(sum((e * e for e in errors[1:]), errors[0] * errors[0]) * mask)
    mse = ratio(sse, count * len(errors))
    return pixels.groupBy(*keys).agg(F.when(mse > 0, -10.0 * F.log10(mse)).alias("psnr"))


def endpoint_error(points: DataFrame, pair: Sequence[str], distance: Column, covisible: Column, within: Sequence[float] = (0.1, 0.05)) -> DataFrame:
    """One row: the mean over non-empty pairs of the mean distance, and of the share within each limit."""
    seen = points.where(covisible).withColumn("d", distance).groupBy(*pair)
    by_pair = seen.agg(F.avg("d").alias("epe"), *(share(F.col("d") < w).alias(f"pck_{i}") for i, w in enumerate(within)))
    return by_pair.agg(F.avg("epe").alias("epe"), *(F.avg(f"pck_{i}").alias(f"pck_{i}") for i in range(len(within))), F.count(F.lit(1)).alias("pairs"))


def aligned_endpoint_error(points: DataFrame, cameras: DataFrame, pair: Sequence[str], covisible: Column, within: Sequence[float] = (0.1, 0.05)) -> DataFrame:
    """The same of predictions in a frame of their own: `(x, y, z)` against `(tx, ty, tz)`.

    `cameras` has predicted and true poses, `pred_w2c` and `w2c`; the similarity
    that takes the predicted centres to the true ones is applied to the points.
    """
    from .fits import aligned, procrustes

    centre = lambda m: g.translation_of(g.invert_rigid(g.unpack(F.col(m), 16)))
    centres = cameras.select(*(c.alias(n) for n, c in zip(("x", "y", "z", "tx", "ty", "tz"), [*centre("pred_w2c"), *centre("w2c")], strict=True)))
    fit = procrustes(centres, [])
    return endpoint_error(aligned(points.withColumn("_all", F.lit(1)), fit.withColumn("_all", F.lit(1)), ["_all"]), pair, F.col("residual"), covisible, within)


def image_report(images: DataFrame, size: int = 11) -> DataFrame:
    """One row, `(frames, psnr, ssim)`: means over the frames of `(frame, h, w, pred, target, mask)`, the mask telling what two views share."""
    pixels = images.select("frame", F.explode(F.arrays_zip("pred", "target", "mask")).alias("p")).select("frame", "p.*")
    first = psnr(pixels, ["frame"], [F.col("pred") - F.col("target")], F.col("mask"), clamp_mask=True)
    both = first.join(ssim(images, size), "frame", "full")
    return both.agg(F.count(F.lit(1)).alias("frames"), F.avg("psnr").alias("psnr"), F.avg("ssim").alias("ssim"))


def validation_report(frames: DataFrame, keypoints: DataFrame, size: int = 11, thresholds=(5.0, 10.0)) -> DataFrame:
    """`(metric, value)` of a validation pass: image metrics, and the share of keypoints `(px, py, tx, ty, visible)` within each threshold."""
    images = image_report(frames, size)
    gap = (F.col("px") - F.col("tx")) ** 2 + (F.col("py") - F.col("ty")) ** 2
    points = keypoints.where("visible").agg(*(share(gap < t * t).alias(f"pck_{i}") for i, t in enumerate(thresholds)))
    wide = images.crossJoin(F.broadcast(points))
    names = ["psnr", "ssim", *(f"pck_{i}" for i in range(len(thresholds)))]
    return wide.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in names))).alias("m")).select("m.*")


def partial_means(batch: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What a batch adds to running means: sums and counts, which can be merged in any order."""
    return batch.groupBy(*keys).agg(*(e for v in values for e in (F.sum(v).alias(f"sum_{v}"), F.count(v).alias(f"n_{v}"))))


def merged_means(partials: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The means of all batches' partial sums."""
    return partials.groupBy(*keys).agg(*(ratio(F.sum(f"sum_{v}"), F.sum(f"n_{v}")).alias(v) for v in values))


def depth_visibility(points: DataFrame, rendered: Column, predicted: Column, scale: float, limit: float = 0.05) -> DataFrame:
    """Adds `pred_visible`: the rendered surface is at the predicted depth."""
    return points.withColumn("pred_visible", F.abs(rendered - predicted) * scale < limit)


def pose_errors(poses: DataFrame, seq: str, frame: str) -> DataFrame:
    """Planar poses `(x, y, a)` and `(gx, gy, ga)`: ATE, and the relative errors of consecutive poses, in units and degrees.

    ATE is the mean distance of the positions.  The relative pose from i to i + 1
    is the inverse of i times i + 1; its error is the inverse of the true one
    times the predicted one.
    """
    w = W.partitionBy(seq).orderBy(frame)
    cols = ("x", "y", "a", "gx", "gy", "ga")
    step = poses.select(seq, *cols, *(F.lead(c).over(w).alias(f"{c}1") for c in cols))

    def relative(p: str) -> tuple[Column, Column, Column]:
        x, y, a = (F.col(f"{p}{c}") for c in "xya")
        dx, dy = F.col(f"{p}x1") - x, F.col(f"{p}y1") - y
        return F.cos(a) * dx + F.sin(a) * dy, F.cos(a) * dy - F.sin(a) * dx, F.col(f"{p}a1") - a

    (px, py, pa), (gx, gy, ga) = relative(""), relative("g")
    turn = F.acos(F.least(F.greatest(F.cos(pa - ga), F.lit(-1.0)), F.lit(1.0)))
    return step.groupBy(seq).agg(
        F.avg(F.sqrt((F.col("x") - F.col("gx")) ** 2 + (F.col("y") - F.col("gy")) ** 2)).alias("ate"),
        F.avg(F.sqrt((px - gx) ** 2 + (py - gy) ** 2)).alias("rpe_t"), F.avg(F.degrees(turn)).alias("rpe_r"),
    )


def rigid_pose_errors(poses: DataFrame, seq: str, frame: str, pred: str = "pred", target: str = "target") -> DataFrame:
    """The same of 4x4 camera-to-world poses, packed row by row: `(seq, ate, rpe_t, rpe_r)`.

    An error transform's translation is as long as the difference of the two
    relative translations, and its trace is the sum over the products of the two
    relative rotations' entries, so neither product is formed.
    """
    w = W.partitionBy(seq).orderBy(frame)
    step = poses.select(seq, pred, target, F.lead(pred).over(w).alias("pred1"), F.lead(target).over(w).alias("target1"))

    def relative(a: Column, b: Column) -> g.Cols:
        return g.matmul(g.invert_rigid(g.unpack(a, 16)), g.unpack(b, 16), 4)

    held, p = g.hold(step, "p", relative(F.col(pred), F.col("pred1")))
    held, t = g.hold(held, "t", relative(F.col(target), F.col("target1")))
    gap = g.norm([F.get(pred, F.lit(i)) - F.get(target, F.lit(i)) for i in (3, 7, 11)])
    moved = g.norm([p[i] - t[i] for i in (3, 7, 11)])
    trace = sum((p[4 * i + j] * t[4 * i + j] for i in range(3) for j in range(3)), F.lit(0.0))
    turn = F.acos(F.least(F.greatest((trace - 1.0) / 2.0, F.lit(-1.0)), F.lit(1.0)))
    return held.groupBy(seq).agg(F.avg(gap).alias("ate"), F.avg(moved).alias("rpe_t"), F.avg(F.degrees(turn)).alias("rpe_r"))


def mask_overlap(pixels: DataFrame, keys: Sequence[str], a: Column, b: Column) -> DataFrame:
    """IoU with 1e-6 on both sides, and the Dice loss with 1 on both sides."""
    inter, union = F.count_if(a & b), F.count_if(a | b)
    dice = 1.0 - (2.0 * inter + 1.0) / (F.count_if(a) + F.count_if(b) + 1.0)
    return pixels.groupBy(*keys).agg(((inter + 1e-6) / (union + 1e-6)).alias("iou"), dice.alias("dice_loss"))


def bootstrapped_loss(pixels: DataFrame, keys: Sequence[str], loss: str, top: float) -> DataFrame:
    """Mean of the hardest int(n * top) losses of each group; NULL for none.

    The losses above the one at that place are summed, and copies of it fill up
    the number: groups are few and large, so none of them is ranked.
    """
    keys = list(keys)
    limits = ranked_values(pixels, F.col(loss), keys, lambda n: n - int(n * top))
    above = F.col(loss) > F.col("value")
    sums = pixels.join(F.broadcast(limits), keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("value").alias("value"), F.count_if(above).alias("k"), F.coalesce(F.sum(F.when(above, F.col(loss))), F.lit(0.0)).alias("s"))
    most = F.floor(F.col("n") * top)
    return sums.select(*keys, F.try_divide(F.col("s") + (most - F.col("k")) * F.col("value"), most).alias("bootstrapped"))


def annealed_share(step: Column, start: int, end: int, least: float) -> Column:
    """The share of hardest losses: all until `start`, then falling evenly to `least` at `end`."""
    return F.when(step < start, F.lit(1.0)).when(step > end, F.lit(least)).otherwise(least + (1.0 - least) * (end - step) / (end - start))


def soft_aggregate(probs: DataFrame, pixel: Sequence[str], obj: str, p: str) -> DataFrame:
    """Background as the product of what objects leave, then a softmax over the logits of all; object 0 is the background."""
    held = lambda x: F.least(F.greatest(x, F.lit(1e-7)), F.lit(1 - 1e-7))
    w = W.partitionBy(*pixel)
    odds = lambda x: held(x) / (1.0 - held(x))
    left = F.exp(F.sum(F.ln(F.greatest(1.0 - F.col(p), F.lit(1e-300)))).over(w))
    rows = probs.withColumn("bg", left)
    total = F.sum(odds(F.col(p))).over(w) + odds(F.col("bg"))
    scored = rows.withColumn("total", total)
    objects = scored.select(*pixel, obj, (odds(F.col(p)) / F.col("total")).alias("prob"))
    background = scored.groupBy(*pixel).agg(F.first("bg").alias("bg"), F.first("total").alias("total")).select(*pixel, F.lit(0).alias(obj), (odds(F.col("bg")) / F.col("total")).alias("prob"))
    return objects.unionByName(background)


def ssim(images: DataFrame, size: int = 11, sigma: float = 1.5, k1: float = 0.01, k2: float = 0.03, data_range: float = 1.0) -> DataFrame:
    """`(frame, h, w, pred, target, mask)` -> `(frame, ssim)`: masked structural similarity, NULL for rasters smaller than a window.

    A blur is a product with banded matrices on either side, whole windows only:
    rows first, each window's sum over the mask's share of it, then columns over
    the share of windows with any mask.  The shares depend on the mask alone, so
    they are two weight rasters for the five blurs that the formula needs.

    Runs on Arrow batches in numpy, all rasters of one size at once.
    """
    import numpy as np
    import pandas as pd

    weights = np.exp(-0.5 * ((np.arange(size) - (size - 1) / 2) / sigma) ** 2)
    weights /= weights.sum()
    c1, c2 = (k1 * data_range) ** 2, (k2 * data_range) ** 2

    def banded(n: int, values: np.ndarray) -> np.ndarray:
        """n x (n - size + 1), a column for each window."""
        out = np.zeros((n, n - size + 1))
        for j in range(n - size + 1):
            out[j : j + size, j] = values
        return out

    def share(seen: np.ndarray) -> np.ndarray:
        return np.divide(size, seen, out=np.zeros_like(seen), where=seen > 0)

    def similarity(p: np.ndarray, t: np.ndarray, m: np.ndarray) -> np.ndarray:
        h, w = m.shape[1:]
        across, down = banded(w, weights), banded(h, weights).T
        rows = share(m @ banded(w, np.ones(size)))
        columns = share(banded(h, np.ones(size)).T @ (rows > 0))
        mean_p, mean_t, pp, tt, pt = (columns * (down @ (rows * ((x * m) @ across))) for x in (p, t, p * p, t * t, p * t))
        var_p, var_t = np.maximum(pp - mean_p**2, 0), np.maximum(tt - mean_t**2, 0)
        most = np.sqrt(var_p * var_t)
        cov = np.clip(pt - mean_p * mean_t, -most, most)
        likeness = (2 * mean_p * mean_t + c1) * (2 * cov + c2) / ((mean_p**2 + mean_t**2 + c1) * (var_p + var_t + c2))
        return likeness.mean((1, 2))

    def run(batches):
        for pdf in batches:
            out = pd.Series(np.nan, pdf.index, float)
            for (h, w), part in pdf.groupby(["h", "w"]):
                if min(h, w) >= size:
                    stack = lambda c, part=part, h=h, w=w: np.stack(part[c].to_numpy()).astype(float).reshape(-1, h, w)
                    out[part.index] = similarity(stack("pred"), stack("target"), stack("mask"))
            yield pd.DataFrame({"frame": pdf.frame, "ssim": out.astype(object).where(out.notna(), None)})

    return images.select("frame", "h", "w", "pred", "target", "mask").mapInPandas(run, "frame long, ssim double")
