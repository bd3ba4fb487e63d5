"""Operators on frames that hold packed rasters; neighbours are read inside the array, so pixels are never exchanged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.raster import pixel
from .quantiles import medians, quantile_table


def pixels(frames: DataFrame, keys: list[str], **rasters: Column) -> DataFrame:
    """`(keys, y, x, ...)` rows of all rasters of a frame of h x w."""
    zipped = F.arrays_zip(*(r.alias(n) for n, r in rasters.items()))
    rows = frames.select(*keys, "h", "w", F.posexplode(zipped).alias("i", "p"))
    return rows.select(*keys, F.floor(F.col("i") / F.col("w")).cast("int").alias("y"), (F.col("i") % F.col("w")).alias("x"), "h", "w", *(F.col(f"p.{n}").alias(n) for n in rasters))


def point_map(frames: DataFrame, depth: str, k: g.Cols) -> Column:
    """Camera-space points of every pixel of a depth raster, as an array of structs."""
    w = F.col("w")

    def one(d: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        return F.struct(((x - k[2]) / k[0] * d).alias("x"), ((y - k[3]) / k[1] * d).alias("y"), d.cast("double").alias("z"))

    return F.transform(depth, one)


def normals(frames: DataFrame, depth: str, k: g.Cols) -> DataFrame:
    """Adds `normals`: cross product of the steps left to right and bottom to top, of unit length; zero on the border."""
    held = frames.withColumn("_points", point_map(frames, depth, k))
    w, h, p = F.col("w"), F.col("h"), F.col("_points")

    def vec(i: Column) -> g.Cols:
        q = F.get(p, i.cast("int"))
        return [q["x"], q["y"], q["z"]]

    def one(_: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        inner = (x > 0) & (y > 0) & (x < w - 1) & (y < h - 1)
        n = g.unit(g.cross(g.sub(vec(i + 1), vec(i - 1)), g.sub(vec(i - w), vec(i + w))), 1e-12)
        return F.struct(*(F.when(inner, c).otherwise(0.0).alias(f"n{a}") for a, c in zip("xyz", n, strict=True)))

    return held.withColumn("normals", F.transform(p, one)).drop("_points")


def unit_points(depth: str) -> Column:
    """Every pixel's place from 0 to 1 across the raster, with its depth, as an array of structs."""
    w, h = F.col("w"), F.col("h")
    return F.transform(depth, lambda d, i: F.struct((i % w / (w - 1.0)).alias("x"), (F.floor(i / w) / (h - 1.0)).alias("y"), d.cast("double").alias("z")))


def world_point_map(frames: DataFrame, depth: str, k: g.Cols, c2w: g.Cols) -> Column:
    """World points of every pixel of a depth raster."""

    def one(p: Column) -> Column:
        return F.struct(*(c.alias(n) for n, c in zip("xyz", g.apply_rigid(c2w, [p["x"], p["y"], p["z"]]), strict=True)))

    return F.transform(point_map(frames, depth, k), one)


def surface_normals(frames: DataFrame, depth: str, focal: tuple[float, float], c2w: g.Cols) -> DataFrame:
    """Adds `normals` of a rendered depth raster in world axes: rays through the raster's middle, the step down crossed with the step right; zero on the border."""
    w, h = F.col("w"), F.col("h")
    k = [F.lit(focal[0]), F.lit(focal[1]), w / 2.0, h / 2.0]
    held = frames.withColumn("_points", world_point_map(frames, depth, k, c2w))

    def vec(i: Column) -> g.Cols:
        q = F.get("_points", i.cast("int"))
        return [q["x"], q["y"], q["z"]]

    def one(_: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        inner = (x > 0) & (y > 0) & (x < w - 1) & (y < h - 1)
        n = g.unit(g.cross(g.sub(vec(i + w), vec(i - w)), g.sub(vec(i + 1), vec(i - 1))), 1e-12)
        return F.struct(*(F.when(inner, c).otherwise(0.0).alias(f"n{a}") for a, c in zip("xyz", n, strict=True)))

    return held.withColumn("normals", F.transform("_points", one)).drop("_points")


def gradient_loss(frames: DataFrame, pred: str, target: str, mask: str, q: float = 0.98) -> DataFrame:
    """Trimmed mean of the differences of x- and of y-gradients over pixels masked at both ends, added up."""
    w = F.col("w")

    def pairs(step: Column, ok) -> Column:
        at = lambda a, i: F.get(F.col(a), i.cast("int")).cast("double")
        each = F.transform(F.sequence(F.lit(0), w * F.col("h") - 1), lambda i: F.when(ok(i) & F.get(mask, i) & F.get(mask, (i + step).cast("int")), F.abs((at(pred, i + step) - at(pred, i)) - (at(target, i + step) - at(target, i)))))
        return F.filter(each, F.isnotnull)

    along_x = frames.select(F.explode(pairs(F.lit(1), lambda i: i % w < w - 1)).alias("l"), F.lit("x").alias("axis"))
    along_y = frames.select(F.explode(pairs(w, lambda i: i < w * (F.col("h") - 1))).alias("l"), F.lit("y").alias("axis"))
    both = along_x.unionAll(along_y)
    limits = quantile_table(both, {"limit": (F.col("l"), q)}, ["axis"])
    return both.join(F.broadcast(limits), "axis").where("l < limit").groupBy("axis").agg(F.avg("l").alias("m")).agg(F.sum("m").alias("loss"))


def reflected(c: Column, size: Column) -> Column:
    """Index beyond an edge mirrored at the edge pixel."""
    c = F.abs(c)
    return F.when(c >= size, 2 * (size - 1) - c).otherwise(c)


def median_filter(frames: DataFrame, raster: str, size: int, out: str = "filtered") -> DataFrame:
    """Adds the raster of lower medians of size x size windows, mirrored at the edges."""
    w, h, reach = F.col("w"), F.col("h"), size // 2
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

    def one(_: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        near = F.array(*(F.get(raster, (reflected(y + dy, h) * w + reflected(x + dx, w)).cast("int")) for dy, dx in steps))
        return F.get(F.array_sort(near), F.lit((size * size - 1) // 2)).cast("double")

    return frames.withColumn(out, F.transform(raster, one))


def masked_median(frames: DataFrame, raster: str, mask: str, size: int, out: str = "filtered") -> DataFrame:
    """Adds lower medians over the valid pixels of each window; windows beyond the raster are cut, empty ones give 0."""
    w, h, reach = F.col("w"), F.col("h"), size // 2
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

    def one(_: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)

        def near(dy: int, dx: int) -> Column:
            at = ((y + dy) * w + x + dx).cast("int")
            inside = (x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h)
            return F.when(inside & F.get(mask, at), F.get(raster, at).cast("double"))

        valid = F.array_sort(F.filter(F.array(*(near(*s) for s in steps)), F.isnotnull))
        return F.coalesce(F.get(valid, F.floor((F.size(valid) - 1) / 2).cast("int")), F.lit(0.0))

    return frames.withColumn(out, F.transform(raster, one))


def filled_median(frames: DataFrame, raster: str, mask: str, size: int, out: str = "filtered") -> DataFrame:
    """Adds lower medians of whole windows whose invalid entries, those beyond the raster among them, are set in turn to the least and the greatest value.

    Turns go on through a frame, window by window.  Beyond the raster a value
    counts as 0.  Whole rasters at a time in numpy.
    """
    import numpy as np
    import pandas as pd

    def one(h: int, w: int, values, valid) -> np.ndarray:
        reach = size // 2
        view = lambda a: np.lib.stride_tricks.sliding_window_view(np.pad(np.asarray(a, float).reshape(h, w), reach), (size, size)).reshape(-1, size * size)
        near, known = view(values).copy(), view(valid) != 0
        turn = np.cumsum(~known.reshape(-1)).reshape(known.shape) % 2
        low, high = near.min(), near.max()
        near[~known] = np.where(turn[~known] == 1, low, high)
        return np.sort(near, axis=1)[:, (size * size - 1) // 2]

    def run(batches):
        for pdf in batches:
            pdf[out] = [one(*r) for r in zip(pdf.h, pdf.w, pdf[raster], pdf[mask], strict=True)]
            yield pdf

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema if f.name != out) + f", `{out}` array<double>"
    return frames.select(*(c for c in frames.columns if c != out)).mapInPandas(run, schema)


def erode_to_tristate(frames: DataFrame, mask: str, size: int = 3, out: str = "tristate") -> DataFrame:
    """Adds +1 where the whole window is foreground, -1 where all of it is background, else 0; beyond the edge counts as either."""
    w, h, reach = F.col("w"), F.col("h"), size // 2
    steps = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]

    def one(_: Column, i: Column) -> Column:
        x, y = i % w, F.floor(i / w)
        near = [F.when((x + dx >= 0) & (x + dx < w) & (y + dy >= 0) & (y + dy < h), F.get(mask, ((y + dy) * w + x + dx).cast("int"))) for dy, dx in steps]
        known = F.filter(F.array(*near), F.isnotnull)
        return F.when(F.forall(known, lambda v: v), 1).when(~F.exists(known, lambda v: v), -1).otherwise(0)

    return frames.withColumn(out, F.transform(mask, one))


def disparity_to_depth(raster: Column, low: float = 1e-6, high: float = 1e6) -> Column:
    return F.transform(raster, lambda d: 1.0 / F.least(F.greatest(d.cast("double"), F.lit(low)), F.lit(high)))


def clamp_depth(frames: DataFrame, depth: str, factor: float = 2.5) -> DataFrame:
    """Depths held to `factor` times the lower median of the frames' largest depths."""
    tops = medians(frames, {"limit": F.array_max(depth)}, lower=True)
    return frames.crossJoin(F.broadcast(tops)).withColumn(depth, F.transform(depth, lambda d: F.least(d, F.col("limit") * factor))).drop("limit")


def quantise_uint16(raster: Column) -> Column:
    """Values stretched to 0..65535 and floored; a constant raster is 0."""
    low, high = F.array_min(raster), F.array_max(raster)
    return F.transform(raster, lambda v: F.when(high > low, F.floor((v - low).cast("double") / (high - low).cast("double") * 65535.0)).otherwise(F.lit(0)).cast("int"))


def zero_small(df: DataFrame, value: str, floor: float = 1e-6, q: float = 0.01) -> DataFrame:
    """Values under the lesser of `floor` and the q-quantile become 0."""
    limit = quantile_table(df, {"q": (F.col(value), q)}).select(F.least(F.lit(floor), F.col("q")).alias("limit"))
    return df.crossJoin(F.broadcast(limit)).withColumn(value, F.when(F.col(value) < F.col("limit"), 0.0).otherwise(F.col(value))).drop("limit")


def consistent(df: DataFrame, frame: str, count: str, disparity: str, least: int = 2, share: float = 0.5) -> DataFrame:
    """Rows seen from `least` frames or more whose disparity exceeds `share` times their frame's mean."""
    means = df.groupBy(frame).agg(F.avg(disparity).alias("mean"))
    return df.join(means, frame).where((F.col(count) >= least) & (F.col(disparity) > share * F.col("mean"))).drop("mean")


def crop_to_multiple(frames: DataFrame, raster: str, m: int) -> DataFrame:
    """Rasters cut at the right and the bottom to multiples of m."""
    w, nh, nw = F.col("w"), (F.col("h") - F.col("h") % m), (F.col("w") - F.col("w") % m)
    kept = F.filter(F.transform(raster, lambda v, i: F.when((i % w < nw) & (F.floor(i / w) < nh), F.struct(v.alias("v")))), F.isnotnull)
    return frames.withColumn(raster, F.transform(kept, lambda s: s["v"])).withColumns({"h": nh, "w": nw})


def pad_to_multiple(frames: DataFrame, raster: str, m: int, value: float = 0.0) -> DataFrame:
    """Rasters grown on all sides to multiples of m, the right and the bottom by one more where it must be; `top` and `left` tell by how much."""
    w, h = F.col("w"), F.col("h")
    grow = lambda n: F.pmod(-n, F.lit(m))
    held = frames.withColumns({"top": F.floor(grow(h) / 2).cast("int"), "left": F.floor(grow(w) / 2).cast("int"), "_h": (h + grow(h)).cast("int"), "_w": (w + grow(w)).cast("int")})

    def at(i: Column) -> Column:
        x, y = i % F.col("_w") - F.col("left"), F.floor(i / F.col("_w")) - F.col("top")
        return F.when((x >= 0) & (y >= 0) & (x < w) & (y < h), F.get(raster, (y * w + x).cast("int"))).otherwise(F.lit(value))

    padded = held.withColumn("_v", F.transform(F.sequence(F.lit(0), F.col("_h") * F.col("_w") - 1), at))
    return padded.withColumns({raster: F.col("_v"), "h": F.col("_h"), "w": F.col("_w")}).drop("_v", "_h", "_w")


def unpadded(frames: DataFrame, raster: str, h: int, w: int) -> DataFrame:
    """What `pad_to_multiple` was given, of h x w."""
    at = F.sequence(F.lit(0), F.lit(h * w - 1))
    inner = F.transform(at, lambda i: F.get(raster, ((F.floor(i / w) + F.col("top")) * F.col("w") + i % w + F.col("left")).cast("int")))
    return frames.withColumn(raster, inner).withColumns({"h": F.lit(h), "w": F.lit(w)}).drop("top", "left")


def soft_argmax(frames: DataFrame, heat: str, radius: float = 5.0) -> DataFrame:
    """Adds `x`, `y`: the mean place of the pixels within `radius` of the largest value, by their values."""
    w = F.col("w")
    top = F.array_position(heat, F.array_max(heat)).cast("int") - 1
    held = frames.withColumn("_top", top)
    tx, ty = F.col("_top") % w, F.floor(F.col("_top") / w)
    near = F.filter(F.transform(heat, lambda v, i: F.when((i % w - tx) ** 2 + (F.floor(i / w) - ty) ** 2 < radius * radius, F.struct(v.cast("double").alias("v"), (i % w).cast("double").alias("x"), F.floor(i / w).cast("double").alias("y")))), F.isnotnull)
    add = lambda f: F.aggregate("_near", F.lit(0.0), lambda a, s: a + f(s))
    total = F.greatest(add(lambda s: s["v"]), F.lit(1e-12))
    return held.withColumn("_near", near).withColumns({"x": add(lambda s: s["v"] * s["x"]) / total, "y": add(lambda s: s["v"] * s["y"]) / total}).drop("_top", "_near")


def value_at(raster: str, x: Column, y: Column) -> Column:
    return pixel(F.col(raster), x, y, F.col("h"), F.col("w"))
