"""Scene operators: projection of tracks, blending of motion bases, camera paths, lifting of 2-D tracks."""

from __future__ import annotations

import math

import numpy as np

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions.raster import bilinear, pixel
from . import rasters, sampling, tracks


def project_points(points: DataFrame, cameras: DataFrame, on: list[str], dims: list[str], least_depth: float = 1e-5) -> DataFrame:
    """Adds `px`, `py`, `depth` of each point in its frame's camera `(fx, fy, cx, cy, w2c)`; the join's side is Spark's choice by size."""
    k = [F.col(c) for c in ("fx", "fy", "cx", "cy")]
    joined = points.join(cameras.select(*on, "fx", "fy", "cx", "cy", "w2c"), on)
    px, py, d = g.project([F.col(c) for c in dims], g.unpack(F.col("w2c"), 16), k, least_depth)
    return joined.withColumns({"px": px, "py": py, "depth": d}).drop("fx", "fy", "cx", "cy", "w2c")


def unproject_points(points: DataFrame, cameras: DataFrame, on: list[str], px: str = "px", py: str = "py", depth: str = "depth") -> DataFrame:
    """Adds the world point `x`, `y`, `z` of each pixel with depth."""
    k = [F.col(c) for c in ("fx", "fy", "cx", "cy")]
    joined = points.join(cameras.select(*on, "fx", "fy", "cx", "cy", "c2w"), on)
    world = g.unproject(F.col(px), F.col(py), F.col(depth), g.unpack(F.col("c2w"), 16), k)
    return joined.withColumns(dict(zip("xyz", world, strict=True))).drop("fx", "fy", "cx", "cy", "c2w")


def blend_bases(points: DataFrame, bases: DataFrame, coefs: str, id_: str) -> DataFrame:
    """`(id, t, rot, transl)`: softmaxed coefficients weigh the bases `(k, t, rot6, transl)`; rot is the matrix, row by row.

    Bases are packed to one array for each t, so the join has one row for each
    point and time and nothing is summed across rows.
    """
    packed = bases.groupBy("t").agg(F.array_sort(F.collect_list(F.struct("k", F.concat("rot6", "transl").alias("v")))).alias("b"))
    rows = points.select(id_, F.transform(coefs, lambda c: c.cast("double")).alias("c")).crossJoin(F.broadcast(packed))
    nine = F.aggregate(F.zip_with("c", "b", lambda c, b: F.transform(b["v"], lambda x: x * c)), F.array_repeat(F.lit(0.0), 9), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    held = rows.withColumn("v", nine)
    six = g.unpack(F.col("v"), 6)
    return held.select(id_, "t", g.pack(g.rot6_to_matrix(six)).alias("rot"), F.slice("v", 7, 3).alias("transl"))


def look_at_point(rays: DataFrame, origin: list[str], direction: list[str], keys: list[str] | None = None) -> DataFrame:
    """The point nearest to all rays in least squares, by its 3x3 normal equations summed in one pass."""
    d = g.unit([F.col(c) for c in direction])
    o = [F.col(c) for c in origin]
    m = [F.lit(1.0 if i == j else 0.0) - d[i] * d[j] for i in range(3) for j in range(3)]
    b = g.matvec(m, o)
    sums = rays.groupBy(*(keys or [])).agg(*(F.sum(c).alias(f"a{i}") for i, c in enumerate(m)), *(F.sum(c).alias(f"b{i}") for i, c in enumerate(b)))
    solved = g.solve3([F.col(f"a{i}") for i in range(9)], [F.col(f"b{i}") for i in range(3)])
    return sums.select(*(keys or []), *(c.alias(n) for n, c in zip("xyz", solved, strict=True)))


def mean_camera(cameras: DataFrame, w2c: str = "w2c") -> DataFrame:
    """One row, `w2c`: the mean of positions, viewing and up directions, made orthonormal."""
    m = g.unpack(F.col(w2c), 16)
    c2w = g.invert_rigid(m)
    parts = g.translation_of(c2w) + m[8:11] + m[4:7]
    mean = cameras.agg(*(F.avg(p).alias(f"p{i}") for i, p in enumerate(parts)))
    p = [F.col(f"p{i}") for i in range(9)]
    z = g.unit(p[3:6])
    x = g.unit(g.cross(p[6:9], z))
    y = g.cross(z, x)
    return mean.select(g.pack(g.invert_rigid(g.rigid(g.transpose([*x, *y, *z], 3), p[:3]))).alias("w2c"))


def look_at(df: DataFrame, position: g.Cols, target: g.Cols, up: g.Cols) -> tuple[DataFrame, g.Cols]:
    """The frame with held axes, and the world-to-camera matrix at `position` looking at `target`."""
    df, p = g.hold(df, "p", position)
    df, z = g.hold(df, "z", g.unit(g.sub(target, p)))
    df, x = g.hold(df, "x", g.unit(g.cross(g.unit(up), z)))
    df, y = g.hold(df, "y", g.cross(z, x))
    rot = [*x, *y, *z]
    return df, g.rigid(rot, [-v for v in g.matvec(rot, p)])


def _floats(v) -> g.Cols:
    return [F.lit(float(x)) for x in v]


def trajectory(spark: SparkSession, kind: str, frames: int, position, target, up, *, degrees: float = 30.0, radius: float = 1.0, turns: float = 2.0) -> DataFrame:
    """`(frame, w2c)` of a generated camera path that keeps looking at `target`.

    arc: turned about the up axis through the target by up to +-degrees / 2.
    lemniscate: a figure of eight in the plane across the view, spanning `degrees`.
    spiral: `turns` circles whose radius grows and shrinks, moving in depth too.
    wander: slow sums of sines about the start.
    """
    n = max(frames - 1, 1)
    rows = spark.range(frames).select(F.col("id").cast("int").alias("frame"), (F.col("id") / n).alias("s"))
    s, t = F.col("s"), _floats(target)
    # the starting frame is fixed, so its axes are plain numbers
    start, aim, u = np.array(position, float), np.array(target, float), np.array(up, float) / np.linalg.norm(up)
    away = start - aim
    if kind == "arc":
        a = (s - 0.5) * math.radians(degrees)
        side, along = np.cross(u, away), float(u @ away)
        place = [float(aim[i]) + float(away[i]) * F.cos(a) + float(side[i]) * F.sin(a) + float(u[i] * along) * (1 - F.cos(a)) for i in range(3)]
    else:
        z = -away / np.linalg.norm(away)
        x = np.cross(u, z) / np.linalg.norm(np.cross(u, z))
        y = np.cross(z, x)
        tau = 2 * math.pi
        if kind == "lemniscate":
            size = float(np.linalg.norm(away)) * math.tan(math.radians(degrees) / 2)
            d = 1 + F.sin(s * tau) ** 2
            shift = [size * F.cos(s * tau) / d, size * F.sin(s * tau) * F.cos(s * tau) / d, F.lit(0.0)]
        elif kind == "spiral":
            shift = [radius * F.sin(s * math.pi) * F.cos(s * tau * turns), radius * F.sin(s * math.pi) * F.sin(s * tau * turns), 0.5 * radius * F.sin(s * tau)]
        elif kind == "wander":
            shift = [radius * 0.5 * F.sin(s * tau), radius * 0.25 * F.sin(2 * s * tau), radius * 0.5 * (1 - F.cos(s * tau))]
        else:
            raise ValueError(f"no trajectory named {kind}")
        place = [float(start[i]) + shift[0] * float(x[i]) + shift[1] * float(y[i]) + shift[2] * float(z[i]) for i in range(3)]
    rows, w2c = look_at(rows, place, t, _floats(up))
    return rows.select("frame", g.pack(w2c).alias("w2c"))


def replay_times(df: DataFrame, index: str, length: int) -> DataFrame:
    """Adds `time`: the index, held at the last one."""
    return df.withColumn("time", F.least(F.col(index), F.lit(length - 1)))


def fixed_time(df: DataFrame, time: int, length: int) -> DataFrame:
    return df.withColumn("time", F.lit(max(0, min(time, length - 1))))


def relative_transforms(poses: DataFrame, seq: str, frame: str, w2c: str = "w2c") -> DataFrame:
    """Adds `relative`: from each pose to the next one, as 4x4."""
    from pyspark.sql import Window as W

    w = W.partitionBy(seq).orderBy(frame)
    held = poses.withColumn("_next", F.lead(w2c).over(w))
    a, b = g.unpack(F.col(w2c), 16), g.unpack(F.col("_next"), 16)
    return held.where(F.col("_next").isNotNull()).withColumn("relative", g.pack(g.matmul(b, g.invert_rigid(a), 4))).drop("_next")


def visible_centres(points: DataFrame, frames: DataFrame, least_opacity: float) -> DataFrame:
    """Points whose numbers are finite, in front of the camera, inside the frame, on its mask and opaque enough.

    `points` has `(frame, px, py, depth, opacity)`, `frames` `(frame, h, w, mask)`.
    """
    joined = points.join(frames.select("frame", "h", "w", "mask"), "frame")
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    inside = F.col("px").between(F.lit(0), F.col("w") - 1) & F.col("py").between(F.lit(0), F.col("h") - 1)
    masked = pixel(F.col("mask"), F.bround("px"), F.bround("py"), F.col("h"), F.col("w")) > 0
    kept = joined.where(finite("px") & finite("py") & finite("depth")).where((F.col("depth") > 1e-6) & inside).where(masked & (F.col("opacity") >= least_opacity))
    return kept.drop("h", "w", "mask")


def rendered_tracks(pixels: DataFrame, alpha: str, mask: str, track: str, least_alpha: float) -> DataFrame:
    """Pixels that are opaque enough, masked, and whose track `(array)` isn't all zeros."""
    return pixels.where((F.col(alpha) > least_alpha) & (F.col(mask) > 0) & F.exists(track, lambda v: v != 0))


def initial_gaussians(points: DataFrame, id_: str, dims: list[str], colours: list[str], cell: float, opacity: float = 0.7, seed: int = 0) -> DataFrame:
    """`(id, mean, log_scale, quat, colour_logit, opacity_logit)` from coloured points: scales by their neighbours' distance."""
    from ..functions.stats import logit
    from .fits import neighbour_scale
    from .paths import random_unit_quaternions

    scales = neighbour_scale(points, id_, dims, cell)
    held = random_unit_quaternions(points, id_, seed).join(scales, id_)
    inner = lambda c: F.least(F.greatest(F.col(c), F.lit(1e-6)), F.lit(1 - 1e-6))
    return held.select(
        id_, F.array(*dims).alias("mean"), F.array_repeat("log_scale", 3).alias("log_scale"), F.col("wxyz").alias("quat"),
        F.array(*(logit(inner(c)) for c in colours)).alias("colour_logit"), logit(F.lit(opacity)).alias("opacity_logit"),
    )


def replay(time: Column, length: int) -> Column:
    """The frame shown after `time`, beginning anew after the last one."""
    return F.pmod(time + 1, F.lit(length))


def lift_tracks(track2d: DataFrame, frames: DataFrame, cameras: DataFrame, length: int) -> DataFrame:
    """2-D tracks to 3-D: `(query_t, point_id, target_t, x, y, z, visible, invisible, confidence)` of the tracks that are valid.

    Depth is read between pixels with the nearest one beyond the edge; a point
    counts as inside where every mask pixel it touches is 1.  A track is valid if
    its query point is inside and it is seen often enough among its query's.
    Frames and cameras join by target frame; rasters stay packed, so the big side
    is never joined by pixel.
    """
    lookups = frames.select(F.col("frame").alias("target_t"), "h", "w", "depth", "mask")
    joined = track2d.join(lookups, "target_t")
    x, y, h, w = F.col("px"), F.col("py"), F.col("h"), F.col("w")
    seen = joined.withColumns({"depth_at": bilinear(F.col("depth"), x, y, h, w), "inside": bilinear(F.col("mask"), x, y, h, w, outside=0.0) == 1.0}).drop("depth", "mask", "h", "w")
    decoded = tracks.decode_visibility(seen, F.col("occ_logit"), F.col("dist_logit"))
    inside = F.col("inside")
    masked = decoded.withColumns({"visible": F.col("visible") & inside, "invisible": F.col("invisible") & inside, "confidence": F.when(inside, F.col("confidence")).otherwise(0.0)})
    counts = masked.groupBy("query_t", "point_id").agg(F.count_if("visible").alias("n"), F.bool_or(F.col("inside") & (F.col("target_t") == F.col("query_t"))).alias("query_inside"))
    limits = counts.groupBy("query_t").agg(F.least(F.lit(float(int(0.05 * length))), F.percentile("n", F.lit(0.1))).alias("limit"))
    valid = counts.join(limits, "query_t").where(F.col("query_inside") & (F.col("n") >= F.col("limit"))).select("query_t", "point_id")
    kept = masked.join(valid, ["query_t", "point_id"], "left_semi")
    cams = cameras.withColumnRenamed("frame", "target_t")
    world = unproject_points(kept, cams, ["target_t"], "px", "py", "depth_at")
    return world.select("query_t", "point_id", "target_t", "x", "y", "z", "visible", "invisible", "confidence")


def background_points(frames: DataFrame, cameras: DataFrame, per_frame: int, seed: int = 0) -> DataFrame:
    """`(frame, point_id, x, y, z)`: sampled pixels outside of the mask with a depth, in world coordinates."""
    rows = rasters.pixels(frames, ["frame"], depth=F.col("depth"), mask=F.col("mask"))
    free = rows.where("mask < 1 AND depth > 0").withColumn("point_id", (F.col("y") * F.col("w") + F.col("x")).cast("long"))
    picked = sampling.cap_by_hash(free, "frame", "point_id", per_frame, seed)
    world = unproject_points(picked.select("frame", "point_id", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.col("depth").cast("double").alias("depth")), cameras, ["frame"])
    return world.select("frame", "point_id", "x", "y", "z")


def keypoint_lift(keypoints: DataFrame, frames: DataFrame) -> DataFrame:
    """Adds `depth_at` and `valid`: depth between pixels, 0 beyond the edge, valid where the point is visible and all touched depths exist."""
    joined = keypoints.join(frames.select("frame", "h", "w", "depth"), "frame")
    x, y, h, w = F.col("px"), F.col("py"), F.col("h"), F.col("w")
    has = F.transform("depth", lambda d: (d != 0).cast("double"))
    held = joined.withColumns({"depth_at": bilinear(F.col("depth"), x, y, h, w, outside=0.0), "valid": F.col("visible") & (bilinear(has, x, y, h, w, outside=0.0) == 1.0)})
    return held.withColumn("depth_at", F.when(F.col("valid"), F.col("depth_at")).otherwise(0.0)).drop("depth", "h", "w")


def sample_channel(points: DataFrame, frames: DataFrame, raster: str, x: Column, y: Column) -> DataFrame:
    """Adds `sampled`, the raster between pixels at x, y."""
    joined = points.join(frames.select("frame", "h", "w", raster), "frame")
    return joined.withColumn("sampled", bilinear(F.col(raster), x, y, F.col("h"), F.col("w"))).drop(raster, "h", "w")


def nearest_pixel(points: DataFrame, frames: DataFrame, raster: str, x: Column, y: Column) -> DataFrame:
    joined = points.join(frames.select("frame", "h", "w", raster), "frame")
    return joined.withColumn("sampled", pixel(F.col(raster), F.bround(x), F.bround(y), F.col("h"), F.col("w"), outside=0.0)).drop(raster, "h", "w")


def uncovered_background(frames: DataFrame, cameras: DataFrame, seq: str = "seq", least: int = 64, by: int = 8, seed: int = 0) -> DataFrame:
    """`(seq, frame, x, y, z)`: background pixels of each frame outside of the box that earlier frames' points reproject to.

    `frames` has `(seq, frame, h, w, depth, mask)`, a mask below 0 being
    background; a frame that adds fewer than `least` pixels is skipped, of others
    max(n // by, least) are taken, by hashed order.  Which pixels a frame adds
    depends on all frames before it, so a sequence is folded in one task, frame
    by frame, on what was sampled so far; sequences run in parallel.
    """
    import pandas as pd

    def boxed(points: list, w2c: np.ndarray, k: np.ndarray, h: int, w: int) -> tuple[int, int, int, int]:
        x0, y0, x1, y1 = w, h, 0, 0
        for p in points:
            cam = p @ w2c[:3, :3].T + w2c[:3, 3]
            z = np.maximum(cam[:, 2], 1e-6)
            u, v = (k[0] * cam[:, 0] + k[2] * cam[:, 2]) / z, (k[1] * cam[:, 1] + k[3] * cam[:, 2]) / z
            x0, y0, x1, y1 = min(x0, int(u.min())), min(y0, int(v.min())), max(x1, int(u.max())), max(y1, int(v.max()))
        return max(0, x0), max(0, y0), min(w, x1), min(h, y1)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        points, out = [], []
        for r in pdf.sort_values("frame").itertuples():
            depth, mask = np.asarray(r.depth, float).reshape(r.h, r.w), np.asarray(r.mask, float).reshape(r.h, r.w)
            w2c, k = np.asarray(r.w2c, float).reshape(4, 4), np.array([r.fx, r.fy, r.cx, r.cy])
            free = (mask < 0) & (depth > 0)
            x0, y0, x1, y1 = boxed(points, w2c, k, r.h, r.w)
            free[y0:y1, x0:x1] = False
            y, x = np.nonzero(free)
            if len(x) < least:
                continue
            ids = y * r.w + x
            pick = np.sort(np.lexsort((ids, (ids * 742938285 + seed) % 2147483647))[: max(len(x) // by, least)])
            d = depth[y[pick], x[pick]]
            cam = np.stack([(x[pick] - k[2]) / k[0] * d, (y[pick] - k[3]) / k[1] * d, d], 1)
            world = (cam - w2c[:3, 3]) @ w2c[:3, :3]
            points.append(world)
            out.append(pd.DataFrame({seq: getattr(r, seq), "frame": r.frame, "x": world[:, 0], "y": world[:, 1], "z": world[:, 2]}))
        return pd.concat(out) if out else pd.DataFrame({seq: [], "frame": [], "x": [], "y": [], "z": []})

    joined = frames.select(seq, "frame", "h", "w", "depth", "mask").join(cameras.select(seq, "frame", "fx", "fy", "cx", "cy", "w2c"), [seq, "frame"])
    kind = frames.schema[seq].dataType.simpleString()
    return joined.groupBy(seq).applyInPandas(run, f"`{seq}` {kind}, frame long, x double, y double, z double")
