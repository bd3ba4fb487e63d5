"""Camera paths by key frames, schedules by step, and orders in which frames are visited."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def monotone_slopes(x, y):
    """Slopes at the knots of a piecewise cubic that never overshoots: weighted harmonic means of the neighbours' slopes, 0 at a turn."""
    import numpy as np

    h, d = np.diff(x), np.diff(y, axis=0)
    s = d / h.reshape(-1, *[1] * (np.ndim(y) - 1))
    if len(x) == 2:
        return np.concatenate([s, s])
    m = np.zeros_like(y, float)
    w1, w2 = (2 * h[1:] + h[:-1]).reshape(-1, *[1] * (np.ndim(y) - 1)), (h[1:] + 2 * h[:-1]).reshape(-1, *[1] * (np.ndim(y) - 1))
    same = s[:-1] * s[1:] > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        m[1:-1] = np.where(same, (w1 + w2) / (w1 / s[:-1] + w2 / s[1:]), 0.0)

    def end(h0, h1, s0, s1):
        v = ((2 * h0 + h1) * s0 - h0 * s1) / (h0 + h1)
        v = np.where(np.sign(v) != np.sign(s0), 0.0, v)
        return np.where((np.sign(s0) != np.sign(s1)) & (np.abs(v) > 3 * np.abs(s0)), 3 * s0, v)

    m[0], m[-1] = end(h[0], h[1], s[0], s[1]), end(h[-1], h[-2], s[-1], s[-2])
    return m


def hermite(x, y, m, at):
    import numpy as np

    i = np.clip(np.searchsorted(x, at, side="right") - 1, 0, len(x) - 2)
    h = x[i + 1] - x[i]
    t = (at - x[i]) / h
    col = lambda v: v.reshape(-1, *[1] * (np.ndim(y) - 1))
    t, h = col(t), col(h)
    return (2 * t**3 - 3 * t**2 + 1) * y[i] + (t**3 - 2 * t**2 + t) * h * m[i] + (3 * t**2 - 2 * t**3) * y[i + 1] + (t**3 - t**2) * h * m[i + 1]


def interpolate_path(keyframes: DataFrame, fps: float, tension: float = 0.0) -> DataFrame:
    """`(path, idx, seconds, position, wxyz, fov)` -> `(path, frame, time, position, wxyz, fov)` at `fps`.

    Seconds lead to the next key frame's index by a monotone cubic, so speed
    changes smoothly and never turns back.  Positions follow a cubic through the
    key frames whose tangents are damped by `tension`; orientations turn along
    great arcs, fields of view by the monotone cubic.  A path is a few key
    frames, so a group is one task's work.
    """
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        n = len(pdf)
        wait = pdf["seconds"].to_numpy(float)
        at = np.concatenate(([0.0], np.cumsum(wait[1:])))
        pos, quat = np.stack(pdf["position"].to_numpy()), np.stack(pdf["wxyz"].to_numpy())
        fov = pdf["fov"].to_numpy(float)
        frames = np.arange(max(1, int(at[-1] * fps)))
        if n == 1:
            u, p, q, f = np.zeros(len(frames)), pos[[0] * len(frames)], quat[[0] * len(frames)], fov[[0] * len(frames)]
        else:
            knots = np.arange(n, dtype=float)
            u = np.clip(hermite(at, knots, monotone_slopes(at, knots), frames / fps), 0, n - 1)
            slope = (1 - tension) * np.gradient(pos, axis=0)
            p, f = hermite(knots, pos, slope, u), hermite(knots, fov, monotone_slopes(knots, fov), u)
            quat = quat / np.linalg.norm(quat, axis=1, keepdims=True)
            for i in range(1, n):
                quat[i] *= 1 if quat[i] @ quat[i - 1] >= 0 else -1
            i = np.clip(u.astype(int), 0, n - 2)
            t = u - i
            angle = np.arccos(np.clip((quat[i] * quat[i + 1]).sum(1), -1, 1))
            flat = np.sin(angle) < 1e-9
            with np.errstate(divide="ignore", invalid="ignore"):
                a, b = np.where(flat, 1 - t, np.sin((1 - t) * angle) / np.sin(angle)), np.where(flat, t, np.sin(t * angle) / np.sin(angle))
            q = a[:, None] * quat[i] + b[:, None] * quat[i + 1]
        return pd.DataFrame({"path": pdf["path"].iloc[0], "frame": frames, "time": frames / fps, "position": list(p), "wxyz": list(q), "fov": f})

    return keyframes.select("path", "idx", "seconds", "position", "wxyz", "fov").groupBy("path").applyInPandas(run, f"path {keyframes.schema['path'].dataType.simpleString()}, frame long, time double, position array<double>, wxyz array<double>, fov double")


def exponential_schedule(df: DataFrame, step: str, start: float, end: float, steps: int) -> DataFrame:
    """Adds `rate`, falling by equal factors from `start` to `end` over `steps`, then staying."""
    t = F.least(F.col(step), F.lit(steps)) / steps
    return df.withColumn("rate", F.exp(t * math.log(end / start)) * start)


def both_ways(df: DataFrame, frame: str, start: int) -> DataFrame:
    """The frames as two runs out of `start`, `direction` 1 and -1 and `order` from 0; the start is in both."""
    ahead = df.where(F.col(frame) >= start).withColumns({"direction": F.lit(1), "order": F.col(frame) - start})
    back = df.where(F.col(frame) <= start).withColumns({"direction": F.lit(-1), "order": start - F.col(frame)})
    return ahead.unionByName(back)


def chunks(df: DataFrame, key: str, id_: str, size: int) -> DataFrame:
    """Adds `chunk`: parts of each key of nearly equal size, `size` at most."""
    w = W.partitionBy(key)
    ranked = df.withColumns({"_i": F.row_number().over(w.orderBy(id_)) - 1, "_n": F.count(F.lit(1)).over(w)})
    n = F.ceil(F.col("_n") / size)
    big = F.col("_n") % n
    each = F.floor(F.col("_n") / n)
    chunk = F.when(F.col("_i") < big * (each + 1), F.floor(F.col("_i") / (each + 1))).otherwise(big + F.floor((F.col("_i") - big * (each + 1)) / each))
    return ranked.withColumn("chunk", chunk.cast("long")).drop("_i", "_n")


def sequence_report(df: DataFrame, seq: str, metrics: list[str]) -> DataFrame:
    """Each sequence's mean metrics, and a row `(all)` with the unweighted mean of the sequences."""
    by = df.groupBy(F.col(seq).cast("string").alias(seq)).agg(*(F.avg(m).alias(m) for m in metrics))
    return by.unionByName(by.agg(*(F.avg(m).alias(m) for m in metrics)).withColumn(seq, F.lit("(all)")))


#: Multipliers that scatter well modulo the prime 2 ** 31 - 1.
SCATTER = (742938285, 950706376, 1226874159)


def random_unit_quaternions(df: DataFrame, id_: str, seed: int = 0) -> DataFrame:
    """Adds `wxyz`, spread evenly over rotations: three uniform numbers from the row's number, two circles whose radii add up to one sphere."""
    prime = 2147483647
    u = [(F.col(id_).cast("long") % prime * m + seed) % prime / float(prime) for m in SCATTER]
    a, b = F.sqrt(1 - u[0]), F.sqrt(u[0])
    tau = 2 * math.pi
    return df.withColumn("wxyz", F.array(a * F.sin(tau * u[1]), a * F.cos(tau * u[1]), b * F.sin(tau * u[2]), b * F.cos(tau * u[2])))


def resolution_ladder(height: int, width: int, lowest: int = 256, levels: int = 3, multiple: int = 8) -> list[tuple[int, int]]:
    """Sizes from near `lowest` up to the full one, by equal factors, as multiples."""
    small = min(1.0, lowest / min(height, width))
    factors = [small ** (1 - i / max(levels - 1, 1)) for i in range(levels)]
    size = lambda x, f: max(multiple, int(x * f / multiple + 0.5) * multiple)
    return [(size(height, f), size(width, f)) for f in factors]


def colour_lookup(df: DataFrame, value: Column, table: list[tuple[float, float, float]]) -> DataFrame:
    """Adds `colour`, the table's entry for a value from 0 to 1; NULL for none."""
    rows = F.array(*(F.array(*map(F.lit, c)) for c in table))
    at = F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * (len(table) - 1) + 0.5).cast("int")
    return df.withColumn("colour", F.get(rows, at))


def camera_axes(cameras: DataFrame, centre: list[str]) -> DataFrame:
    """One row, `(mean, axes)`: the centres' mean, and as rows of a rotation their principal axes, the widest first.

    The covariance is one aggregation; its eigenvectors are found in numpy.
    """
    import numpy as np
    import pandas as pd

    n = len(centre)
    sums = cameras.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(centre)), *(F.covar_pop(a, b).alias(f"c{i}{j}") for i, a in enumerate(centre) for j, b in enumerate(centre)))

    def run(batches):
        for pdf in batches:
            for _, r in pdf.iterrows():
                _, v = np.linalg.eigh(np.array([[r[f"c{i}{j}"] for j in range(n)] for i in range(n)], float))
                axes = v[:, ::-1].T.copy()
                # each axis points where its largest part is positive, and the axes are right-handed
                axes *= np.sign(axes[np.arange(n), np.abs(axes).argmax(1)])[:, None]
                if np.linalg.det(axes) < 0:
                    axes[-1] *= -1
                yield pd.DataFrame({"mean": [[r[f"m{i}"] for i in range(n)]], "axes": [axes.reshape(-1)]})

    return sums.mapInPandas(run, "mean array<double>, axes array<double>")
