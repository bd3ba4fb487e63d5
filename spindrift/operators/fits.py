"""Fits: rigid alignment, neighbours, clustering, motion bases from clustered tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clamp
from . import robust
from .neighbours import nearest
from .quantiles import quantile_table

PAIR = [f"{a}{b}" for a in "xyz" for b in "xyz"]


def procrustes_sums(pairs: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """Weighted means and 3x3 covariance of `(x, y, z)` against `(tx, ty, tz)` by group, and either side's variance.

    Means are summed first and joined to the rows, so products are of deviations
    and keep their places however far from the origin the points are.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    src, dst = ("x", "y", "z"), ("tx", "ty", "tz")
    rows = pairs.select(*keys, w.alias("w"), *src, *dst)
    mean = lambda c: F.try_divide(F.sum(F.col("w") * c), F.sum("w"))
    means = rows.groupBy(*(F.col(k).alias(f"key_{k}") for k in keys)).agg(*(mean(F.col(c)).alias(f"m_{c}") for c in (*src, *dst)))
    if keys:
        on = [F.col(k).eqNullSafe(F.col(f"key_{k}")) for k in keys]
        both = rows.join(means, on).drop(*(f"key_{k}" for k in keys))
    else:
        both = rows.crossJoin(F.broadcast(means))
    held = both.select(*keys, "w", *(f"m_{c}" for c in (*src, *dst)), *((F.col(c) - F.col(f"m_{c}")).alias(c) for c in (*src, *dst)))
    square = lambda side: sum((F.col(c) * F.col(c) for c in side[1:]), F.col(side[0]) * F.col(side[0]))
    cov = [mean(F.col(a) * F.col(f"t{b}")).alias(f"c_{a}{b}") for a in src for b in src]
    return held.groupBy(*keys).agg(F.sum("w").alias("w"), *(F.first(f"m_{c}").alias(f"m_{c}") for c in (*src, *dst)), *cov, mean(square(src)).alias("var"), mean(square(dst)).alias("tvar"))


def procrustes(pairs: DataFrame, keys: list[str], weight: Column | None = None, scaled: bool = True) -> DataFrame:
    """`(keys, rot, transl, scale)` with target = scale * (rot * source + transl) by group.

    The scale is the ratio of the two sides' spreads, the rotation the best one
    in least squares.  Points are reduced to one row a group by Spark; only the
    singular value decomposition of its 3x3 matrix runs in numpy.
    """
    import numpy as np
    import pandas as pd

    sums = procrustes_sums(pairs, keys, weight)
    cov = [f"c_{p}" for p in PAIR]

    def run(batches):
        for pdf in batches:
            c = pdf[cov].to_numpy(float).reshape(-1, 3, 3)
            ok = np.isfinite(c).all((1, 2)) & (pdf["w"].to_numpy(float) > 0)
            u, _, vt = np.linalg.svd(np.where(ok[:, None, None], np.swapaxes(c, 1, 2), np.eye(3)))
            sign = np.ones((len(c), 3))
            sign[:, 2] = np.where(np.linalg.det(u) * np.linalg.det(vt) < 0, -1.0, 1.0)
            rot = (u * sign[:, None, :]) @ vt
            var, tvar = pdf["var"].to_numpy(float), pdf["tvar"].to_numpy(float)
            scale = np.where(var > 0, np.sqrt(tvar / np.where(var > 0, var, 1)), 1.0) if scaled else np.ones(len(c))
            a, b = pdf[["m_x", "m_y", "m_z"]].to_numpy(float), pdf[["m_tx", "m_ty", "m_tz"]].to_numpy(float)
            shift = b / np.where(scale == 0, 1, scale)[:, None] - np.einsum("nij,nj->ni", rot, a)
            out = pdf[keys].copy()
            out["rot"], out["transl"], out["scale"] = list(rot.reshape(-1, 9)), list(shift), scale
            yield pd.DataFrame(out)[ok]

    head = ", ".join(f"`{k}` {sums.schema[k].dataType.simpleString()}" for k in keys)
    return sums.mapInPandas(run, (head + ", " if head else "") + "rot array<double>, transl array<double>, scale double")


def aligned(pairs: DataFrame, fits: DataFrame, keys: list[str]) -> DataFrame:
    """Adds `residual`: the distance of each target from its fitted source."""
    src = [F.col(c) for c in "xyz"]
    rows = pairs.join(fits, keys)
    fitted = [F.col("scale") * (sum((F.get("rot", F.lit(3 * i + j)) * src[j] for j in range(1, 3)), F.get("rot", F.lit(3 * i)) * src[0]) + F.get("transl", F.lit(i))) for i in range(3)]
    gap = [F.col(f"t{c}") - f for c, f in zip("xyz", fitted, strict=True)]
    return rows.withColumn("residual", F.sqrt(sum((d * d for d in gap[1:]), gap[0] * gap[0])))


def nearest_neighbours(points: DataFrame, id_: str, dims: list[str], k: int, cell: float | None = None) -> DataFrame:
    """`(id, neighbour, distance, rank)`: exact k nearest, the smaller id first among equals.

    Boxes follow the points' density (see `operators.neighbours`); `cell`, the
    side of a grid that is no longer needed, never changed the result.
    """
    return nearest(points, id_, dims, k)


def neighbour_scale(points: DataFrame, id_: str, dims: list[str], cell: float, k: int = 3, low: float = 0.05, high: float = 0.95) -> DataFrame:
    """`(id, mean_distance, log_scale)`: mean distance of k neighbours, held between two quantiles, as a logarithm."""
    mean = nearest_neighbours(points, id_, dims, k, cell).groupBy(id_).agg(F.avg("distance").alias("mean_distance")).checkpoint()
    limits = quantile_table(mean, {"low": (F.col("mean_distance"), low), "high": (F.col("mean_distance"), high)})
    held = mean.crossJoin(F.broadcast(limits))
    return held.select(id_, "mean_distance", F.ln(F.greatest(F.least(F.greatest("mean_distance", "low"), F.col("high")), F.lit(1e-12))).alias("log_scale"))


def kmeans(df: DataFrame, id_: str, features: str, k: int, seed: int = 42) -> DataFrame:
    """`(id, label)` by k-means over an array column."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = df.select(id_, array_to_vector(features).alias("features"))
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="label").fit(rows)
    return model.transform(rows).select(id_, "label")


def motion_bases(obs: DataFrame, labels: DataFrame, canonical: int, frames: int) -> DataFrame:
    """`(label, t, rot, transl)`: each cluster's rigid motion from the canonical frame to every other.

    Points count where they are confident in both frames; a frame with under a
    tenth of the frames' number as total weight takes over the last fit met on
    the way out from the canonical one.
    """
    named = obs.join(labels, "track_id")
    base = named.where(F.col("t") == canonical).select("track_id", "label", "x", "y", "z", F.col("confidence").alias("c0"))
    pairs = base.join(named.select("track_id", "t", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"), "confidence"), "track_id")
    rows = pairs.withColumn("weight", F.col("c0") * F.col("confidence"))
    enough = rows.groupBy("label", "t").agg(F.sum("weight").alias("total"))
    fits = procrustes(rows, ["label", "t"], F.col("weight"), scaled=False)
    grid = enough.join(fits, ["label", "t"], "left")
    good = F.when(F.col("total") >= 0.1 * frames, F.struct("rot", "transl"))
    from .tracks import carry_outward

    carried = carry_outward(grid.withColumn("fit", good), F.col("fit"), F.lit(canonical), ["label"])
    return carried.select("label", "t", "carried.rot", "carried.transl")


def motion_logits(points: DataFrame, centres: DataFrame, id_: str, dims: list[str], sharpness: float = 10.0) -> DataFrame:
    """`(id, coef_logit)`: sharpness * exp(-distance) to every centre, in order of label; the centres are packed in one row."""
    packed = centres.agg(F.array_sort(F.collect_list(F.struct("label", *dims))).alias("centres"))
    far = lambda c: F.sqrt(sum(((F.col(d) - c[d]) ** 2 for d in dims[1:]), (F.col(dims[0]) - c[dims[0]]) ** 2))
    return points.crossJoin(F.broadcast(packed)).select(id_, F.transform("centres", lambda c: sharpness * F.exp(-far(c))).alias("coef_logit"))


def cluster_tracks(obs: DataFrame, k: int, least: int = 100) -> tuple[DataFrame, DataFrame]:
    """Labels of tracks by their directions, of clusters of more than `least`, and the clusters' centres at each label."""
    from .tracks import direction_vectors

    labels = kmeans(direction_vectors(obs, ["x", "y", "z"]), "track_id", "features", k)
    sizes = labels.groupBy("label").count().where(F.col("count") > least).select("label")
    labels = labels.join(sizes, "label").select("track_id", "label")
    centres = robust.cluster_centres(obs.join(labels, "track_id"), "label", ["x", "y", "z"])
    return labels, centres


def principal_colours(df: DataFrame, id_: str, features: str) -> DataFrame:
    """`(id, colour)`: first three principal components, each stretched to 0..1; a component's sign is arbitrary."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.select(id_, array_to_vector(features).alias("v"))
    parts = PCA(k=3, inputCol="v", outputCol="p").fit(rows).transform(rows).select(id_, vector_to_array("p").alias("p"))
    ends = parts.agg(*(f(F.get("p", F.lit(i))).alias(f"{n}{i}") for i in range(3) for n, f in (("low", F.min), ("high", F.max))))
    held = parts.crossJoin(F.broadcast(ends))
    return held.select(id_, F.array(*(clamp(F.try_divide(F.get("p", F.lit(i)) - F.col(f"low{i}"), F.col(f"high{i}") - F.col(f"low{i}")), 0.0, 1.0) for i in range(3))).alias("colour"))
