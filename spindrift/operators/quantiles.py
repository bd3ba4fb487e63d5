"""Exact quantiles of any number of values, by histograms that close in on them.

Each pass counts values in bins between the bounds found so far, for all wanted
values at once, so tasks hold and send a few thousand counts where a percentile
aggregate would hold every distinct value of a group in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096


def _places(n: int, q: float, lower: bool) -> list[int]:
    """Ranks between which the quantile lies; one if it is a value, or the lower of two is asked for."""
    at = q * (n - 1)
    first = max(0, int(-(-q * n // 1)) - 1) if lower else int(at)
    return [first] if lower or at == int(at) else [first, first + 1]


def _close_in(rows: DataFrame, keys: list[str], bounds: dict) -> dict:
    """(key, name, rank) -> value, from (key, name, rank) -> (low, high, number of values below low)."""
    spark = rows.sparkSession
    kinds = [rows.schema[k].dataType for k in keys]
    found = {}
    while True:
        found |= {at: low for at, (low, high, _) in bounds.items() if not low < high}
        bounds = {at: b for at, b in bounds.items() if at not in found}
        if not bounds:
            return found
        each = max(64, BINS * 16 // len(bounds)) if len(bounds) > 16 else BINS
        ranges = sorted({(*key, name, low, high) for (key, name, _), (low, high, _) in bounds.items()}, key=str)
        schema = ", ".join([*(f"`k{i}` {t.simpleString()}" for i, t in enumerate(kinds)), "wanted string, low double, high double"])
        table = F.broadcast(spark.createDataFrame(ranges, schema))
        on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"k{i}")) for i, k in enumerate(keys)), F.col("name") == F.col("wanted"))
        inside = rows.join(table, on).where(F.col("value").between(F.col("low"), F.col("high")))
        width = (F.col("high") - F.col("low")) / each
        bin_ = F.least(F.floor(F.try_divide(F.col("value") - F.col("low"), width)), F.lit(each - 1))
        counts = inside.groupBy(*(f"k{i}" for i in range(len(keys))), "name", "low", "high", F.coalesce(bin_, F.lit(0)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))
        bins: dict = {}
        for r in counts.collect():
            bins.setdefault((tuple(r[: len(keys)]), r["name"], r["low"], r["high"]), []).append((r["bin"], r["n"], r["least"], r["most"]))
        for at, (low, high, below) in bounds.items():
            for _, n, least, most in sorted(bins[(*at[:2], low, high)]):
                if below + n > at[2]:
                    # a bin that is as wide as its range is cut no further: its values differ in their last places alone
                    bounds[at] = (least, most, below) if (least, most) != (low, high) or len(bins[(*at[:2], low, high)]) > 1 else (least, least, below)
                    break
                below += n


def _found(df: DataFrame, wanted: dict[str, Column], keys: list[str], places: Callable[[str, int], list[int]]) -> dict[tuple, dict[str, tuple[int, list[float]]]]:
    """key -> name -> number of values, and those at `places(name, number)`; NULL and NaN are no values."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("name"), x.cast("double").alias("value")) for name, x in wanted.items())))
    rows = df.select(*keys, each.alias("x")).select(*keys, "x.name", "x.value").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        held = F.when(~F.isnan("value"), F.col("value"))
        sizes = rows.groupBy(*keys, "name").agg(F.count(held).alias("n"), F.min(held).alias("low"), F.max(held).alias("high")).collect()
        chosen = {(tuple(r[: len(keys)]), r["name"]): places(r["name"], r["n"]) if r["n"] else [] for r in sizes}
        bounds = {(*at, place): (r["low"], r["high"], 0) for r in sizes for at in [(tuple(r[: len(keys)]), r["name"])] for place in chosen[at]}
        values = _close_in(rows, keys, bounds)
    finally:
        rows.unpersist()
    out: dict[tuple, dict] = {}
    for r in sizes:
        at = (tuple(r[: len(keys)]), r["name"])
        out.setdefault(at[0], {})[at[1]] = (r["n"], [values[*at, place] for place in chosen[at]])
    return out


def quantile_values(df: DataFrame, wanted: dict[str, tuple[Column, float]], keys: list[str] | None = None, lower: bool = False) -> dict[tuple, dict[str, float | None]]:
    """key -> name -> quantile of the name's column among the key's rows; None for no values.

    A quantile lies at q (n - 1) and is interpolated, or with `lower` is the
    smallest value that a share q of all reach.  Keys are few by contract: what
    is known of each comes to the driver.
    """
    found = _found(df, {n: x for n, (x, _) in wanted.items()}, keys or [], lambda name, n: _places(n, wanted[name][1], lower))

    def between(name: str, n: int, values: list[float]) -> float | None:
        share = wanted[name][1] * (n - 1) % 1 if len(values) > 1 else 0.0
        return values[0] + (values[-1] - values[0]) * share if values else None

    return {key: {name: between(name, *held) for name, held in names.items()} for key, names in found.items()}


def ranked_values(df: DataFrame, x: Column, keys: list[str], place: Callable[[int], int]) -> DataFrame:
    """`(keys, n, value)`: each key's number of values, and the one with `place(n)` smaller or equal ones before it; NULL for a place below 0 or beyond."""
    found = _found(df, {"x": x}, keys, lambda _, n: [place(n)] if 0 <= place(n) < n else [])
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "n long", "value double"])
    return df.sparkSession.createDataFrame([(*key, n, values[0] if values else None) for key, names in found.items() for n, values in [names["x"]]], schema)


def quantile_table(df: DataFrame, wanted: dict[str, tuple[Column, float]], keys: list[str] | None = None, lower: bool = False) -> DataFrame:
    """The same as a table of one row for each key, small by contract: callers broadcast it."""
    keys = keys or []
    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), *(f"`{n}` double" for n in wanted)])
    found = quantile_values(df, wanted, keys, lower)
    rows = [(*key, *(values.get(n) for n in wanted)) for key, values in found.items()] or ([] if keys else [(None,) * len(wanted)])
    return df.sparkSession.createDataFrame(rows, schema)


def medians(df: DataFrame, wanted: dict[str, Column], keys: list[str] | None = None, lower: bool = False) -> DataFrame:
    return quantile_table(df, {n: (x, 0.5) for n, x in wanted.items()}, keys, lower)
