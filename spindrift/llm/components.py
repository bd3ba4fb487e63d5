"""Connected components of a graph held as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .session import cut, discard, release

#: A key is hot if it has more rows than this, and than a thousandth of all.
HOT_ROWS = 10_000


def spread_join(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """`rows` joined with `found`, which has one row for each key and the key's number of `rows` in `n`, dropped afterwards.

    Rows of hot keys stay where they are: at most a thousand keys can be hot, so
    what `found` says of them is broadcast.
    """
    if total <= HOT_ROWS:
        return rows.join(found.drop("n"), key)
    limit = max(HOT_ROWS, total // 1000)
    hot = F.broadcast(found.where(F.col("n") > limit).drop("n"))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(found.where(F.col("n") <= limit).drop("n"), key))


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, the larger end first."""
    return edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """`(u, v)` links of longs -> `(u, v)` with v the smallest node that u reaches, for every u above it.

    Alternates two steps until nothing changes: every node's larger neighbours
    move to its smallest neighbour, then every node's smaller neighbours do.
    Both keep components whole and turn each into a star after about log n
    rounds.  A hub's smallest neighbour comes from a pre-aggregated minimum and
    is brought to its links by `spread_join`.  Each round is written to the
    shared folder; only a count and a checksum reach the driver.
    """
    edges = cut(_tidy(edges))
    release(edges.sparkSession)
    total, seen = edges.count(), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = _tidy(spread_join(both, least, "u", 2 * total).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        moved = spread_join(large, least, "u", total).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut(_tidy(moved.unionAll(least.select("u", F.col("m").alias("v")))))
        discard(last)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return edges
        total, seen = now[0], now
