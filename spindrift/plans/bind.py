"""Registration of queries, and the driver tables in the shapes that operators take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL of the same rows."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, places: int = 5) -> DataFrame:
    """Doubles to a number of places, as sums depend on their order in the last ones."""
    return df.select(*(F.round(F.col(c), places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def track_order() -> W:
    return W.partitionBy("track_id").orderBy("t")


def track_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as tracks: `(track_id, t, x, y, z, visible, kind, event_id)`, t counting from 0."""
    e = table(spark, sf_dir, "events")
    t = (F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long")
    return e.select(
        F.col("user_id").alias("track_id"), t.alias("t"), F.col("value").alias("x"), (F.col("value") * 0.5 + F.col("event_id") % 17).alias("y"),
        (4.0 + F.col("event_id") % 5).alias("z"), (F.col("event_type") != "error").alias("visible"), F.col("event_type").alias("kind"), "event_id",
    )


TRACKS_SQL = """tracks AS (
  SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value AS x,
    value * 0.5 + event_id % 17 AS y, 4.0::DOUBLE + event_id % 5 AS z, event_type <> 'error' AS visible, event_type AS kind, event_id
  FROM events)"""


def embedding_dims(n: int, start: int = 0) -> list[Column]:
    return [F.get("embedding", F.lit(start + i)).cast("double").alias(f"e{i}") for i in range(n)]


def embedding_sql(n: int, start: int = 0) -> str:
    return ", ".join(f"embedding[{start + i + 1}]::DOUBLE AS e{i}" for i in range(n))
