"""Streaming queries, run to the end of what the driver tables hold."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import windows
from .bind import query, rounded, table


def _drained(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives for its present input, appended to a table in the shared folder batch by batch."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
    out = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(lambda df, _: df.write.mode("append").parquet(f"{out}/rows")).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/rows")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


@query("SELECT event_id // 100 AS win, user_id, round(sum(value), 4) AS grad_sum, count(*) AS vis_count, max(event_id % 23) AS max_radius FROM events GROUP BY ALL")
def stream_step_window(spark, sf_dir):
    rows = _drained(spark, windows.step_window_stream(_stream(spark, sf_dir, "events")), "update")
    return rounded(windows.latest(rows, ["win", "user_id"], "vis_count"), 4)
