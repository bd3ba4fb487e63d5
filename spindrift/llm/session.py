"""Session helpers: shared storage for cut lineage, sizes of partitions, table reading."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where it is unset, one of our own, which local mode alone can share."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spindrift-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a frame as a table in the shared folder and read it back: later stages neither recompute it nor depend on the executors that made it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/spindrift/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that `cut` wrote and that nothing will read again, other tables having been written from them."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.cut_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of frames that have been written as tables: it does so for what its driver no longer refers to."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(text: str = "text") -> list:
    """Columns that tell rows apart: rows alike in both are repeats of one another."""
    return [F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash")]


def boxed(docs: DataFrame) -> DataFrame:
    """`(row, text)` with all other columns inside `row`, so an operator's own columns never clash with them."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row"), F.col("text"))


def unboxed(df: DataFrame, docs: DataFrame, **new: Column) -> DataFrame:
    """The columns of `docs` again, those named in `new` with new values.

    New values are worked out under names of their own first: inside a lambda a
    column's name would otherwise mean the new column of that name.
    """
    held = df.withColumns({f"new_{c}": value for c, value in ({"text": F.col("text")} | new).items()})
    return held.select(*((F.col(f"new_{c}") if f"new_{c}" in held.columns else F.col("row").getField(c)).alias(c) for c in docs.columns))


def wider(df: DataFrame, ddl: str) -> T.StructType:
    """The schema of `df` with further columns."""
    return T.StructType([*df.schema.fields, *T._parse_datatype_string(ddl).fields])
