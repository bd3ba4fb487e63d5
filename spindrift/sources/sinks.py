"""Writers: checkpoints, tracks by query frame, metric logs, camera paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save_checkpoint(spark: SparkSession, folder: str, step: int, tables: dict[str, DataFrame]) -> None:
    """Every table of a model as Parquet, then the step: a folder without it is incomplete."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
    spark.range(1).select(F.lit(step).cast("long").alias("step"), F.lit(",".join(sorted(tables))).alias("tables")).write.mode("overwrite").parquet(f"{folder}/_meta")


def load_checkpoint(spark: SparkSession, folder: str, required: tuple[str, ...] = ()) -> tuple[int, dict[str, DataFrame]]:
    meta = spark.read.parquet(f"{folder}/_meta").first()
    names = meta.tables.split(",")
    missing = [n for n in required if n not in names]
    if missing:
        raise KeyError(f"checkpoint without {', '.join(missing)}")
    return meta.step, {n: spark.read.parquet(f"{folder}/{n}") for n in names}


def write_tracks(df: DataFrame, path: str) -> None:
    """2-D tracks in one folder for each query frame: readers of a frame open that alone."""
    df.repartition("query_t").write.mode("overwrite").partitionBy("query_t").parquet(path)


def read_tracks(spark: SparkSession, path: str, query_t: int, targets: list[int]) -> DataFrame:
    return spark.read.parquet(path).where((F.col("query_t") == query_t) & F.col("target_t").isin(targets))


def log_metrics(df: DataFrame, path: str) -> None:
    """Appends `(run, step, name, value)` rows."""
    df.select("run", "step", "name", "value").write.mode("append").parquet(path)


def write_camera_path(keyframes: DataFrame, path: str) -> None:
    """Key frames as JSON lines, in order."""
    keyframes.repartitionByRange(1, "idx").sortWithinPartitions("idx").write.mode("overwrite").json(path)


def write_new(df: DataFrame, path: str, keys: list[str]) -> None:
    """Appends the rows whose keys the table lacks, so a run that broke off can be repeated."""
    from ..operators.sampling import missing_work
    from .files import read_or_empty

    spark = df.sparkSession
    done = read_or_empty(spark, path, df.schema)
    missing_work(df, done, keys).write.mode("append").parquet(path)


def write_files(files: DataFrame, folder: str) -> None:
    """`(name, content)` rows as files below a folder of any file system, one after the other through the driver: for exports of small files."""
    context = files.sparkSession.sparkContext
    jvm = context._jvm.org.apache.hadoop.fs
    for row in files.select("name", F.col("content").cast("binary")).toLocalIterator():
        path = jvm.Path(f"{folder}/{row.name}")
        out = path.getFileSystem(context._jsc.hadoopConfiguration()).create(path, True)
        out.write(row.content)
        out.close()


def write_images(frames: DataFrame, folder: str, name: str, raster: str, bits: int = 8) -> None:
    """Packed rasters of values from 0 to 1 as grey PNG files of 8 or 16 bits."""
    import pandas as pd

    kind = f"u{bits // 8}"

    def run(batches):
        import numpy as np

        from ..functions.images import encode_png

        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                values = np.clip(np.asarray(r.v, float), 0, 1) * (2**bits - 1)
                rows.append((f"{r.n}.png", encode_png(np.rint(values).reshape(r.h, r.w).astype(kind))))
            yield pd.DataFrame(rows, columns=["name", "content"])

    rows = frames.select(F.col(name).cast("string").alias("n"), "h", "w", F.col(raster).alias("v"))
    write_files(rows.mapInPandas(run, "name string, content binary"), folder)


def write_arrays(arrays: DataFrame, folder: str) -> None:
    """`(file, name, shape, values)` rows as .npz files, one for each file, with an array for each name; a name of '' makes an .npy."""
    import pandas as pd

    def run(pdf):
        import io

        import numpy as np

        held = {r.name: np.asarray(r.values, float).reshape([int(n) for n in r.shape]) for r in pdf.itertuples(index=False)}
        out, file = io.BytesIO(), pdf.file.iloc[0]
        if list(held) == [""]:
            np.save(out, held[""])
        else:
            np.savez(out, **held)
        return pd.DataFrame([(f"{file}.npy" if list(held) == [""] else f"{file}.npz", out.getvalue())], columns=["name", "content"])

    write_files(arrays.select("file", "name", "shape", "values").groupBy("file").applyInPandas(run, "name string, content binary"), folder)


def write_keypoints(points: DataFrame, folder: str) -> None:
    """`(src_t, dst_t, kp_id, x, y, z)` as Parquet, a folder for each source time."""
    points.write.mode("overwrite").partitionBy("src_t").parquet(folder)


def write_reconstruction(cameras: DataFrame, intrinsics: DataFrame, folder: str, file: str = "recon") -> None:
    """One .npz of `cam_c2w` (frames, 4, 4) and `intrinsic` (3, 3), from `(frame, c2w)` and one row `(fx, fy, cx, cy)`."""
    poses = cameras.agg(F.count(F.lit(1)).alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("frame", "c2w"))), lambda s: s["c2w"])).alias("values"))
    zero, one = F.lit(0.0), F.lit(1.0)
    k = intrinsics.select(F.lit(file).alias("file"), F.lit("intrinsic").alias("name"), F.array(F.lit(3), F.lit(3)).cast("array<long>").alias("shape"), F.array("fx", zero, "cx", zero, "fy", "cy", zero, zero, one).alias("values"))
    c = poses.select(F.lit(file).alias("file"), F.lit("cam_c2w").alias("name"), F.array("n", F.lit(4).cast("long"), F.lit(4).cast("long")).alias("shape"), "values")
    write_arrays(c.unionByName(k), folder)


def write_config(spark: SparkSession, config: dict, folder: str, sources: str | None = None) -> None:
    """A run's settings as one line of JSON, and beside them the text of the program's files."""
    import json

    spark.createDataFrame([(json.dumps(config, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/config")
    if sources:
        text = spark.read.text(sources, wholetext=True, pathGlobFilter="*.py", recursiveFileLookup=True)
        text.select(F.input_file_name().alias("path"), "value").write.mode("overwrite").parquet(f"{folder}/sources")


def read_config(spark: SparkSession, folder: str) -> dict:
    import json

    return json.loads(spark.read.text(f"{folder}/config").first()[0])
