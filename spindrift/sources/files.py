"""Readers of capture folders: splits, cameras, trajectories, arrays, images, keypoints."""

from __future__ import annotations

import io
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g


def read_split(spark: SparkSession, path: str, start: int = 0, end: int | None = None) -> DataFrame:
    """`(frame_name, time_id, t)` of a split file, times from `start` to before `end`, t counting from `start`."""
    pairs = spark.read.schema("frame_names array<string>, time_ids array<int>").json(path, multiLine=True)
    rows = pairs.select(F.explode(F.arrays_zip("frame_names", "time_ids")).alias("p")).select(F.col("p.frame_names").alias("frame_name"), F.col("p.time_ids").alias("time_id"))
    rows = rows.where(F.col("time_id") >= start)
    rows = rows if end is None else rows.where(F.col("time_id") < end)
    return rows.withColumn("t", F.col("time_id") - start)


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[^./]*)?$", 1)


def read_json_cameras(spark: SparkSession, path: str, factor: float = 1.0) -> DataFrame:
    """`(name, fx, fy, cx, cy, w2c, c2w)`: intrinsics over `factor`, translation as minus the rotated position."""
    schema = "focal_length double, principal_point array<double>, orientation array<array<double>>, position array<double>"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("name", stem(F.input_file_name()))
    rot = [F.get(F.get("orientation", F.lit(i)), F.lit(j)) for i in range(3) for j in range(3)]
    w2c = g.rigid(rot, [-x for x in g.matvec(rot, g.unpack(F.col("position"), 3))])
    f = F.col("focal_length") / factor
    centre = [F.get("principal_point", F.lit(i)) / factor for i in range(2)]
    return raw.select("name", f.alias("fx"), f.alias("fy"), centre[0].alias("cx"), centre[1].alias("cy"), g.pack(w2c).alias("w2c"), g.pack(g.invert_rigid(w2c)).alias("c2w"))


def read_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """`(frame, time, c2w, w2c)` of lines `time tx ty tz qx qy qz qw`, relative to the middle frame."""
    schema = "time double, tx double, ty double, tz double, qx double, qy double, qz double, qw double"
    rows = spark.read.schema(schema).csv(path, sep=" ", comment="#")
    # a trajectory is one array of its times: a line's place in it is its number
    times = rows.agg(F.sort_array(F.collect_list("time")).alias("times"))
    numbered = rows.crossJoin(F.broadcast(times)).withColumn("frame", F.array_position("times", F.col("time")).cast("int") - 1).drop("times")
    held, q = g.hold(numbered, "q", [F.col(c) for c in ("qw", "qx", "qy", "qz")])
    posed = held.select("frame", "time", g.pack(g.rigid(g.quat_to_matrix(q), [F.col(c) for c in ("tx", "ty", "tz")])).alias("m"))
    middle = posed.agg(F.floor(F.count("*") / 2).alias("mid")).join(posed, F.col("frame") == F.col("mid")).select(F.col("m").alias("m0"))
    both = posed.crossJoin(F.broadcast(middle))
    both, c2w = g.hold(both, "c", g.matmul(g.invert_rigid(g.unpack(F.col("m0"), 16)), g.unpack(F.col("m"), 16), 4))
    return both.select("frame", "time", g.pack(c2w).alias("c2w"), g.pack(g.invert_rigid(c2w)).alias("w2c"))


def read_arrays(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """`(path, name, shape, values)` of numpy files: an .npy's one array, or an .npz's arrays of the first of `keys` it has, all if None."""
    import pandas as pd

    def run(batches):
        import numpy as np

        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                loaded = np.load(io.BytesIO(content), allow_pickle=False)
                arrays = {"": loaded} if isinstance(loaded, np.ndarray) else {k: loaded[k] for k in loaded.files}
                if keys is not None and "" not in arrays:
                    found = [k for k in keys if k in arrays]
                    if not found:
                        raise KeyError(f"{p} has none of {keys}")
                    arrays = {found[0]: arrays[found[0]]}
                rows += [(p, k, list(a.shape), a.astype(float).reshape(-1)) for k, a in arrays.items()]
            yield pd.DataFrame(rows, columns=["path", "name", "shape", "values"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, name string, shape array<long>, values array<double>")


def split_leading(arrays: DataFrame, name: str = "frame") -> DataFrame:
    """One row for each index of the arrays' first dimension."""
    rest = F.aggregate(F.slice("shape", F.lit(2), F.size("shape") - 1), F.lit(1).cast("long"), lambda a, n: a * n)
    rows = arrays.withColumn("_n", rest).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.get("shape", F.lit(0)) - 1)))
    return rows.select("path", F.col(name), F.slice("shape", F.lit(2), F.size("shape") - 1).alias("shape"), F.slice("values", (F.col(name) * F.col("_n") + 1).cast("int"), F.col("_n").cast("int")).alias("values"))


# Names under which such files keep each kind of array.
POSE_KEYS, INTRINSIC_KEYS, DEPTH_KEYS = ["cam_c2w", "c2w", "poses", "camera_poses"], ["intrinsic", "intrinsics", "K"], ["depths", "depth"]


def intrinsics_vector(arrays: DataFrame, width: float, height: float) -> DataFrame:
    """`(fx, fy, cx, cy)` of 3x3 or 4-vector intrinsics, the median over frames; numbers of 4 or less are shares of the image's size."""
    from ..functions.stats import median

    rows = split_leading(arrays.where(F.size("shape") > 1))
    v = F.col("values")
    at = lambda full, short: F.when(F.size(v) == 9, F.get(v, F.lit(full))).otherwise(F.get(v, F.lit(short)))
    four = rows.select(at(0, 0).alias("fx"), at(4, 1).alias("fy"), at(2, 2).alias("cx"), at(5, 3).alias("cy"))
    mid = four.agg(*(median(F.col(c)).alias(c) for c in four.columns))
    share = F.greatest(*(F.col(c) for c in mid.columns)) <= 4.0
    return mid.select(*(F.when(share, F.col(c) * (width if c[-1] == "x" else height)).otherwise(F.col(c)).alias(c) for c in mid.columns))


def read_images(spark: SparkSession, path: str, decode: Callable[[bytes], tuple[int, int, list[float]]]) -> DataFrame:
    """`(path, name, h, w, pixels)` of image files, decoded by a function given by the caller, as no codec is built in."""
    import pandas as pd

    def run(batches):
        for pdf in batches:
            rows = [(p, *decode(bytes(c))) for p, c in zip(pdf.path, pdf.content, strict=True)]
            yield pd.DataFrame(rows, columns=["path", "h", "w", "pixels"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, h int, w int, pixels array<float>").withColumn("name", stem(F.col("path")))


def decode_pnm(data: bytes) -> tuple[int, int, list[float]]:
    """Binary grey or colour portable maps to values from 0 to 1."""
    fields, at = [], 0
    while len(fields) < 4:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at)
            continue
        end = at
        while not data[end : end + 1].isspace():
            end += 1
        fields.append(data[at:end])
        at = end
    import numpy as np

    w, h, top = (int(x) for x in fields[1:])
    raw = np.frombuffer(data, ">u2" if top > 255 else "u1", offset=at + 1)
    return h, w, (raw / top).tolist()


def read_png(spark: SparkSession, path: str) -> DataFrame:
    """`(path, name, h, w, channels)` of PNG files, each channel an array of values from 0 to 1."""
    import pandas as pd

    def run(batches):
        import numpy as np

        from ..functions.images import decode_png

        for pdf in batches:
            rows = []
            for p, content in zip(pdf.path, pdf.content, strict=True):
                image = decode_png(bytes(content))
                values = image.astype(np.float64) / np.iinfo(image.dtype).max
                rows.append((p, *image.shape[:2], [values[:, :, i].reshape(-1) for i in range(image.shape[2])]))
            yield pd.DataFrame(rows, columns=["path", "h", "w", "channels"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, h int, w int, channels array<array<double>>").withColumn("name", stem(F.col("path")))


def list_images(spark: SparkSession, path: str, every: int = 1, pattern: str = "*.{png,jpg,jpeg,JPG,PNG}") -> DataFrame:
    """`(name, path)` of every n-th image file by name, file contents unread."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    names = files.select(stem(F.col("path")).alias("name"), "path").orderBy("name").collect()
    return spark.createDataFrame(names[::every], "name string, path string")


def image_stream(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """`(path, content)` of images as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).load(folder).select("path", "content")


def read_keypoints(spark: SparkSession, path: str, factor: float = 1.0) -> DataFrame:
    """`(t, kp_id, x, y, visible)` of JSON lists of [x, y, visible], the time from the file's name, coordinates times 2 / factor."""
    text = spark.read.text(path, wholetext=True).withColumn("t", F.regexp_extract(F.input_file_name(), r"_(\d+)\.json$", 1).cast("int"))
    rows = text.select("t", F.posexplode(F.from_json("value", "array<array<double>>")).alias("kp_id", "p"))
    return rows.select("t", "kp_id", (F.get("p", F.lit(0)) * 2.0 / factor).alias("x"), (F.get("p", F.lit(1)) * 2.0 / factor).alias("y"), (F.get("p", F.lit(2)) == 1.0).alias("visible"))


def read_through(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made and written the first time it is asked for, and read after that."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table, or none of its rows if it isn't there."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
