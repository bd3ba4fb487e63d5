"""Readers of structure-from-motion models, binary and text, as DataFrames.

Binary files are records of varying length one after the other, so a file is
read whole by one task, over `binaryFile`; many models are read in parallel.
Text is read by line; where a record takes two lines they are paired by number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g

# Camera models by number, with the number of their parameters.
MODELS = {
    0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8),
    6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12),
}
ONE_FOCAL = ("SIMPLE_PINHOLE", "SIMPLE_RADIAL", "RADIAL", "SIMPLE_RADIAL_FISHEYE", "RADIAL_FISHEYE")
TWO_FOCALS = ("PINHOLE", "OPENCV", "OPENCV_FISHEYE", "FULL_OPENCV", "FOV", "THIN_PRISM_FISHEYE")

CAMERAS = "camera_id long, model string, width long, height long, params array<double>"
IMAGES = "image_id long, qvec array<double>, tvec array<double>, camera_id long, name string, points array<struct<x:double,y:double,point3d_id:long>>"
POINTS = "point3d_id long, x double, y double, z double, r int, g int, b int, error double, track array<struct<image_id:long,point2d_idx:long>>"


class Cursor:
    """Little-endian fields of a buffer, one after the other."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        out = struct.unpack_from("<" + layout, self.data, self.at)
        self.at += struct.calcsize("<" + layout)
        return out

    def text(self) -> str:
        end = self.data.index(b"\0", self.at)
        out = self.data[self.at : end].decode()
        self.at = end + 1
        return out


def parse_cameras(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(c.take("Q")[0]):
        camera, model, width, height = c.take("iiQQ")
        name, n = MODELS[model]
        yield camera, name, width, height, list(c.take(f"{n}d"))


def parse_images(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(c.take("Q")[0]):
        image, *pose, camera = c.take("i7di")
        name = c.text()
        n = c.take("Q")[0]
        points = [c.take("ddq") for _ in range(n)]
        yield image, pose[:4], pose[4:], camera, name, points


def parse_points(data: bytes) -> Iterator[tuple]:
    c = Cursor(data)
    for _ in range(c.take("Q")[0]):
        point, x, y, z, r, gr, b, error = c.take("QdddBBBd")
        n = c.take("Q")[0]
        yield point, x, y, z, r, gr, b, error, [c.take("ii") for _ in range(n)]


def _binary(spark: SparkSession, path: str, parse, schema: str) -> DataFrame:
    import pandas as pd

    names = [f.split()[0] for f in spark.createDataFrame([], schema).columns]

    def run(batches):
        for pdf in batches:
            for data in pdf.content:
                rows = list(parse(bytes(data)))
                for a in range(0, len(rows), 10_000):
                    yield pd.DataFrame(rows[a : a + 10_000], columns=names)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(_structs(run, schema), schema)


def _structs(run, schema: str):
    """Tuples in list columns as the dicts that Arrow takes for structs."""
    fields = {"points": ("x", "y", "point3d_id"), "track": ("image_id", "point2d_idx")}

    def named(batches):
        for pdf in run(batches):
            for column in set(fields) & set(pdf.columns):
                pdf[column] = [[dict(zip(fields[column], row, strict=True)) for row in rows] for rows in pdf[column]]
            yield pdf

    return named


def read_cameras_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_cameras, CAMERAS)


def read_images_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_images, IMAGES)


def read_points_binary(spark: SparkSession, path: str) -> DataFrame:
    return _binary(spark, path, parse_points, POINTS)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where("NOT startswith(trim(value), '#')")


def _numbers(words: Column, start: int, n: int | None = None) -> Column:
    size = F.size(words) - start if n is None else F.lit(n)
    return F.transform(F.slice(words, F.lit(start + 1), size), lambda x: x.cast("double"))


def read_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(w, F.lit(i))
    rows = _lines(spark, path).where("trim(value) <> ''")
    return rows.select(at(0).cast("long").alias("camera_id"), at(1).alias("model"), at(2).cast("long").alias("width"), at(3).cast("long").alias("height"), _numbers(w, 4).alias("params"))


def read_points_text(spark: SparkSession, path: str) -> DataFrame:
    w = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(w, F.lit(i))
    track = F.transform(F.sequence(F.lit(8), F.size(w) - 2, F.lit(2)), lambda i: F.struct(F.get(w, i).cast("long").alias("image_id"), F.get(w, i + 1).cast("long").alias("point2d_idx")))
    rows = _lines(spark, path).where("trim(value) <> ''")
    return rows.select(
        at(0).cast("long").alias("point3d_id"), *(at(i + 1).cast("double").alias(n) for i, n in enumerate("xyz")), *(at(i + 4).cast("int").alias(n) for i, n in enumerate("rgb")),
        at(7).cast("double").alias("error"), F.when(F.size(w) > 9, track).otherwise(F.array()).cast("array<struct<image_id:bigint,point2d_idx:bigint>>").alias("track"),
    )


def read_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Two lines a record: the pose, then the points, which may be an empty line."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split(F.regexp_replace("value", r"(?m)^#.*\n?", ""), "\n")).alias("i", "line"))
    numbered = lines.withColumn("record", F.floor(F.col("i") / 2)).groupBy("record").agg(F.max(F.when(F.col("i") % 2 == 0, F.col("line"))).alias("head"), F.max(F.when(F.col("i") % 2 == 1, F.col("line"))).alias("tail"))
    w, p = F.split(F.trim("head"), r"\s+"), F.split(F.trim(F.coalesce("tail", F.lit(""))), r"\s+")
    triples = F.transform(F.sequence(F.lit(0), F.size(p) - 3, F.lit(3)), lambda i: F.struct(F.get(p, i).cast("double").alias("x"), F.get(p, i + 1).cast("double").alias("y"), F.get(p, i + 2).cast("long").alias("point3d_id")))
    points = F.when(F.size(p) >= 3, triples).otherwise(F.array()).cast("array<struct<x:double,y:double,point3d_id:bigint>>")
    rows = numbered.where("head IS NOT NULL AND trim(head) <> ''")
    return rows.select(F.get(w, F.lit(0)).cast("long").alias("image_id"), _numbers(w, 1, 4).alias("qvec"), _numbers(w, 5, 3).alias("tvec"), F.get(w, F.lit(8)).cast("long").alias("camera_id"), F.get(w, F.lit(9)).alias("name"), points.alias("points"))


def camera_params(images: DataFrame, cameras: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """`(name, fx, fy, cx, cy, w2c)` of images, or of the `(name)` rows asked for; a name or camera that is missing, or an unknown model, fails."""
    from ..operators.sampling import require_matches

    rows = images if names is None else require_matches(names, images, ["name"])
    joined = require_matches(rows, cameras, ["camera_id"])
    p, model = F.col("params"), F.col("model")
    at = lambda i: F.get(p, F.lit(i))
    unknown = F.raise_error(F.concat(F.lit("unknown camera model "), model)).cast("double")
    one, two = model.isin(*ONE_FOCAL), model.isin(*TWO_FOCALS)
    pick = lambda a, b: F.when(one, at(a)).when(two, at(b)).otherwise(unknown)
    held, q = g.hold(joined, "q", g.unit(g.unpack(F.col("qvec"), 4)))
    w2c = g.rigid(g.quat_to_matrix(q), g.unpack(F.col("tvec"), 3))
    return held.select("name", pick(0, 0).alias("fx"), pick(0, 1).alias("fy"), pick(1, 2).alias("cx"), pick(2, 3).alias("cy"), g.pack(w2c).alias("w2c"))


def visible_points(images: DataFrame, points: DataFrame) -> DataFrame:
    """`(image_id, px, py, point3d_id, x, y, z)`: image points with a 3-D point, joined to it."""
    seen = images.select("image_id", F.explode("points").alias("p")).where("p.point3d_id >= 0")
    return seen.select("image_id", F.col("p.x").alias("px"), F.col("p.y").alias("py"), "p.point3d_id").join(points.select("point3d_id", "x", "y", "z"), "point3d_id")
