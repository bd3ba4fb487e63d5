"""Captures read from the folder layouts that recording tools leave; each method gives a table, read when it is used."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import rasters, robust, scene
from .files import INTRINSIC_KEYS, POSE_KEYS, intrinsics_vector, read_arrays, read_json_cameras, read_keypoints, read_png, read_split, split_leading, stem

LEAST_DEPTH = 1e-3


@dataclass
class FolderCapture:
    """What the kinds share: frames `start` to before `end` of a folder, numbered from 0 as `t`, rasters packed."""

    spark: SparkSession
    folder: str
    start: int = 0
    end: int | None = None
    factor: int = 1
    split: str = "train"

    @cached_property
    def names(self) -> DataFrame:
        """`(frame_name, time_id, t)`."""
        return read_split(self.spark, f"{self.folder}/splits/{self.split}.json", self.start, self.end)

    def _named(self, df: DataFrame, name: str = "name") -> DataFrame:
        """Rows of this capture's frames, with their `t`."""
        return df.join(F.broadcast(self.names.select(F.col("frame_name").alias(name), "t")), name).drop(name)

    def _rgb(self) -> str:
        return f"{self.folder}/rgb/{self.factor}x"

    def _masks(self) -> str:
        return f"{self.folder}/flow3d_preprocessed/track_anything/{self.factor}x"

    def images(self) -> DataFrame:
        """`(t, h, w, r, g, b, valid)`: values from 0 to 1; valid is the alpha channel, 1 without one."""
        return self._named(read_png(self.spark, self._rgb())).select("t", "h", "w", *(F.get("channels", F.lit(i)).alias(c) for i, c in enumerate("rgb")), F.coalesce(F.get("channels", F.lit(3)), F.transform(F.get("channels", F.lit(0)), lambda _: F.lit(1.0))).alias("valid"))

    def masks(self) -> DataFrame:
        """`(t, h, w, mask)`, the first channel from 0 to 1."""
        return self._named(read_png(self.spark, self._masks())).select("t", "h", "w", F.get("channels", F.lit(0)).alias("mask"))

    def depths(self) -> DataFrame:
        """`(t, depth)`: held to LEAST_DEPTH from below and to 2.5 times the median of the frames' largest depths."""
        arrays = read_arrays(self.spark, f"{self.folder}/depth/{self.factor}x").withColumn("name", stem(F.col("path")))
        held = self._named(arrays.select("name", F.transform("values", lambda d: F.greatest(d, F.lit(LEAST_DEPTH))).alias("depth")))
        return rasters.clamp_depth(held, "depth")

    def frames(self) -> DataFrame:
        """`(frame, h, w, depth, mask, valid)`."""
        both = self.masks().join(self.depths(), "t").join(self.images().select("t", "valid"), "t")
        return both.select(F.col("t").alias("frame"), "h", "w", "depth", "mask", "valid")

    def cameras(self) -> DataFrame:
        """`(frame, fx, fy, cx, cy, w2c, c2w)`."""
        found = self._named(read_json_cameras(self.spark, f"{self.folder}/camera", self.factor))
        return found.select(F.col("t").alias("frame"), "fx", "fy", "cx", "cy", "w2c", "c2w")

    def tracks_2d(self) -> DataFrame:
        """`(query_t, target_t, point_id, x, y, occ_logit, dist_logit)` of files named QUERY_TARGET."""
        arrays = read_arrays(self.spark, f"{self.folder}/flow3d_preprocessed/2d_tracks/{self.factor}x").withColumn("pair", F.split(stem(F.col("path")), "_", 2))
        rows = split_leading(arrays, "point_id").join(arrays.select("path", "pair"), "path")
        times = self.names.select("frame_name", "t")
        for i, t in enumerate(("query_t", "target_t")):
            rows = rows.join(F.broadcast(times.select(F.col("frame_name").alias(f"n{i}"), F.col("t").alias(t))), F.get("pair", F.lit(i)) == F.col(f"n{i}")).drop(f"n{i}")
        return rows.select("query_t", "target_t", "point_id", *(F.get("values", F.lit(i)).alias(n) for i, n in enumerate(("x", "y", "occ_logit", "dist_logit"))))

    def keypoints(self) -> DataFrame:
        """`(t, kp_id, x, y, visible)`."""
        found = read_keypoints(self.spark, f"{self.folder}/keypoint/2x/{self.split}", self.factor).withColumnRenamed("t", "time_id")
        return found.join(F.broadcast(self.names.select("time_id", "t")), "time_id").drop("time_id")

    def in_order(self) -> DataFrame:
        """Images as a video: by t."""
        return self.images().orderBy("t")

    @cached_property
    def length(self) -> int:
        return self.names.count()

    def tracks_3d(self) -> DataFrame:
        return scene.lift_tracks(self.tracks_2d().withColumnsRenamed({"x": "px", "y": "py"}), self.frames(), self.cameras(), self.length)

    def normaliser(self) -> DataFrame:
        """One row: the scene's centre and scale, from its 3-D tracks."""
        return robust.spread(self.tracks_3d(), ["x", "y", "z"])


class PhoneCapture(FolderCapture):
    """A hand-held recording: RGBA images, masks, depths and a camera file for each frame, intrinsics over the factor."""


@dataclass
class MultiviewCapture(FolderCapture):
    """A recording by several cameras: intrinsics are scaled by the measured sizes, and a mask holds where any channel does."""

    factor: int = 2

    def masks(self) -> DataFrame:
        held = F.aggregate("channels", F.transform(F.get("channels", F.lit(0)), lambda _: F.lit(0.0)), lambda a, c: F.zip_with(a, c, lambda x, y: x + y))
        return self._named(read_png(self.spark, self._masks())).select("t", "h", "w", F.transform(held, lambda v: (v != 0).cast("double")).alias("mask"))

    def cameras(self) -> DataFrame:
        whole = read_json_cameras(self.spark, f"{self.folder}/camera")
        size = lambda path, h, w: read_png(self.spark, path).agg(F.max("h").alias(h), F.max("w").alias(w))
        sizes = size(self._rgb(), "h", "w").crossJoin(size(f"{self.folder}/rgb/1x", "h1", "w1"))
        both = self._named(whole).crossJoin(F.broadcast(sizes))
        sx, sy = F.col("w") / F.col("w1"), F.col("h") / F.col("h1")
        return both.select(F.col("t").alias("frame"), (F.col("fx") * sx).alias("fx"), (F.col("fy") * sy).alias("fy"), (F.col("cx") * sx).alias("cx"), (F.col("cy") * sy).alias("cy"), "w2c", "c2w")


@dataclass
class CasualCapture(FolderCapture):
    """A video with estimated depth and cameras: frames are the images by name, depths disparities, cameras one array file."""

    res: str = "480p"
    image_type: str = "images"
    mask_type: str = "masks"
    depth_type: str = "aligned_depth_anything"
    camera_file: str = "cameras.npz"
    median: int = 0

    @cached_property
    def names(self) -> DataFrame:
        """Frames numbered by name; as many as a folder has files, so their order is taken on the driver."""
        files = self.spark.read.format("binaryFile").load(self._rgb()).select(stem(F.col("path")).alias("name"))
        found = sorted(r.name for r in files.collect())[self.start : self.end]
        return self.spark.createDataFrame([(n, self.start + t, t) for t, n in enumerate(found)], "frame_name string, time_id int, t int")

    def _rgb(self) -> str:
        return f"{self.folder}/{self.image_type}/{self.res}"

    def _masks(self) -> str:
        return f"{self.folder}/{self.mask_type}/{self.res}"

    def depths(self) -> DataFrame:
        """Depths of the disparities, smoothed by a median window if one is asked for."""
        arrays = read_arrays(self.spark, f"{self.folder}/{self.depth_type}/{self.res}").withColumn("name", stem(F.col("path")))
        rows = self._named(arrays.select("name", F.get("shape", F.lit(0)).cast("int").alias("h"), F.get("shape", F.lit(1)).cast("int").alias("w"), rasters.disparity_to_depth(F.col("values")).alias("depth")))
        rows = rasters.median_filter(rows, "depth", self.median, "depth") if self.median else rows
        return rows.select("t", "depth")

    def cameras(self) -> DataFrame:
        path = f"{self.folder}/{self.camera_file}"
        poses = split_leading(read_arrays(self.spark, path, POSE_KEYS), "time_id")
        size = read_png(self.spark, self._rgb()).agg(F.max("w"), F.max("h")).first()
        k = intrinsics_vector(read_arrays(self.spark, path, INTRINSIC_KEYS).withColumn("shape", F.when(F.size("shape") == 2, F.concat(F.array(F.lit(1).cast("long")), "shape")).otherwise(F.col("shape"))), *map(float, size))
        held = poses.join(F.broadcast(self.names.select("time_id", "t")), "time_id").crossJoin(F.broadcast(k))
        return held.select(F.col("t").alias("frame"), "fx", "fy", "cx", "cy", g.pack(g.invert_rigid(g.unpack(F.col("values"), 16))).alias("w2c"), F.col("values").alias("c2w"))


def train_and_validation(kind: type[FolderCapture], spark: SparkSession, folder: str, **options) -> tuple[FolderCapture, FolderCapture]:
    return kind(spark, folder, **options), kind(spark, folder, **(options | {"split": "val"}))
