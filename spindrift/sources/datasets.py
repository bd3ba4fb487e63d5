"""Captures as sets of tables, whatever they were read from."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import robust, scene
from .captures import CasualCapture, MultiviewCapture, PhoneCapture
from .files import read_or_empty


class Capture(Protocol):
    """What operators ask of a source; each method gives a table, read when it is used."""

    def cameras(self) -> DataFrame: ...

    def frames(self) -> DataFrame: ...

    def tracks_2d(self) -> DataFrame: ...


@dataclass
class ParquetCapture:
    """`camera`, `frame`, `track2d` and `keypoint` tables below one folder, frames from `start` to before `end`, counted from 0."""

    spark: SparkSession
    folder: str
    start: int = 0
    end: int | None = None
    names: tuple[str, ...] = field(default=("camera", "frame", "track2d", "keypoint"))

    def _cut(self, df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.where(F.col(c) >= self.start)
            df = df if self.end is None else df.where(F.col(c) < self.end)
            df = df.withColumn(c, F.col(c) - self.start)
        return df

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def cameras(self) -> DataFrame:
        return self._cut(self.table("camera"), "frame")

    def frames(self) -> DataFrame:
        return self._cut(self.table("frame"), "frame")

    def tracks_2d(self) -> DataFrame:
        return self._cut(self.table("track2d"), "query_t", "target_t")

    def keypoints(self) -> DataFrame:
        return self._cut(read_or_empty(self.spark, f"{self.folder}/keypoint", "seq STRING, t INT, kp_id INT, x DOUBLE, y DOUBLE, visible BOOLEAN"), "t")

    @cached_property
    def length(self) -> int:
        return self.cameras().select("frame").distinct().count()

    def tracks_3d(self) -> DataFrame:
        return scene.lift_tracks(self.tracks_2d().withColumnsRenamed({"x": "px", "y": "py"}), self.frames(), self.cameras(), self.length)

    def background(self, per_frame: int, seed: int = 0) -> DataFrame:
        return scene.background_points(self.frames(), self.cameras(), per_frame, seed)

    def normaliser(self) -> DataFrame:
        """One row: the scene's centre and scale, from its 3-D tracks."""
        return robust.spread(self.tracks_3d(), ["x", "y", "z"])


def open_capture(spark: SparkSession, kind: str, folder: str, **options) -> Capture:
    """A source by the name of its kind; other kinds are added to KINDS."""
    if kind not in KINDS:
        raise ValueError(f"no capture of kind {kind}; there are {', '.join(sorted(KINDS))}")
    return KINDS[kind](spark, folder, **options)


KINDS = {"parquet": ParquetCapture, "phone": PhoneCapture, "multiview": MultiviewCapture, "casual": CasualCapture}
