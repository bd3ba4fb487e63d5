"""Streaming forms: statistics by tumbling count window, and a bounded memory fed frame by frame."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def step_window_stream(events: DataFrame, every: int = 100, late: int = 1000) -> DataFrame:
    """Running statistics of an event stream by windows of event numbers, in update mode.

    An event's number stands for a second, so a watermark of `late` numbers
    closes old windows: state holds the open ones alone, however long the stream.
    A window's later rows replace its earlier ones: counts only grow.
    """
    numbered = events.withColumn("at", F.timestamp_seconds("event_id")).withWatermark("at", f"{late} seconds")
    stats = numbered.groupBy(F.window("at", f"{every} seconds"), "user_id").agg(F.sum("value").alias("grad_sum"), F.count(F.lit(1)).alias("vis_count"), F.max(F.col("event_id") % 23).alias("max_radius"))
    return stats.select(F.floor(F.unix_timestamp("window.start") / every).alias("win"), "user_id", "grad_sum", "vis_count", "max_radius")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """The last state of each key of what an update stream has written."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), by).alias("s")).select(*keys, "s.*")


def time_windows(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """An extra beside the library's count windows: sums by tumbling time window with a watermark."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class BoundedMemory(StatefulProcessor):
    """Keeps up to `most` elements of each group; every `write_every`-th frame is written.

    A frame raises the use of the remembered elements by softmax of similarity,
    their life by one, and evicts those least used for their life once there are
    too many, ties with the last one going too.  State is one list for each
    group, so its size is bounded whatever the stream brings.
    """

    def __init__(self, most: int = 32, write_every: int = 5, k: int = 30):
        self.most, self.write_every, self.k = most, write_every, k

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.items = handle.getListState("items", "elem_id long, key array<double>, use double, life double")
        self.frames = handle.getValueState("frames", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        held = [[int(i), np.array(k, float), float(u), float(n)] for i, k, u, n in self.items.get()]
        n = self.frames.get()[0] if self.frames.exists() else 0
        out = []
        for frame in (r for pdf in rows for r in pdf.sort_values("frame").itertuples()):
            q = np.array(frame.key, float)
            read = float("nan")
            if held:
                keys = np.stack([h[1] for h in held])
                score = (2 * keys @ q - (keys * keys).sum(1)) / np.sqrt(len(q))
                best = np.argsort(-score, kind="stable")[: self.k]
                weight = np.exp(score[best] - score[best].max())
                weight /= weight.sum()
                read = float(weight @ keys[best, 0])
                for h in held:
                    h[3] += 1
                for i, w in zip(best, weight, strict=True):
                    held[i][2] += float(w)
            if n % self.write_every == 0:
                held.append([int(frame.frame), q, 1e-7, 1e-7])
            n += 1
            surplus = len(held) - self.most
            if surplus > 0:
                ratio = np.array([h[2] / h[3] for h in held])
                limit = np.sort(ratio)[surplus - 1]
                held = [h for h, r in zip(held, ratio, strict=True) if r > limit]
            out.append((key[0], int(frame.frame), len(held), read))
        self.items.put([(h[0], h[1].tolist(), h[2], h[3]) for h in held])
        self.frames.update((n,))
        yield pd.DataFrame(out, columns=["video", "frame", "size", "read"])

    def close(self) -> None:
        pass


def remember(frames: DataFrame, **kw) -> DataFrame:
    """`(video, frame, key)` stream -> `(video, frame, size, read)`."""
    return frames.groupBy("video").transformWithStateInPandas(BoundedMemory(**kw), outputStructType="video long, frame long, size long, read double", outputMode="append", timeMode="none")
