"""Exact nearest neighbours of points in a few dimensions, by boxes that hold about as many points each.

1. A tree of halves is fitted on a sample; its leaves are boxes that fill space,
   and every point goes to its own one.
2. A task searches one box: its k-th neighbour there bounds a point's ball.
3. The balls that reach other boxes are searched there too, inside the ball, and
   the k best of all boxes are a point's neighbours.

Nothing is compared by a box's number of pairs: inside a task the same tree, over
all its points, leads to small buckets, and only those that the ball reaches are
compared.  Of points in one place the k + 1 smallest ids take part; the others
have the first k of them, at distance 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of a box that one task searches, points that the tree is fitted on for each box, and at most; points of a bucket in a box.
BOX, SAMPLES, MOST_SAMPLES, BUCKET = 8192, 64, 524_288, 64
#: Distances held at once.
BLOCK = 1 << 20


class Halves:
    """Boxes that fill space: the sample is cut at the median of its widest dimension until at most `most` are together."""

    def __init__(self, sample: np.ndarray, most: int):
        dims = sample.shape[1]
        dim, at, kids, low, high = [], [], [], [], []
        todo = [(sample, np.full(dims, -np.inf), np.full(dims, np.inf), -1, 0)]
        while todo:
            x, lo, hi, parent, side = todo.pop()
            node = len(dim)
            if parent >= 0:
                kids[parent][side] = node
            dim.append(-1), at.append(0.0), kids.append([len(low)] * 2)
            with np.errstate(over="ignore"):
                spread = np.ptp(x, axis=0) if len(x) > most else np.zeros(dims)
            j = int(spread.argmax())
            if spread[j] <= 0:
                low.append(lo), high.append(hi)
                continue
            v = x[:, j]
            mid = np.partition(v, (len(v) - 1) // 2)[(len(v) - 1) // 2]
            if mid == v.max():
                mid = v[v < mid].max()
            dim[node], at[node] = j, mid
            upto, beyond = hi.copy(), lo.copy()
            upto[j] = beyond[j] = mid
            todo += [(x[v <= mid], lo, upto, node, 0), (x[v > mid], beyond, hi, node, 1)]
        self.dim, self.at, self.kids = np.array(dim), np.array(at), np.array(kids)
        self.low, self.high = np.array(low), np.array(high)

    def __len__(self) -> int:
        return len(self.low)

    def home(self, x: np.ndarray) -> np.ndarray:
        """The box of each point."""
        node = np.zeros(len(x), np.int64)
        while len(inner := np.flatnonzero(self.dim[node] >= 0)):
            at = node[inner]
            node[inner] = self.kids[at, (x[inner, self.dim[at]] > self.at[at]).astype(np.int64)]
        return self.kids[node, 0]

    def reach(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (point, box) of all boxes that a point's closed ball touches.

        A box is as far as its nearest corner, edge or side by the sums that give
        distances of points, so rounding never puts it beyond a point inside.
        """
        who, node = np.arange(len(x)), np.zeros(len(x), np.int64)
        found = [(who[:0], node[:0])]
        while len(who):
            leaf = self.dim[node] < 0
            found.append((who[leaf], self.kids[node[leaf], 0]))
            who, node = who[~leaf], node[~leaf]
            gap, r = x[who, self.dim[node]] - self.at[node], radius[who]
            left, right = gap <= r, gap >= -r
            who, node = np.concatenate([who[left], who[right]]), np.concatenate([self.kids[node[left], 0], self.kids[node[right], 1]])
        who, box = (np.concatenate(parts) for parts in zip(*found, strict=True))
        gap = np.maximum(np.maximum(self.low[box] - x[who], x[who] - self.high[box]), 0.0)
        near = _length(gap.T) <= radius[who]
        return who[near], box[near]


def _length(gaps) -> np.ndarray:
    with np.errstate(over="ignore"):
        total = gaps[0] * gaps[0]
        for g in gaps[1:]:
            total = total + g * g
        return np.sqrt(total)


class Bucketed:
    """Points of one task in buckets; `order` ranks their ids, equal ones alike."""

    def __init__(self, points: np.ndarray, order: np.ndarray):
        self.points, self.order = points, order
        self.tree = Halves(points, BUCKET)
        self.home = self.tree.home(points)
        self.by_bucket = np.argsort(self.home, kind="stable")
        self.bounds = np.searchsorted(self.home[self.by_bucket], np.arange(len(self.tree) + 1))

    def compare(self, x: np.ndarray, own: np.ndarray, radius: np.ndarray, who: np.ndarray, bucket: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(probe, distance, point) of each pair (probe, bucket): its k nearest within the radius and what is as near as the last."""
        sort = np.argsort(bucket, kind="stable")
        who, bucket = who[sort], bucket[sort]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, np.int64)
        out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        for first, last in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            b = bucket[first]
            mine = self.by_bucket[self.bounds[b] : self.bounds[b + 1]]
            there, ids = self.points[mine].T[:, None, :], self.order[mine]
            step = max(1, BLOCK // max(1, len(mine)))
            for lo in range(first, last, step):
                probe = who[lo : min(lo + step, last)]
                d = _length(x[probe].T[:, :, None] - there)
                d[own[probe][:, None] == ids] = np.nan
                limit = radius[probe]
                if len(mine) > k:
                    limit = np.fmin(np.partition(d, k - 1, axis=1)[:, k - 1], limit)
                p, i = np.nonzero(d <= limit[:, None])
                out.append((probe[p], d[p, i], mine[i]))
        return tuple(np.concatenate(parts) for parts in zip(*out, strict=True))

    def best(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], probes: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The k nearest of each probe, the smaller id first among equals: how many each has, distances, points; and the k-th distance, or infinity."""
        who, d, point = (np.concatenate(parts) for parts in zip(*found, strict=True))
        sort = np.lexsort((self.order[point], d, who))
        who, d, point = who[sort], d[sort], point[sort]
        count = np.bincount(who, minlength=probes)
        kept = np.arange(len(who)) - (np.cumsum(count) - count)[who] < k
        d, point, count = d[kept], point[kept], np.minimum(count, k)
        kth = np.full(probes, np.inf)
        kth[count == k] = d[(np.cumsum(count) - 1)[count == k]]
        return count, d, point, kth

    def own_neighbours(self, k: int):
        """`best` of the points themselves."""
        n = len(self.points)
        here = self.compare(self.points, self.order, np.full(n, np.inf), np.arange(n), self.home, k)
        radius = self.best([here], n, k)[3]
        who, bucket = self.tree.reach(self.points, radius)
        other = bucket != self.home[who]
        return self.best([here, self.compare(self.points, self.order, radius, who[other], bucket[other], k)], n, k)

    def neighbours(self, x: np.ndarray, own: np.ndarray, radius: np.ndarray, k: int):
        """`best` of other probes, inside their balls."""
        return self.best([self.compare(x, own, radius, *self.tree.reach(x, radius), k)], len(x), k)


def _ranks(ids: pa.Array) -> np.ndarray:
    """Each id's place among the distinct ones."""
    held = ids.dictionary_encode()
    place = np.empty(len(held.dictionary), np.int64)
    place[pc.sort_indices(held.dictionary).to_numpy()] = np.arange(len(held.dictionary))
    return place[held.indices.to_numpy(zero_copy_only=False)]


def _matrix(batch, dims: int) -> np.ndarray:
    return np.stack([batch.column(f"x{i}").to_numpy() for i in range(dims)], axis=1)


def _distance(dims: int) -> Column:
    gap = [F.col(f"x{i}") - F.col(f"n{i}") for i in range(dims)]
    return F.sqrt(sum((g * g for g in gap[1:]), gap[0] * gap[0]))


def _beyond_numbers(rows: DataFrame, asked: DataFrame, dims: int, k: int) -> DataFrame:
    """`(id, neighbour, distance)` for points with an infinite or NaN coordinate, NaN being farther than infinity.

    Such a point is equally far from all points that are finite, infinite or NaN
    in the same coordinates, so the k + 1 smallest ids of each kind will do.
    """
    kind = F.concat_ws(",", *(F.when(F.abs(f"x{i}") < float("inf"), "").otherwise(F.col(f"x{i}").cast("string")) for i in range(dims)))
    first = F.dense_rank().over(W.partitionBy("kind").orderBy("id"))
    heads = rows.withColumn("kind", kind).withColumn("at", first).where(F.col("at") <= k + 1).select(F.col("id").alias("neighbour"), *(F.col(f"x{i}").alias(f"n{i}") for i in range(dims)))
    return asked.crossJoin(F.broadcast(heads)).where(F.col("id") != F.col("neighbour")).select("id", "neighbour", _distance(dims).alias("distance"))


def nearest(points: DataFrame, id_: str, dims: list[str], k: int) -> DataFrame:
    """`(id, neighbour, distance, rank)`: the k nearest points with another id, the smaller id first among equals.

    Points without an id or with a NULL coordinate take no part.
    """
    d = len(dims)
    at = [f"x{i}" for i in range(d)]
    rows = points.select(F.col(id_).alias("id"), *(F.col(c).cast("double").alias(x) for c, x in zip(dims, at, strict=True)))
    for c in ("id", *at):
        rows = rows.where(F.col(c).isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    places = ", ".join(f"{x} double" for x in at)
    near = f"near array<struct<neighbour: {kind}, distance: double>>"
    finite = F.lit(True)
    for x in at:
        finite = finite & (F.abs(x) < float("inf"))
    order = W.partitionBy(*at).orderBy("id")
    held = rows.where(finite).withColumn("at", F.dense_rank().over(order)).where(F.col("at") <= k + 1).checkpoint()
    n, most = held.agg(F.count(F.lit(1)), F.max("at")).first()
    odd = rows.where(~finite)
    parts = []
    if n <= k or not odd.isEmpty():
        parts.append(_beyond_numbers(rows, rows if n <= k else odd, d, k))
    if n > k:
        parts.append(_finite(held.drop("at"), n, d, k, kind, places, near).select("id", F.inline("near")))
    if most == k + 1:
        full = held.groupBy(*at).agg(F.max("at").alias("most"), F.max("id").alias("last"), F.slice(F.sort_array(F.collect_list("id")), 1, k).alias("ids")).where(F.col("most") == k + 1)
        crowd = rows.where(finite).join(full.drop("most"), at).where(F.col("id") > F.col("last"))
        parts.append(crowd.select("id", F.explode("ids").alias("neighbour"), F.lit(0.0).alias("distance")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    rank = F.row_number().over(W.partitionBy("id").orderBy("distance", "neighbour"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).withColumnRenamed("id", id_)


def _finite(held: DataFrame, n: int, d: int, k: int, kind: str, places: str, near: str) -> DataFrame:
    """`(id, near)`, a row for each point and each box with neighbours of it."""
    at = [f"x{i}" for i in range(d)]
    boxes = -(-n // BOX)
    share = -(-n // min(boxes * SAMPLES, MOST_SAMPLES)) if n > MOST_SAMPLES else 1
    sample = np.zeros((0, d))
    if boxes > 1:
        sample = _matrix(held.where(F.pmod(F.xxhash64("id", *at), F.lit(share)) == 0).select(*at).toArrow(), d)
    tree = Halves(sample, max(1, -(-len(sample) // boxes)))

    def to_own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.home(_matrix(batch, d))), *batch.columns], ["box", *batch.schema.names])

    def to_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, d)
            who, box = tree.reach(x, batch.column("radius").to_numpy())
            other = box != tree.home(x)[who]
            sent = batch.take(pa.array(who[other]))
            yield pa.RecordBatch.from_arrays([pa.array(box[other]), *sent.columns], ["box", *sent.schema.names])

    def search(table: pa.Table) -> pa.Table:
        ids, x = table.column("id").combine_chunks(), _matrix(table, d)
        order = _ranks(ids)
        radius = table.column("radius").to_numpy() if "radius" in table.column_names else np.full(len(x), np.nan)
        here, asked = np.flatnonzero(np.isnan(radius)), np.flatnonzero(~np.isnan(radius))
        own = Bucketed(x[here], order[here])
        if len(asked):
            count, distance, point, kth = own.neighbours(x[asked], order[asked], radius[asked], k)
        elif "radius" in table.column_names:
            count, distance, point, kth = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64), np.zeros(0)
        else:
            asked = here
            count, distance, point, kth = own.own_neighbours(k)
        pairs = pa.StructArray.from_arrays([ids.take(pa.array(here[point])), pa.array(distance)], ["neighbour", "distance"])
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), pairs)
        probes = pa.array(asked)
        return pa.table([ids.take(probes), *(pa.array(x[asked, i]) for i in range(d)), pa.array(kth), lists], ["id", *at, "radius", "near"])

    schema = f"id {kind}, {places}, radius double, {near}"
    homed = held.mapInArrow(to_own, f"box long, id {kind}, {places}")
    found = homed.groupBy("box").applyInArrow(search, schema)
    if len(tree) == 1:
        return found.select("id", "near")
    found = found.checkpoint()
    sent = found.drop("near").mapInArrow(to_others, f"box long, id {kind}, {places}, radius double")
    both = homed.withColumn("radius", F.lit(float("nan"))).unionByName(sent)
    return found.select("id", "near").unionByName(both.groupBy("box").applyInArrow(search, schema).select("id", "near"))
