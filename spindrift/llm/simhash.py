"""SimHash near-duplicate detection: fingerprints joined by vantage-point trees.

1. A document's fingerprint has a bit set where over half of its shingles'
   hashes have it (`fingerprints`).
2. Equal fingerprints are merged before anything is compared, so a group of
   exact copies is one point however large it is.
3. A vantage-point tree over a bounded sample splits the space of fingerprints
   into shards by Hamming distance.  With a node's vantage point v and bound m,
   a point x goes to the near side if d(x, v) <= m and to the far side if
   d(x, v) > m - r.  By the triangle inequality two points within r of each
   other then share a side at every node, so each linked pair meets in at least
   one shard; only points in the overlap are held twice.
4. Each shard is split the same way in memory and compared exactly in small
   blocks.  A shard emits links to the smallest member of each of its groups:
   never more links than members, however dense a group is.
5. The links' components are found on tables (`components`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, Words, ragged, slices, split_words, sum_by_doc
from .components import connected_components, spread_join
from .session import cut, partitions, read

#: Fingerprints wanted in a shard, the tree's sample points for each shard, and about the most sample points (8 MB).
SHARD, SAMPLES_PER_SHARD, MOST_SAMPLES = 2048, 16, 1 << 20
#: Members of a shard that are compared with one another at once.
BLOCK = 256
#: A split must leave each side at most so much of its parent, else the node is not split.
SHRINK = 0.85

_SPREAD = np.array([sum(((b >> i) & 1) << (8 * i) for i in range(8)) for b in range(256)], np.uint64)


def shingle_hashes(words: Words, k: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each document's k-word shingles, and where each document's begin."""
    joined = words.joined().cast(pa.large_binary())
    data = joined.buffers()[2]
    data = data.to_pybytes() if data is not None else b""
    sizes = pc.binary_length(words.flat).to_numpy(zero_copy_only=False).astype(np.int64)
    counts = words.counts
    # words follow one another with one blank between those of a document
    firsts = np.cumsum(sizes + 1) - (sizes + 1) - np.repeat(np.cumsum(counts > 0) - (counts > 0), counts)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    width = np.minimum(counts, k)
    begin = ragged(words.starts[:-1], n)
    end = begin + np.repeat(width, n) - 1
    lo, hi = firsts[begin].tolist(), (firsts[end] + sizes[end]).tolist()
    f = xxhash.xxh64_intdigest
    hashes = np.fromiter((f(data[a:b], seed) for a, b in zip(lo, hi, strict=True)), np.uint64, len(lo))
    return hashes, np.concatenate(([0], np.cumsum(n)))


def majority_bits(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per document a 64-bit number whose bits are those set in over half of its hashes.

    Bits are counted eight at a time, a byte each, over runs of at most 255 hashes.
    """
    n = np.diff(starts)
    runs = -(-n // 255)
    run_doc = np.repeat(np.arange(len(n)), runs)
    run_start = starts[:-1][run_doc] + 255 * ragged(np.zeros(len(n), np.int64), runs)
    doc_runs = np.concatenate(([0], np.cumsum(runs)))
    octets = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    out = np.zeros(len(n), np.uint64)
    for b in range(8 if len(run_start) else 0):
        lanes = np.add.reduceat(_SPREAD[octets[:, b]], run_start)
        counts = sum_by_doc(lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64), doc_runs)
        octet = np.packbits(counts * 2 > n[:, None], axis=1, bitorder="little")[:, 0]
        out |= octet.astype(np.uint64) << np.uint64(8 * b)
    return out


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """`(doc_id, fp)` of every row; words are split at ASCII blanks, A-Z counts as a-z, fp is the fingerprint's bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), LOWER)
                fp = majority_bits(*shingle_hashes(words, shingle_words))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


# --- vantage-point trees ------------------------------------------------------------------


def _distance(x: np.ndarray, v: np.uint64) -> np.ndarray:
    return np.bitwise_count(x ^ v)


def _bound(d: np.ndarray, r: int) -> tuple[int, int] | None:
    """The bound near the middle whose larger side is smallest, and that side's size."""
    counts = np.bincount(d, minlength=65)
    near = np.cumsum(counts)
    best = None
    for m in range(64):
        larger = max(int(near[m]), len(d) - int(near[m - r] if m >= r else 0))
        if best is None or larger < best[1]:
            best = (m, larger)
    return best


class VantageTree:
    """Nodes as arrays: vantage point, bound, near child, far child; a child below 0 is shard -child - 1."""

    def __init__(self, points: np.ndarray, r: int, leaf: int, seed: int = 7):
        self.r, self.shards = r, 0
        self.nodes: list[list] = []
        rng = np.random.default_rng(seed)
        self.root = self._build(points, leaf, rng)

    def _build(self, points: np.ndarray, leaf: int, rng) -> int:
        if len(points) > leaf:
            best = None
            for v in points[rng.integers(0, len(points), 6)]:
                d = _distance(points, v)
                m, larger = _bound(d, self.r)
                if best is None or larger < best[0]:
                    best = (larger, v, m, d)
            larger, v, m, d = best
            if larger <= SHRINK * len(points):
                at = len(self.nodes)
                self.nodes.append([v, m, 0, 0])
                self.nodes[at][2] = self._build(points[d <= m], leaf, rng)
                self.nodes[at][3] = self._build(points[d > m - self.r], leaf, rng)
                return at
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of point, shard) for every shard that a point belongs to."""
        todo, index, shard = [(self.root, np.arange(len(points)))], [], []
        while todo:
            at, idx = todo.pop()
            if not len(idx):
                continue
            if at < 0:
                index.append(idx)
                shard.append(np.full(len(idx), -at - 1, np.int32))
                continue
            v, m, near, far = self.nodes[at]
            d = _distance(points[idx], v)
            todo += [(near, idx[d <= m]), (far, idx[d > m - self.r])]
        return (np.concatenate(index), np.concatenate(shard)) if index else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def _roots(parent: np.ndarray, members: np.ndarray) -> np.ndarray:
    roots = parent[members]
    while (up := parent[roots]).tolist() != roots.tolist():
        roots = up
    return np.unique(roots)


def _link_blocks(points: np.ndarray, a: np.ndarray, b: np.ndarray, r: int, parent: np.ndarray) -> None:
    """Joins each member of b with the members of a within r of it; parent is the forest so far."""
    near = np.bitwise_count(points[a][:, None] ^ points[b][None, :]) <= r
    for j in np.flatnonzero(near.sum(0) > (a is b)):
        roots = _roots(parent, np.append(a[near[:, j]], b[j]))
        parent[roots] = roots[0]


def join_shard(points: np.ndarray, r: int, seed: int = 11) -> np.ndarray:
    """For each point of a shard the position of its group's first member; groups are exact."""
    parent = np.arange(len(points))
    rng = np.random.default_rng(seed)
    todo = [np.arange(len(points))]
    while todo:
        idx = todo.pop()
        if len(idx) > BLOCK:
            best = None
            for v in points[idx[rng.integers(0, len(idx), 3)]]:
                d = _distance(points[idx], v)
                m, larger = _bound(d, r)
                if best is None or larger < best[0]:
                    best = (larger, m, d)
            larger, m, d = best
            if larger <= SHRINK * len(idx):
                todo += [idx[d <= m], idx[d > m - r]]
                continue
        # small enough, or too dense to split: every block with every other
        parts = [idx[i : i + BLOCK] for i in range(0, len(idx), BLOCK)]
        for i, a in enumerate(parts):
            for b in parts[i:]:
                _link_blocks(points, a, b, r, parent)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def near_links(nodes: DataFrame, radius: int) -> DataFrame:
    """`(fp, node)` with distinct fps -> links `(u, v)` between nodes; their components are those of all pairs within `radius` bits.

    The tree is fitted on about SAMPLES_PER_SHARD fingerprints for each shard,
    and MOST_SAMPLES in all, picked by hash; every fingerprint is routed through it.
    """
    spark = nodes.sparkSession
    count = nodes.count()
    shards = -(-count // SHARD)
    rate = min(1.0, min(MOST_SAMPLES, shards * SAMPLES_PER_SHARD) / max(count, 1))
    picked = F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < int(rate * (1 << 30))
    sample = nodes.where(picked).select("fp").toArrow()["fp"].to_numpy() if shards > 1 else np.zeros(0, np.int64)
    tree = VantageTree(np.sort(sample.astype(np.int64)).view(np.uint64), radius, SAMPLES_PER_SHARD)
    shared = spark.sparkContext.broadcast(tree)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            index, shard = shared.value.route(batch.column("fp").to_numpy().view(np.uint64))
            index = pa.array(index)
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), batch.column("fp").take(index), batch.column("node").take(index)], ["shard", "fp", "node"])

    def links(shard_fp: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(node, kind="stable")
        node = node[order]
        root = join_shard(shard_fp[order], radius)
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, shard = [], None
        for batch in batches:
            ids = batch.column("shard").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if ids[a] != shard and held:
                    yield links(*map(np.concatenate, zip(*held, strict=True)))
                    held = []
                shard = ids[a]
                held.append((batch.column("fp").to_numpy()[a:b].view(np.uint64), batch.column("node").to_numpy()[a:b]))
        if held:
            yield links(*map(np.concatenate, zip(*held, strict=True)))

    return (
        nodes.select("fp", "node")
        .mapInArrow(route, "shard int, fp long, node long")
        .repartition(partitions(spark), "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(join, "u long, v long")
    )


def components_by_key(prints: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`(doc_id, fp)` -> `(doc_id, fp, component_id)`: the smallest doc_id reachable through equal fps and `links` of `(fp, node)`, node the smallest doc_id of an fp.

    Rows with the same doc_id count as one document.  A null doc_id is no name
    for a component: such a row keeps a null component_id and links nothing.
    """
    named = prints.where("doc_id IS NOT NULL")
    nodes = cut(named.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ids = named.groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo != hi").select("doc_id")
    same = spread_join(prints.join(ids, "doc_id"), nodes, "fp", total).where("doc_id != node").select(F.col("doc_id").alias("u"), F.col("node").alias("v"))
    roots = connected_components(links(nodes.select("fp", "node")).unionAll(same))
    reach = nodes.join(roots.withColumnRenamed("u", "node"), "node", "left").select("fp", "n", F.coalesce("v", "node").alias("component_id"))
    found = spread_join(named, reach, "fp", total).select("doc_id", "fp", "component_id")
    return found.unionAll(prints.where("doc_id IS NULL").select("doc_id", "fp", F.lit(None).cast("long")))


def near_components(prints: DataFrame, radius: int = 2) -> DataFrame:
    """`(doc_id, fp)` -> `(doc_id, fp, component_id)` by links of at most `radius` bits."""
    return components_by_key(prints, lambda nodes: near_links(nodes, radius))


def first_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of the document that names its component, repeats of it once, and rows without doc_id."""
    kept = found.where("doc_id = component_id").select("doc_id").distinct()
    named = docs.where("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return named.select(docs.columns).unionAll(docs.where("doc_id IS NULL"))


def deduplicate(docs: DataFrame, radius: int = 2, shingle_words: int = 3) -> DataFrame:
    """Rows of one document for each near-duplicate group, the one with the smallest doc_id; repeats of it are kept once, rows without doc_id stay."""
    return first_of_each(docs, near_components(cut(fingerprints(docs, shingle_words)), radius))


def fingerprint_text(fp: Column) -> Column:
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document.

    A null or blank text has fingerprint zero and is linked like any other; a
    very long text counts whole; repeated rows give repeated rows; an empty
    table gives no rows; further columns are not read.  A component_id is null
    where doc_id is.
    """
    prints = cut(fingerprints(read(spark, sf_dir, "documents")))
    return near_components(prints).select("doc_id", fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")
