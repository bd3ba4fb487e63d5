"""Near copies of documents: SimHash links, and all pairs of similar sets of word shingles.

Two documents are linked if the SimHash fingerprints of their sets of 5-word
shingles differ in at most RADIUS bits, found by vantage-point trees
(`simhash.near_links`), or if the sets have a Jaccard similarity of 4/5 or more.
Such sets' fingerprints differ in ten bits or so, a distance at which no tree of
64-bit numbers prunes anything, so similar sets are found by what they share:

1. Equal sets are merged before anything is compared (`sketches`).
2. Of a linked pair, at most a fifth of either set is missing from the other.
   So if s of a set's n shingles have a hash below BELOW, n - ceil(4n/5) of
   these at most are in no other set; documents with more have no link and go
   (`_suspects`).  What hashes lie below a bound is the same for all documents.
3. The others' whole sets are counted.  A document goes if over a fifth of its
   shingles occur in no other set.  Under any fixed order of all shingles a
   linked pair shares one of the first n - ceil(4n/5) + 1 of its own; they are
   taken in order of how many sets hold them, so that common lines and passages
   come last (`_first_tokens`).
4. Documents that share one of those are put into one group by components on
   tables: rows grow with documents, never with pairs.  A group of at most
   MOST_SHINGLES is compared in one task, set by set (`join_group`).
5. A larger group is taken apart first.  Jaccard distance is a metric: a member
   whose distance from a pivot is d and links it to the pivot has no other link
   to what lies beyond d + 1/5 of the pivot.  So members linked to a pivot go
   from the group unless a member that is not linked lies so near (`_retire`).
   What is left is parted by the shared shingle, and a part that is still too
   large is dealt into blocks of which each two meet in a task (`_parted`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrow_text import LOWER, slices, split_words
from .components import connected_components, spread_join
from .session import cut, partitions, release
from .simhash import components_by_key, first_of_each, majority_bits, near_links, shingle_hashes

SHINGLE_WORDS, RADIUS = 5, 2
#: Three tenths of all hashes lie below.  It decides how many documents need their whole sets compared, not which pairs are found.
BELOW = -(2**63) + 3 * 2**64 // 10
#: Rows that hot tokens are told by, how many of them have a hot token, parts it is counted in, and what its count is held for.
SAMPLED, HOT_SETS, PARTS, HOT = 4_000, 8, 997, 1 << 40
#: Shingles of the sets that one task compares, a set larger than that apart (8 bytes each), and times that pivots are taken from larger groups.
MOST_SHINGLES, PIVOTS = 1_000_000, 6


def document_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingle hashes in ascending order, and where each text's begin."""
    hashes, starts = shingle_hashes(split_words(texts, LOWER), SHINGLE_WORDS)
    hashes, doc = hashes.view(np.int64), np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[first], np.searchsorted(doc[first], np.arange(len(starts)))


SKETCH = "doc_id long, fp long, sim long, n long, hashes array<long>"


def _hashed(docs: DataFrame, whole: bool) -> DataFrame:
    """SKETCH rows: a hash of the document's set, its fingerprint, its size, and the set or its part below BELOW."""
    names = [f.split()[0] for f in SKETCH.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                sets, starts = document_sets(part.column("text"))
                n = np.diff(starts)
                fp = np.array([xxhash.xxh64_intdigest(sets[a:b].tobytes()) for a, b in zip(starts[:-1], starts[1:], strict=True)], np.uint64).view(np.int64)
                sim = majority_bits(sets.view(np.uint64), starts).view(np.int64)
                if not whole:
                    low = sets < BELOW
                    sets, starts = sets[low], np.concatenate(([0], np.cumsum(low)))[starts]
                held = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(sets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fp), pa.array(sim), pa.array(n, pa.int64()), held], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SKETCH)


def sketches(docs: DataFrame) -> DataFrame:
    """SKETCH rows of every document, hashes being the part of the set below BELOW; documents with equal sets have equal fp and sim."""
    return _hashed(docs, whole=False)


def _missing(n: Column) -> Column:
    """How many of n shingles a linked set may lack."""
    return n - F.ceil(n * 4 / 5)


def _tokens(sets: DataFrame, name: str) -> DataFrame:
    """Rows `(.., hashes)` -> `(.., token, hot, part)`, a row for each token.

    Tokens of very many rows are told by a sample of about SAMPLED rows, in which
    HOT_SETS or more have them: these are hot, and parted further by `name`.
    """
    rate = min(1.0, SAMPLED / max(sets.count(), 1))
    picked = sets.where(F.pmod(F.xxhash64(name), F.lit(1 << 30)) < int(rate * (1 << 30)))
    hot = cut(picked.select(F.explode("hashes").alias("token")).groupBy("token").count().where(F.col("count") >= HOT_SETS).select("token", F.lit(True).alias("hot")))
    rows = sets.withColumn("token", F.explode("hashes")).drop("hashes").join(F.broadcast(hot), "token", "left")
    return rows.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64(name), F.lit(PARTS)).cast("int")))


def _suspects(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """`(fp, node)` of the sets whose hashes below BELOW do not rule out a link."""
    named = prints.where("doc_id IS NOT NULL AND n > 0")
    token = W.partitionBy("token", "part")
    rows = _tokens(named.select("doc_id", "fp", "hashes"), "doc_id").select("fp", "token", "hot", F.min("fp").over(token).alias("lo"), F.max("fp").over(token).alias("hi"))
    # a hot token may be in copies of one set alone: it then keeps a set too many, never one too few
    shared = rows.where("hot OR lo != hi").groupBy("fp", "token").agg(F.lit(1).alias("one")).groupBy("fp").agg(F.count("*").alias("c"))
    sizes = named.groupBy("fp").agg(F.max("n").alias("n"), F.max(F.size("hashes")).alias("s"))
    left = sizes.join(shared, "fp", "left").where(F.col("s") - F.coalesce("c", F.lit(0)) <= _missing(F.col("n")))
    return nodes.join(left, "fp", "left_semi")


def _first_tokens(sets: DataFrame) -> DataFrame:
    """`(node, token)`: of distinct sets that may have a link, the shingles of which a linked pair shares one."""
    counted = _tokens(sets, "fp").withColumn("df", F.count("*").over(W.partitionBy("token", "part")))
    # one order of all tokens: hot ones, which several sets have for certain, come last, and among themselves by token
    order = F.when(F.col("hot"), F.lit(HOT)).otherwise(F.col("df"))
    shared = counted.withColumn("df", order).where("df > 1").groupBy("node", "fp", "n").agg(F.count("*").alias("c"), F.collect_list(F.struct("df", "token")).alias("held")).where("5 * c >= 4 * n")
    # shingles that no other set holds come first
    first = F.slice(F.sort_array("held"), 1, (_missing(F.col("n")) + 1 - F.col("n") + F.col("c")).cast("int"))
    return shared.select("node", F.explode(first).alias("x")).select("node", F.col("x.token").alias("token"))


def _groups(picked: DataFrame) -> DataFrame:
    """`(node, token)` -> `(node, v)`, v the smallest node of node's group; each linked pair is in one group."""
    least = picked.groupBy("token").agg(F.min("node").alias("v"), F.max("node").alias("w"), F.count("*").alias("n")).where("v != w")
    linked = spread_join(picked, least, "token", picked.count())
    found = connected_components(linked.select(F.col("node").alias("u"), "v")).withColumnRenamed("u", "node")
    return found.unionAll(found.select(F.col("v").alias("node"), "v").distinct())


def join_group(sets: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each set of a group the position of its component's first member under similarity 4/5; components are exact.

    Members reached from a set leave those still to be compared, so a dense
    group takes about one pass.
    """
    size = np.diff(starts)
    _, codes = np.unique(sets, return_inverse=True)
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
    root = np.arange(len(size))
    rest, held = np.arange(1, len(size)), codes[starts[1] :]
    todo, at = [0], 0
    while len(rest):
        i = todo.pop() if todo else None
        if i is None:
            at = i = int(rest[0])
            held, rest = held[size[i] :], rest[1:]
            if not len(rest):
                break
        mark[codes[starts[i] : starts[i + 1]]] = True
        ends = np.cumsum(size[rest])
        common = np.add.reduceat(mark[held], ends - size[rest], dtype=np.int64)
        mark[codes[starts[i] : starts[i + 1]]] = False
        near = 9 * common >= 4 * (size[rest] + size[i])
        if near.any():
            root[rest[near]] = at
            todo += rest[near].tolist()
            held, rest = held[np.repeat(~near, size[rest])], rest[~near]
    return root


def _near(a: Column, b: Column) -> tuple[Column, Column]:
    """Whether two sets are linked, and their Jaccard distance."""
    common, sizes = F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)
    return 9 * common >= 4 * sizes, 1 - common / (sizes - common)


def _retire(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(key, salts, node, hashes)` -> links `(u, v)` to each key's pivot, and the members that may have other links; a key's members meet in `salts` parts."""
    by_hash = F.struct(F.xxhash64("node").alias("h"), "node")
    pivots = members.groupBy("key").agg(F.min(by_hash)["node"].alias("node")).join(members, ["key", "node"]).select("key", "salts", F.col("node").alias("pivot"), F.col("hashes").alias("own"))
    salts = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    linked, distance = _near(F.col("hashes"), F.col("own"))
    seen = members.withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int")).join(pivots.withColumn("salt", salts).drop("salts"), ["key", "salt"])
    seen = cut(seen.select("key", "salt", "salts", "node", "hashes", "pivot", linked.alias("linked"), distance.alias("d")))
    beyond = seen.groupBy("key").agg(F.first("salts").alias("salts"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("next")).where("next IS NOT NULL")
    # the margin keeps what rounding could have put on the wrong side
    stay = seen.join(beyond.withColumn("salt", salts).drop("salts"), ["key", "salt"]).where(~F.col("linked") | (F.col("d") + 0.2 + 1e-9 >= F.col("next")))
    links = seen.where("linked AND node != pivot").select(F.greatest("node", "pivot").alias("u"), F.least("node", "pivot").alias("v"))
    return links, stay.where("node != pivot").select("key", "salts", "node", "hashes")


def _parted(members: DataFrame, picked: DataFrame) -> DataFrame:
    """Members of groups that are too large, once for each shared shingle, or once for each two blocks of those that share it."""
    by_token = members.join(picked, "node").select(F.xxhash64("key", "token").alias("key"), "node", "hashes")
    sizes = by_token.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.size("hashes")).alias("size")).where("n > 1")
    blocks = F.when(F.col("size") > MOST_SHINGLES, F.ceil(2 * F.col("size") / MOST_SHINGLES)).otherwise(F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("node", F.lit(1)), F.col("blocks")).cast("int")
    dealt = by_token.join(sizes.select("key", blocks.alias("blocks")), "key").withColumn("own", own)
    other = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return other.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "node", "hashes")


def _compared(members: DataFrame) -> DataFrame:
    """`(key, node, hashes)` -> links `(u, v)`: each key's members, compared in one task."""

    def links(node: list, hashes: list) -> pa.RecordBatch:
        node = np.concatenate(node)
        sizes = np.concatenate([np.diff(h.offsets.to_numpy()) for h in hashes])
        root = join_group(np.concatenate([h.flatten().to_numpy() for h in hashes]), np.concatenate(([0], np.cumsum(sizes))))
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[root[linked]])], ["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashes, group = [], [], None
        for batch in batches:
            ids = batch.column("key").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(ids)) + 1, [len(ids)]))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if ids[a] != group and node:
                    yield links(node, hashes)
                    node, hashes = [], []
                group = ids[a]
                node.append(batch.column("node").to_numpy()[a:b])
                hashes.append(batch.column("hashes").slice(a, b - a))
        if node:
            yield links(node, hashes)

    return members.select("key", "node", "hashes").repartition(partitions(members.sparkSession), "key").sortWithinPartitions("key", "node").mapInArrow(join, "u long, v long")


def similar_links(docs: DataFrame, prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links `(u, v)` between nodes; their components are those of all pairs of similarity 4/5 or more."""
    suspects = cut(_suspects(prints, nodes))
    release(docs.sparkSession)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    held = _hashed(named.join(suspects.select(F.col("node").alias("doc_id")), "doc_id", "left_semi"), whole=True)
    # rows of the same doc_id may differ in their text
    sets = cut(held.withColumnRenamed("doc_id", "node").join(suspects, ["node", "fp"]).dropDuplicates(["node", "fp"]).select("node", "fp", "n", "hashes"))
    picked = cut(_first_tokens(sets))
    release(docs.sparkSession)
    groups = cut(_groups(picked).withColumnRenamed("v", "key"))
    sizes = sets.select("node", "n").join(groups, "node").groupBy("key").agg(F.sum("n").alias("size"))
    over = cut(sizes.where(F.col("size") > MOST_SHINGLES).select("key", F.ceil(F.col("size") / MOST_SHINGLES).cast("int").alias("salts")))
    if over.isEmpty():
        return _compared(sets.select("node", "hashes").join(groups, "node"))
    found = _compared(sets.select("node", "hashes").join(groups.join(over, "key", "left_anti"), "node"))
    left = cut(sets.select("node", "hashes").join(groups.join(over, "key"), "node").select("key", "salts", "node", "hashes"))
    for _ in range(PIVOTS):
        links, left = _retire(left)
        found, left = found.unionAll(links), cut(left)
        if left.isEmpty():
            return found
    return found.unionAll(_compared(_parted(left.drop("salts"), picked)))


def _fingerprint_links(prints: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links `(u, v)` between nodes whose fingerprints are within RADIUS bits."""
    sims = prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("sim").alias("sim"))
    held = cut(nodes.join(sims, "fp").select("sim", "node"))
    points = held.groupBy("sim").agg(F.min("node").alias("v"))
    equal = held.join(points, "sim").where("node != v").select(F.col("node").alias("u"), "v")
    return near_links(points.select(F.col("sim").alias("fp"), F.col("v").alias("node")), RADIUS).unionAll(equal)


def similar_components(docs: DataFrame) -> DataFrame:
    """`(doc_id, fp, component_id)`: the smallest doc_id reachable through links; texts without words are alike."""
    prints = cut(sketches(docs))
    return components_by_key(prints.select("doc_id", "fp"), lambda nodes: similar_links(docs, prints, nodes).unionAll(_fingerprint_links(prints, nodes)))


def deduplicate(docs: DataFrame) -> DataFrame:
    """Rows of one document for each group of near copies, the one with the smallest doc_id; repeats of it are kept once, rows without doc_id stay."""
    return first_of_each(docs, similar_components(docs))
