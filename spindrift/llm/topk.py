"""Exact top-k inner-product search in three phases with a uniform threshold.

A vector's components are dealt to LISTS lists; its score is the sum of its
partial scores over the lists.

1. Every task names, for each query and list, its k vectors with the highest
   partial scores, and their full scores.  The k-th highest of a query's full
   scores over all tasks is a cutoff that k vectors are known to reach.
2. The cutoffs are broadcast.  A vector that reaches the cutoff has a partial
   score of at least cutoff / LISTS in some list, so only such entries are
   collected; an entry's missing partial scores are below that threshold, which
   bounds its full score from above and drops most entries.
3. What is left is scored in full.  Each task sends its k best of them.

Queries come in blocks of a fixed size, so what is broadcast is bounded; every
block is held against all vectors, a slice of them at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .session import cut, read

LISTS, QUERY_BLOCK, SLICE = 4, 1024, 512
_LOWEST, _HIGHEST = -(2**63), 2**63 - 1


def quantised(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors and floor(256 x) of their components; shorter vectors are filled up with zeros.

    A vector takes no part if it or a component is null, or a component isn't finite.
    """
    lists = column.cast(pa.large_list(pa.float64()))
    starts, sizes = np.asarray(lists.offsets)[:-1], np.diff(np.asarray(lists.offsets))
    starts = starts - np.asarray(lists.offsets)[0]
    flat = lists.flatten()
    with np.errstate(over="ignore", invalid="ignore"):
        values = np.floor(256.0 * flat.to_numpy(zero_copy_only=False).astype(np.float64))
    wrong = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
    usable = np.flatnonzero(~np.asarray(column.is_null()) & (wrong[starts + sizes] == wrong[starts]))
    out = np.zeros((len(usable), int(sizes[usable].max(initial=0))))
    for n in np.unique(sizes[usable]):
        rows = np.flatnonzero(sizes[usable] == n)
        out[rows[:, None], np.arange(n)] = values[starts[usable[rows]][:, None] + np.arange(n)]
    return usable, out


def partial_scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Integer inner products by list, (LISTS, queries, rows); in whole numbers of any size where doubles could round."""
    width = min(queries.shape[1], rows.shape[1])
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(width, 1)
    if most >= 2.0**53:
        queries, rows = (np.array([[int(v) for v in r] for r in m], object).reshape(m.shape) for m in (queries, rows))
    return np.stack([queries[:, a] @ rows[:, a].T if width else np.zeros((len(queries), len(rows))) for a in (slice(j * width // LISTS, (j + 1) * width // LISTS) for j in range(LISTS))])


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


class QueryBlock:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.cutoff = np.full(len(ids), float("-inf"), object)

    def _slices(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        usable, rows = quantised(batch.column("embedding"))
        ids = batch.column("vec_id").to_numpy(zero_copy_only=False)[usable]
        for a in range(0, len(ids), SLICE):
            scores = partial_scores(self.vectors, rows[a : a + SLICE])
            yield ids[a : a + SLICE], scores

    def gather(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phase 1: (query, score) of the k best vectors among those that lead a list."""
        lead: list[np.ndarray] = [np.zeros(0)] * len(self.ids)
        for batch in batches:
            for ids, parts in self._slices(batch):
                full = _held(parts.sum(0))
                if parts.dtype == object:
                    order = np.argsort(-parts, axis=2, kind="stable")[:, :, : self.k + 1]
                else:
                    top = min(self.k + 1, len(ids))
                    order = np.argpartition(-parts, top - 1, axis=2)[:, :, :top]
                for q in range(len(self.ids)):
                    named = np.unique(order[:, q])
                    named = named[ids[named] != self.ids[q]]
                    lead[q] = -np.sort(-np.concatenate((lead[q], full[q, named])))[: self.k]
        query = np.repeat(np.arange(len(self.ids)), [len(x) for x in lead])
        yield pa.RecordBatch.from_arrays([pa.array(query, pa.int32()), _longs(np.concatenate(lead) if lead else np.zeros(0))], ["query", "score"])

    def resolve(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phases 2 and 3: (query_id, vec_id, score) of the k best vectors that reach the cutoff."""
        held = [(np.zeros(0), np.zeros(0, np.int64))] * len(self.ids)
        cutoff = self.cutoff.astype(float)
        for batch in batches:
            for ids, parts in self._slices(batch):
                if parts.dtype == object:
                    # whole numbers of any size: every entry is scored in full
                    entries = np.ones(parts.shape[1:], bool)
                else:
                    threshold = (cutoff / LISTS)[:, None]
                    above = parts >= threshold
                    bound = np.where(above, parts, threshold).sum(0)
                    entries = above.any(0) & (bound >= cutoff[:, None])
                q, r = np.nonzero(entries & (ids[None, :] != self.ids[:, None]))
                full = _held(parts[:, q, r].sum(0))
                least = self.cutoff if parts.dtype == object else cutoff
                kept = np.flatnonzero((full >= least[q]).astype(bool))
                q, r, full = q[kept], r[kept], full[kept]
                edges = np.searchsorted(q, np.arange(len(self.ids) + 1))
                for i in np.unique(q):
                    s = np.concatenate((held[i][0], full[edges[i] : edges[i + 1]]))
                    v = np.concatenate((held[i][1], ids[r[edges[i] : edges[i + 1]]]))
                    best = _best(s, v, self.k)
                    held[i] = (s[best], v[best])
        columns = [np.repeat(self.ids, [len(v) for _, v in held]), np.concatenate([v for _, v in held]).astype(np.int64) if held else np.zeros(0, np.int64)]
        yield pa.RecordBatch.from_arrays([*map(pa.array, columns), _longs(np.concatenate([s for s, _ in held]) if held else np.zeros(0))], ["query_id", "vec_id", "score"])


def _held(values: np.ndarray) -> np.ndarray:
    """Scores beyond 64 bits at the limit; they then tie with one another."""
    return values if values.dtype != object else np.clip(values, _LOWEST, _HIGHEST)


def _longs(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.int64) if values.dtype != object else [int(v) for v in values], pa.int64())


def search(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """`(vec_id, embedding)` of either kind -> `(query_id, rank, vec_id, score)`.

    A query never returns a vector of its own vec_id.  Queries that share a
    vec_id are answered once, for the least of their usable vectors.
    """
    spark = vectors.sparkSession
    usable = F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x * 256.0) < float("inf")))
    known = queries.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & usable).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-known.count() // QUERY_BLOCK))
    known = known.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    known = cut(known) if blocks > 1 else known
    named = vectors.where("vec_id IS NOT NULL").select("vec_id", "embedding")
    found = []
    for block in range(blocks):
        own = known.where(F.col("block") == block).select("vec_id", "embedding").orderBy("vec_id").toArrow().combine_chunks()
        usable, rows = quantised(own.column("embedding").combine_chunks())
        task = QueryBlock(own.column("vec_id").to_numpy()[usable], rows, k)
        held = spark.sparkContext.broadcast(task)
        leaders = named.mapInArrow(lambda b, held=held: held.value.gather(b), "query int, score long")
        kth = F.get(F.sort_array(F.collect_list("score"), asc=False), F.lit(k - 1))
        for r in leaders.groupBy("query").agg(kth.alias("cutoff")).where("cutoff IS NOT NULL").collect():
            task.cutoff[r["query"]] = r["cutoff"]
        held = spark.sparkContext.broadcast(task)
        found.append(named.mapInArrow(lambda b, held=held: held.value.resolve(b), "query_id long, vec_id long, score long"))
    each = found[0]
    for more in found[1:]:
        each = each.unionAll(more)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return each.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best vectors for every vector whose vec_id is divisible by 50.

    Vectors that are null, or hold a null or non-finite component, or one that
    256 times itself is no longer finite, take no part, nor do rows without
    vec_id; a shorter vector counts as filled up with zeros; repeated rows are
    candidates each, other than for a query of their own vec_id, and of several
    usable rows of a query's vec_id the least vector asks; scores beyond 64 bits
    are held at the limit before they are ranked; an empty table gives no rows;
    further columns are not read.
    """
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return search(rows, rows.where("vec_id % 50 = 0"), 5)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, embedding, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(256 * x::DOUBLE))) = 0
), q AS (
  SELECT vec_id, list_transform(min(embedding), lambda x: floor(256 * x::DOUBLE)) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM q JOIN v c ON q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
