"""Bounded memories: similarity, top-k read-out, usage and eviction, within a group key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import ranked_values


def similarity(key: Column, query: Column, shrinkage: Column | None = None, selection: Column | None = None) -> Column:
    """-(sum over channels of selection * (key - query)^2), times shrinkage, over the root of their number.

    Without a selection the query's own square, equal for all keys, is left out.
    """
    size = F.sqrt(F.size(key).cast("double"))
    if selection is None:
        each = F.zip_with(key, query, lambda a, b: 2 * a * b - a * a)
    else:
        each = F.transform(F.arrays_zip(key.alias("a"), query.alias("b"), selection.alias("e")), lambda s: -s["e"] * (s["a"] - s["b"]) * (s["a"] - s["b"]))
    total = F.aggregate(each, F.lit(0.0), lambda a, x: a + x)
    return total * (F.lit(1.0) if shrinkage is None else shrinkage) / size


def best_elements(memory: DataFrame, queries: DataFrame, element: str, key: str, query: str, query_key: str, k: int, block: int = 2048) -> DataFrame:
    """`(query, element, score)` of the k elements most similar to each query, other than the one of its own name.

    Elements and queries are packed into blocks, and each block of one meets each
    block of the other as one row, whose scores are one matrix product; it hands
    on its k best of each query, so nothing grows with the pairs but arithmetic.
    Elements of very many blocks are dealt over tasks by block.
    """
    import numpy as np
    import pandas as pd

    def packed(df: DataFrame, id_: str, vector: str, name: str) -> tuple[DataFrame, int]:
        n = max(1, -(-df.count() // block))
        rows = df.select(F.pmod(F.xxhash64(id_), F.lit(n)).cast("int").alias(name), F.struct(F.col(id_).alias("id"), F.col(vector).alias("v")).alias("x"))
        held = rows.groupBy(name).agg(F.collect_list("x").alias("x"))
        return held.select(name, F.col("x.id").alias(f"{name}_id"), F.flatten("x.v").alias(f"{name}_v")), n

    (elements, _), (asked, n) = packed(memory, element, key, "element"), packed(queries, query, query_key, "asked")
    pairs = elements.withColumn("asked", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(asked, "asked")

    def run(batches):
        for pdf in batches:
            for r in pdf.itertuples():
                q, e = np.reshape(r.asked_v, (len(r.asked_id), -1)), np.reshape(r.element_v, (len(r.element_id), -1))
                score = np.round((2 * q @ e.T - (e * e).sum(1)) / np.sqrt(e.shape[1]), 10)
                score[np.asarray(r.asked_id)[:, None] == np.asarray(r.element_id)[None, :]] = -np.inf
                best = np.array([np.lexsort((r.element_id, -s))[:k] for s in score])
                found = np.take_along_axis(score, best, 1)
                kept = np.isfinite(found)
                yield pd.DataFrame({query: np.repeat(r.asked_id, kept.sum(1)), element: np.asarray(r.element_id)[best[kept]], "score": found[kept]})

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    return pairs.select("asked_id", "asked_v", "element_id", "element_v").mapInPandas(run, f"`{query}` {kind(queries, query)}, `{element}` {kind(memory, element)}, score double")


def top_k_weights(scores: DataFrame, query: list[str], element: str, score: str, k: int) -> DataFrame:
    """The k best elements of each query with softmax `weight`."""
    w = W.partitionBy(*query)
    best = scores.withColumn("rank", F.row_number().over(w.orderBy(F.desc(score), element))).where(F.col("rank") <= k)
    e = F.exp(F.col(score) - F.max(score).over(w))
    return best.withColumn("e", e).withColumn("weight", F.col("e") / F.sum("e").over(w)).drop("e")


def read_out(weights: DataFrame, query: list[str], value: str) -> DataFrame:
    """Weighted sums of the elements' value vectors."""
    rows = weights.select(*query, "weight", F.posexplode(value).alias("dim", "v"))
    sums = rows.groupBy(*query, "dim").agg(F.sum(F.col("weight") * F.col("v")).alias("v"))
    return sums.groupBy(*query).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda s: s["v"]).alias("read"))


def usage(weights: DataFrame, element: str) -> DataFrame:
    """Weight each element received."""
    return weights.groupBy(element).agg(F.sum("weight").alias("use"))


def evict_least_used(memory: DataFrame, group: str, use: str, life: str, most: int) -> DataFrame:
    """Elements of each group used more, for their life, than the last of the surplus; ties with it go too.

    Groups are few and large: the last one's ratio comes from histograms, so no group is ranked.
    """
    rated = memory.withColumn("ratio", F.col(use) / F.col(life))
    limits = ranked_values(rated, F.col("ratio"), [group], lambda n: n - most - 1).select(group, F.col("value").alias("limit"))
    return rated.join(F.broadcast(limits), group).where(F.col("limit").isNull() | (F.col("ratio") > F.col("limit"))).drop("ratio", "limit")


def sieve(memory: DataFrame, group: str, position: str, start: int, end: int) -> DataFrame:
    """Elements outside of places [start, end) of each group, in order of position; end 0 is the last place's end, a negative one counts from there."""
    w = W.partitionBy(group)
    placed = memory.withColumns({"place": F.row_number().over(w.orderBy(position)) - 1, "n": F.count(F.lit(1)).over(w)})
    stop = F.col("n") + end if end <= 0 else F.lit(end)
    return placed.where((F.col("place") < start) | (F.col("place") >= stop)).drop("place", "n")


def prototypes(memory: DataFrame, group: str, use: str, life: str, id_: str, most: int = 128) -> DataFrame:
    """The elements of each group most used for their life."""
    rank = F.row_number().over(W.partitionBy(group).orderBy(F.desc(F.col(use) / F.col(life)), id_))
    return memory.withColumn("rank", rank).where(F.col("rank") <= most)


def consolidate(memory: DataFrame, group: str, id_: str, key: str, value: str, use: str, life: str, most: int = 128) -> DataFrame:
    """Prototypes whose values are read anew from all elements of their group, by softmax of similarity."""
    p = prototypes(memory, group, use, life, id_, most).select(group, F.col(id_).alias("proto"), F.col(key).alias("proto_key"))
    pairs = p.join(memory.select(group, id_, key, value), group)
    scored = pairs.withColumn("score", similarity(F.col(key), F.col("proto_key")))
    w = W.partitionBy(group, "proto")
    e = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    weighed = e.withColumn("weight", F.col("e") / F.sum("e").over(w))
    read = read_out(weighed, [group, "proto"], value)
    return p.join(read, [group, "proto"]).select(group, F.col("proto").alias(id_), F.col("proto_key").alias(key), F.col("read").alias(value))
