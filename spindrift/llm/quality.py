"""Quality classifier: random-indexing word vectors, pooled per document, under a two-layer network.

Each of `2 ** BITS` word buckets has a fixed sparse vector of +1 and -1.  A
word's vector is the sum of the fixed vectors of the words within REACH places
of it, over every document.  A document's vector is the mean, and the spread, of
its words' vectors, frequent words counting less.  The network is trained on a
bounded sample of labelled rows, and a temperature fitted on a part set aside
calibrates its probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import PLAIN, Words, hash_words, slices, split_words, sum_by_doc
from .language_id import fit_temperature, remainder
from .session import partitions, read, wider

BITS, WIDTH, NONZERO, REACH = 15, 32, 4, 2
#: Buckets summed together in one row of partial sums.
STRIP = 256
#: Labelled rows that the network is fitted on, half of either class at most.
TRAINING_ROWS = 6000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 32, 60, 64, 3e-3, 1e-4
THRESHOLD = 0.3
#: Bytes of text whose words' vectors are held at once.
SLICE = 400_000


def index_vectors() -> np.ndarray:
    """The fixed vectors of all buckets, and a last one of zeros."""
    rng = np.random.default_rng(12345)
    out = np.zeros(((1 << BITS) + 1, WIDTH), np.int8)
    for row in range(1 << BITS):
        out[row, rng.choice(WIDTH, NONZERO, replace=False)] = rng.choice((-1, 1), NONZERO)
    return out


def buckets(words: Words) -> np.ndarray:
    distinct, of_word = words.encoded()
    return (hash_words(distinct) >> np.uint64(64 - BITS)).astype(np.uint16)[of_word]


def _contexts(words: Words, at: np.ndarray, fixed: np.ndarray) -> np.ndarray:
    """For each word the sum of its neighbours' fixed vectors; REACH empty places part documents."""
    place = np.arange(len(at)) + REACH * (1 + words.doc_of_word())
    row = np.full(len(at) + REACH * (len(words.starts) + 1), 1 << BITS, np.int32)
    row[place] = at
    out = np.zeros((len(at), WIDTH), np.int8)
    for d in (d for d in range(-REACH, REACH + 1) if d):
        out += fixed[row[place + d]]
    return out


def word_vectors(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Every bucket's summed contexts and its number of words, over all texts.

    Tasks send sums by strip of buckets; strips are added up as they stream in,
    so the driver gets one matrix of a fixed size however many rows there are.
    """
    spark = docs.sparkSession
    fixed = spark.sparkContext.broadcast(index_vectors())

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << BITS, WIDTH + 1), np.int64)
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                words = split_words(part.column("text"), PLAIN)
                at = buckets(words)
                if not len(at):
                    continue
                order = np.argsort(at, kind="stable")
                ranked = at[order]
                first = np.flatnonzero(np.append(True, np.diff(ranked) > 0))
                total[ranked[first], :WIDTH] += np.add.reduceat(_contexts(words, at, fixed.value)[order], first, axis=0, dtype=np.int32)
                total[ranked[first], WIDTH] += np.diff(np.append(first, len(ranked)))
        strips = [s for s in range(0, 1 << BITS, STRIP) if total[s : s + STRIP].any()]
        # a task's sums mostly fit 32 bits; those that don't are sent as several rows
        while strips:
            now = np.clip(total, -(2**31) + 1, 2**31 - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(strips, pa.int32()), pa.array([now[s : s + STRIP].tobytes() for s in strips], pa.binary())], ["strip", "sums"])
            total -= now
            strips = [s for s in strips if total[s : s + STRIP].any()]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for strip, sums in zip(batch.column("strip").to_pylist(), batch.column("sums").to_pylist(), strict=True):
                held[strip] = held.get(strip, 0) + np.frombuffer(sums, np.int32).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())], ["strip", "sums"])

    schema = "strip int, sums binary"
    summed = docs.select(F.col("text").cast("string")).mapInArrow(gather, schema).repartition(partitions(spark), "strip").mapInArrow(add, schema).toArrow()
    out = np.zeros((1 << BITS, WIDTH + 1), np.int64)
    for strip, sums in zip(summed["strip"].to_pylist(), summed["sums"].to_pylist(), strict=True):
        out[strip : strip + STRIP] += np.frombuffer(sums, np.int64).reshape(STRIP, WIDTH + 1)
    return out[:, :WIDTH].astype(np.float64), out[:, WIDTH].astype(np.float64)


def pooling_table(sums: np.ndarray, counts: np.ndarray, damp: float = 1e-3) -> np.ndarray:
    """For each bucket its unit vector times its weight, the vector's squares times the weight, and the weight."""
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    weight = damp / (damp + counts / max(counts.sum(), 1))
    return np.concatenate([unit * weight[:, None], unit**2 * weight[:, None], weight[:, None]], axis=1).astype(np.float32)


def pool(texts: pa.Array, table: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors; zeros for a text without words."""
    words = split_words(texts, PLAIN)
    total = sum_by_doc(table[buckets(words)].astype(np.float64), words.starts)
    mean = total[:, :-1] / np.maximum(total[:, -1:], 1e-12)
    return np.concatenate([mean[:, :WIDTH], np.sqrt(np.maximum(mean[:, WIDTH:] - mean[:, :WIDTH] ** 2, 0))], axis=1)


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a calibrated probability."""

    centre: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return (np.maximum((x - self.centre) / self.scale @ w1 + b1, 0) @ w2 + b2)[:, 0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def fit_network(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 3) -> Network:
    """Adam on the weighted log loss; a fifth of the rows, set aside, picks the temperature."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 5], order[len(y) // 5 :]
    layers = [rng.normal(0, np.sqrt(2 / x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, np.sqrt(1 / HIDDEN), (HIDDEN, 1)), np.zeros(1)]
    net = Network(x[used].mean(0) if len(used) else np.zeros(x.shape[1]), x[used].std(0) + 1e-6 if len(used) else np.ones(x.shape[1]), layers)
    first, second, step = [np.zeros_like(w) for w in layers], [np.zeros_like(w) for w in layers], 0
    inputs = (x - net.centre) / net.scale
    for _ in range(EPOCHS if len(used) else 0):
        for rows in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            w1, b1, w2, b2 = layers
            hidden = np.maximum(inputs[rows] @ w1 + b1, 0)
            p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -60, 60)))
            up = (p - y[rows, None]) * weight[rows, None] / len(rows)
            back = (up @ w2.T) * (hidden > 0)
            grads = [inputs[rows].T @ back + DECAY * w1, back.sum(0), hidden.T @ up + DECAY * w2, up.sum(0)]
            step += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                layers[i] -= RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    logit = net.logits(x[aside])
    net.temperature = fit_temperature(np.stack([np.zeros_like(logit), logit], axis=1), y[aside].astype(int))
    return net


@dataclass
class QualityModel:
    table: np.ndarray
    network: Network

    def scores(self, texts: pa.Array) -> np.ndarray:
        return self.network.scores(pool(texts, self.table))


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> QualityModel:
    """Word vectors of all `docs`, and a network of those that `(doc_id, quality)` labels; null labels are left out.

    The sample is picked by hash of doc_id: rows of the rarer class first, up to
    half of `most`, the other rows at an equal rate; its rows are few by that
    bound, so they are broadcast and no text is shuffled.
    """
    table = pooling_table(*word_vectors(docs))
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") > 0).cast("int")).alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    rate = {label: min(1.0, most / 2 / n) for label, n in counts.items()}
    limit = F.when(F.col("label") == 1, int(rate.get(1, 0) * (1 << 30))).otherwise(int(rate.get(0, 0) * (1 << 30)))
    sample = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < limit)
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                x = pool(part.column("text"), shared.value)
                yield pa.RecordBatch.from_arrays([part.column("label"), pa.array([row.tobytes() for row in x], pa.binary())], ["label", "x"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(sample), "doc_id").select("label", "text")
    found = rows.mapInArrow(run, "label int, x binary").toArrow()
    pairs = sorted(zip(found["x"].to_pylist(), found["label"].to_pylist(), strict=True))
    x = np.array([np.frombuffer(v) for v, _ in pairs]).reshape(len(pairs), 2 * WIDTH)
    y = np.array([label for _, label in pairs], float)
    # both classes weigh as much as in the labels
    weight = np.where(y > 0, 1 / rate.get(1, 1), 1 / rate.get(0, 1)) if len(y) else y
    return QualityModel(table, fit_network(x, y, weight / weight.mean() if len(y) else weight))


def score(docs: DataFrame, model: QualityModel) -> DataFrame:
    """`docs` with `score`; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.scores(part.column("text")))], [*part.schema.names, "score"])

    return docs.mapInArrow(run, wider(docs, "score double"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, the probability of label 1.

    A null, empty or blank text has no words and gets the score of a zero
    vector; without any usable label every score is what the untrained network
    gives.  A row without doc_id is not learned from, nor held out; repeated
    rows give repeated rows; an empty table gives no rows.
    """
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    model = train(docs, read(spark, sf_dir, "labels").where(remainder(5) != 0))
    found = score(docs, model)
    return found.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
