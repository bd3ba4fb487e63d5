"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters of the lower-cased text, hashed to
`2 ** BITS` buckets.  A text's value in a bucket is its share of the text's
n-grams by weight, each n-gram weighing its bucket's inverse document
frequency.  Document frequencies come from every training row; the weights come
from follow-the-regularised-leader with L1 and L2 penalties, run over a bounded
sample, and a temperature fitted on the part of the sample that was set aside
makes the probabilities honest.

Values are linear in the n-grams, so a prediction adds up one table row for each
character and needs no counts by document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import slices, sum_by_doc
from .session import read, wider

BITS, SCALE = 15, 30.0
#: Rows that the weights are fitted on, spread evenly over languages.
TRAINING_ROWS = 3000
#: Step size, its damping, L1 and L2 penalties, passes over the sample.
ALPHA, BETA, L1, L2, EPOCHS = 0.3, 1.0, 1e-4, 1e-3, 4
UNKNOWN = "und"
#: The highest probability that a recognised text may be asked for.
MOST_SURE = 0.9
#: Bytes of text whose n-grams are held at once.
SLICE = 500_000


def ngram_buckets(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Buckets of the runs of 1, 2 and 3 characters that start at each character, and where each text's characters begin.

    Two marks follow each text, so no run crosses into the next one.
    """
    low = pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), ""))
    sizes = pc.utf8_length(low).to_numpy(zero_copy_only=False).astype(np.int64)
    chars = np.frombuffer(("\0\0".join(low.to_pylist()) + "\0\0").encode("utf-32-le"), np.uint32)
    starts = np.cumsum(sizes + 2) - (sizes + 2)
    one = chars * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (one[:-1] >> np.uint32(15)) ^ chars[1:]) * np.uint32(0x85EBCA77)
    three = (two[:-1] ^ (two[:-1] >> np.uint32(13)) ^ chars[2:]) * np.uint32(0xC2B2AE3D)
    return [(h >> np.uint32(32 - BITS)).astype(np.int32) for h in (one[:-2], two[:-1], three)], np.append(starts, len(chars))


def _document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """For each bucket the number of rows that have it, and the number of rows; one row of partial sums for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams, starts = ngram_buckets(part.column("text"))
                n += len(part)
                for a, b in zip(starts[:-1].tolist(), (starts[1:] - 2).tolist(), strict=True):
                    has = np.zeros(1 << BITS, bool)
                    for g in grams:
                        has[g[a:b]] = True
                    df += has
        filled = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(filled, -1)), pa.array(np.append(df[filled], n))], ["bucket", "n"])

    found = docs.select(F.col("text").cast("string")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    df, n = np.zeros(1 << BITS, np.int64), 0
    for bucket, count in zip(found["bucket"].to_pylist(), found["n"].to_pylist(), strict=True):
        if bucket < 0:
            n = count
        else:
            df[bucket] = count
    return df, n


def _sample(rows: DataFrame, most: int) -> DataFrame:
    """About `most` rows, as many of each language as there are up to an equal share; by hash of the row, so the same each time."""
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    share = most / max(len(counts), 1)
    limit = F.lit(0)
    for lang, n in counts.items():
        limit = F.when(F.col("lang") == lang, F.lit(int(min(1.0, share / n) * (1 << 30)))).otherwise(limit)
    return rows.where(F.pmod(F.xxhash64(*rows.columns), F.lit(1 << 30)) < limit)


def _features(rows: DataFrame) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(language, buckets, counts) of every row, on the driver: for the bounded sample only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams, starts = ngram_buckets(part.column("text"))
                found = [np.unique(np.concatenate([g[a:b] for g in grams]), return_counts=True) for a, b in zip(starts[:-1], starts[1:] - 2, strict=True)]
                columns = [pa.array([u.astype(np.int32).tobytes() for u, _ in found], pa.binary()), pa.array([n.astype(np.int32).tobytes() for _, n in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column("lang"), *columns], ["lang", "buckets", "counts"])

    table = rows.select("lang", "text").mapInArrow(run, "lang string, buckets binary, counts binary").toArrow()
    rows = [(lang, np.frombuffer(u, np.int32), np.frombuffer(n, np.int32)) for lang, u, n in zip(*(table[c].to_pylist() for c in ("lang", "buckets", "counts")), strict=True)]
    return sorted(rows, key=lambda r: (r[0], r[1].tobytes(), r[2].tobytes()))


@dataclass
class Ftrl:
    """Follow-the-regularised-leader over sparse rows; weights exist only as sums of gradients until they are asked for."""

    buckets: int
    classes: int
    z: np.ndarray = field(init=False)
    n: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.z = np.zeros((self.buckets, self.classes))
        self.n = np.zeros((self.buckets, self.classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = softmax(x @ w)
        p[label] -= 1
        g = x[:, None] * p
        total = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(total) - np.sqrt(self.n[at])) / ALPHA * w
        self.n[at] = total


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of the scores with the least log loss, of 200 between 1/20 and 20."""
    if not len(labels):
        return 1.0
    choices = np.geomspace(0.05, 20, 200)
    losses = [-np.log(np.maximum(softmax(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in choices]
    return float(choices[int(np.argmin(losses))])


@dataclass
class LanguageModel:
    """table: for each bucket its n-gram's weight, then that weight times each language's coefficient.

    sure: what the set-aside texts' likeliest languages have at least, MOST_SURE
    at most; a text with less is like none of them.
    """

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    sure: float = 0.0

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Position of the likeliest language, -1 for none, and its probability."""
        lettered = np.asarray(pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False))
        if not self.languages or not len(texts):
            return np.full(len(texts), -1), np.zeros(len(texts))
        grams, starts = ngram_buckets(texts)
        total = np.zeros((len(texts), self.table.shape[1]))
        keep = np.ones(starts[-1], bool)
        keep[starts[1:] - 1] = keep[starts[1:] - 2] = False
        bounds = starts - 2 * np.arange(len(starts))
        for g in grams:
            total += sum_by_doc(self.table[g[keep[: len(g)]]], bounds)
        scores = (total[:, 1:] / np.maximum(total[:, :1], 1e-9) * SCALE + self.bias) / self.temperature
        p = softmax(scores)
        best = p.argmax(1)
        return np.where(lettered, best, -1), np.where(lettered, p[np.arange(len(best)), best], 0.0)


def train(rows: DataFrame, most: int = TRAINING_ROWS) -> LanguageModel:
    """A model of the languages in `(doc_id, text, lang)` rows; rows with a null in either are left out."""
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"))
    df, n = _document_frequencies(rows)
    idf = np.log((1 + n) / (1 + df)) + 1
    sample = _features(_sample(rows, most))
    languages = sorted({lang for lang, _, _ in sample})
    if not languages:
        return LanguageModel([], np.zeros((1 << BITS, 1), np.float32), np.zeros(0), 1.0)
    examples = []
    for lang, at, counts in sample:
        if len(at):
            x = counts * idf[at]
            # the last bucket of the model is the bias
            examples.append((np.append(at, 1 << BITS), np.append(x / x.sum() * SCALE, 1.0), languages.index(lang)))
    order = np.random.default_rng(5).permutation(len(examples))
    aside = [examples[i] for i in order[: len(order) // 5]]
    ftrl = Ftrl((1 << BITS) + 1, len(languages))
    for _ in range(EPOCHS):
        for i in order[len(order) // 5 :]:
            ftrl.learn(*examples[i])
    w = ftrl.weights()
    scores = np.array([x @ w[at] for at, x, _ in aside]).reshape(len(aside), len(languages))
    temperature = fit_temperature(scores, np.array([label for _, _, label in aside], int))
    sure = min(MOST_SURE, float(softmax(scores / temperature).max(1).min())) if len(aside) else 0.0
    table = np.concatenate([idf[:, None], idf[:, None] * w[:-1]], axis=1)
    return LanguageModel(languages, table.astype(np.float32), w[-1], temperature, sure)


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """`docs` with `lang_pred` and `score`; the text alone decides."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array([*shared.value.languages, UNKNOWN], pa.string())
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                best, p = shared.value.predict(part.column("text").cast(pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns, names.take(pa.array(best % len(names))), pa.array(p)], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, wider(docs, "lang_pred string, score double"))


def remainder(by: int) -> Column:
    """crc32 of doc_id as text, modulo `by`."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % by


def train_on(docs: DataFrame) -> LanguageModel:
    """The contract's training rows: all but a third, by doc_id."""
    return train(docs.where(remainder(3) != 1))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document.

    A null text, and one without any letter, is `und` with score 0; so is every
    text if no row could be learned from.  A row without doc_id is neither
    learned from nor held out; repeated rows give repeated rows; an empty table
    gives no rows; a very long text counts whole.
    """
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), train_on(docs))
    return found.select("doc_id", F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
