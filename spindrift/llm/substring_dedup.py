"""Substring deduplication: suffix automata of reference shards, matched against streamed documents.

A window is `window` consecutive words of a document.  It is a repeat if the
same words also start in a document with a smaller doc_id; words of repeated
windows are removed.  All windows are judged on the input.

1. Every window is named by the smallest hash among its k-word runs (its
   anchor).  Equal windows have equal anchors, and neighbouring windows mostly
   share theirs, so a document has about 2 / (window - k + 2) anchors a word.
2. An anchor that occurs in one document only cannot hold a repeat.  The others
   belong to the smallest document that has them, their owner.  All documents
   that share a window thereby send it to the same owner.
3. A reference shard is the automaton of one owner's passages.  It goes to every
   task that holds documents of this owner; an owner with very many of them is
   dealt over several tasks by document.  Documents are streamed in order of
   doc_id: where the longest run that ends at a word reaches the window's
   length, a repeat ends, and passages not seen before are added to the shard.
4. Where an owner is dealt over several tasks, a passage new to one task may be
   in another.  Those windows alone are compared across tasks by a 128-bit hash,
   with a pre-aggregated minimum of doc_id.

No step gathers an anchor's, an owner's or a window's documents in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import PLAIN, Words, hash_words, ragged, slices, split_words
from .automaton import SuffixAutomaton
from .session import cut, partitions, read, row_key

WINDOW, RUN = 50, 10
#: Anchors of one owner in one task, at about (window - run + 2) / 2 words each.
OWNER_ANCHORS = 4000

_NONE = np.uint64(2**64 - 1)


def window_anchors(words: Words, window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Each document's windows' anchors, one after the other, and where each document's begin."""
    n = np.maximum(words.counts - window + 1, 0)
    starts = np.concatenate(([0], np.cumsum(n)))
    if not starts[-1]:
        return np.zeros(0, np.uint64), starts
    distinct, of_word = words.encoded()
    hashes = np.append(hash_words(distinct)[of_word], np.zeros(window, np.uint64))
    total = len(of_word)
    runs = np.zeros(total, np.uint64)
    for j in range(k):
        runs = runs * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + total]
    runs ^= runs >> np.uint64(29)
    runs *= np.uint64(0xBF58476D1CE4E5B9)
    runs ^= runs >> np.uint64(32)
    least, width = runs, 1
    span = window - k + 1
    while 2 * width <= span:
        least = np.minimum(least, np.append(least[width:], np.full(width, _NONE)))
        width *= 2
    rest = span - width
    least = np.minimum(least, np.append(least[rest:], np.full(rest, _NONE)))
    return least[ragged(words.starts[:-1], n)], starts


def _anchors(docs: DataFrame, window: int, k: int) -> DataFrame:
    """`(doc_id, anchor)`, once for each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                least, starts = window_anchors(split_words(part.column("text"), PLAIN), window, k)
                doc = np.repeat(np.arange(len(part)), np.diff(starts))
                order = np.lexsort((least, doc))
                doc, least = doc[order], least[order]
                new = np.ones(len(doc), bool)
                new[1:] = (np.diff(doc) > 0) | (least[1:] != least[:-1])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(doc[new])), pa.array(least[new].view(np.int64))], ["doc_id", "anchor"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, anchor long")


def _shared(anchors: DataFrame) -> DataFrame:
    """Per document its anchors that other documents have too, with their owners and the number of tasks an owner is dealt over."""
    owned = anchors.groupBy("anchor").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")).where("owner < last")
    # an owner has no more anchors than its own text holds, so this join meets no hot key
    deals = owned.groupBy("owner").agg(F.ceil(F.sum("n") / OWNER_ANCHORS).cast("int").alias("deals"))
    dealt = owned.select("anchor", "owner").join(deals, "owner")
    return anchors.join(dealt, "anchor").groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "owner", "deals")).alias("shared"))


PASSAGE = "owner long, deal int, deals int, doc_id long, text_hash long, start int, words string"


def _passages(docs: DataFrame, shared: DataFrame, window: int, k: int) -> DataFrame:
    """Stretches of windows with shared anchors, sent to their owners' tasks; an owner's own go to all of its tasks."""
    names = [f.split()[0] for f in PASSAGE.split(", ")]

    def rows(part: pa.RecordBatch) -> Iterator[tuple]:
        words = split_words(part.column("text"), PLAIN)
        least, starts = window_anchors(words, window, k)
        doc_ids, text_hashes = part.column("doc_id").to_pylist(), part.column("text_hash").to_pylist()
        lists = part.column("shared")
        bounds = np.asarray(lists.offsets)
        flat = lists.values
        anchor, owner, deals = (flat.field(i).to_numpy() for i in range(3))
        for i in np.flatnonzero(np.diff(starts)):
            a = slice(bounds[i], bounds[i + 1])
            order = np.argsort(anchor[a].view(np.uint64))
            known = anchor[a].view(np.uint64)[order]
            at = np.minimum(np.searchsorted(known, own := least[starts[i] : starts[i + 1]]), len(known) - 1)
            at = np.where(known[at] == own, order[at], -1)
            whose = np.where(at >= 0, owner[a][at], -1)
            edges = np.concatenate(([0], np.flatnonzero((np.diff(whose) != 0) | (np.diff(at < 0))) + 1, [len(at)]))
            text = words.flat[words.starts[i] : words.starts[i + 1]].to_pylist()
            for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if at[x] >= 0:
                    n, who = int(deals[a][at[x]]), int(whose[x])
                    for deal in range(n) if who == doc_ids[i] else [xxhash.xxh32_intdigest(str(doc_ids[i])) % n]:
                        yield who, deal, n, doc_ids[i], text_hashes[i], x, " ".join(text[x : y + window - 1])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = list(zip(*rows(part), strict=True)) or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return docs.join(shared, "doc_id").select("doc_id", "text_hash", "text", "shared").mapInArrow(run, PASSAGE)


class ReferenceShard:
    """One owner's automaton, growing as its documents are streamed in order of doc_id."""

    def __init__(self, window: int):
        self.window = window
        self.ids: dict[str, int] = {}
        self.automaton = SuffixAutomaton()

    def stream(self, passages: list[tuple[int, list[str]]]) -> list[tuple[np.ndarray, list[str]]]:
        """For each of one document's passages `(start, words)`, which of its windows are repeats; then adds what is new."""
        coded = [[self.ids.setdefault(w, len(self.ids)) for w in words] for _, words in passages]
        found = []
        for run in coded:
            repeated = np.zeros(len(run) - self.window + 1, bool)
            repeated[[i - self.window + 1 for i, _, _ in self.automaton.matching(run, self.window)]] = True
            found.append(repeated)
        for run, repeated in zip(coded, found, strict=True):
            edge = np.flatnonzero(np.diff(np.concatenate(([1], repeated, [1]))))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                self.automaton.add(run[a : b + self.window - 1])
        return found


MATCH = "doc_id long, text_hash long, start int, stop int, hash binary"


def _matches(passages: DataFrame, window: int) -> DataFrame:
    """Repeated stretches `[start, stop)` in words; for owners dealt over several tasks also each new window, with its hash."""
    names = [f.split()[0] for f in MATCH.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        each = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        shard, task = None, None
        for (owner, deal, deals, doc_id), own in groupby(each, key=lambda r: r[:4]):
            if (owner, deal) != task:
                shard, task = ReferenceShard(window), (owner, deal)
            own = [(text_hash, start, words.split(" ")) for _, _, _, _, text_hash, start, words in own]
            for (text_hash, start, words), repeated in zip(own, shard.stream([x[1:] for x in own]), strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate(([0], repeated, [0]))))
                for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    yield doc_id, text_hash, start + a, start + b + window - 1, None
                if deals > 1 and doc_id != owner:
                    for i in np.flatnonzero(~repeated).tolist():
                        yield doc_id, text_hash, start + i, start + i + window, xxhash.xxh3_128_digest(" ".join(words[i : i + window]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for row in rows(batches):
            held.append(row)
            if len(held) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    n = partitions(passages.sparkSession)
    return passages.repartition(n, "owner", "deal").sortWithinPartitions("owner", "deal", "doc_id", "text_hash", "start").mapInArrow(run, MATCH)


def repeated_spans(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """`(doc_id, text_hash, text)` -> `(doc_id, text_hash, spans)` with each row's repeated stretches `[start, stop)` in words, which may overlap."""
    named = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = cut(_anchors(named, window, run))
    found = cut(_matches(_passages(named, _shared(anchors), window, run), window))
    new = found.where("hash IS NOT NULL")
    firsts = new.groupBy("hash").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("hash", "first")
    across = new.join(firsts, "hash").where("doc_id > first")
    columns = ["doc_id", "text_hash", "start", "stop"]
    spans = found.where("hash IS NULL").select(columns).unionAll(across.select(columns))
    return spans.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))


def keep_first(docs: DataFrame, window: int = WINDOW, run: int = RUN, text: bool = True) -> DataFrame:
    """`(doc_id, n_words, n_removed, kept_sha256[, text])` of each row, text being the kept words joined by one blank."""
    rows = docs.select(*row_key(), F.col("text").cast("string").alias("text"))
    spans = repeated_spans(rows, window, run)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", text string" if text else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), PLAIN)
                whole = words.joined().to_pylist()
                removed = np.zeros(len(part), np.int64)
                for i, found in enumerate(part.column("spans").to_pylist()):
                    if found:
                        keep = np.ones(words.counts[i], bool)
                        for s in found:
                            keep[s["start"] : s["stop"]] = False
                        removed[i] = len(keep) - keep.sum()
                        whole[i] = " ".join(words.flat[words.starts[i] : words.starts[i + 1]].filter(pa.array(keep)).to_pylist())
                columns = [part.column("doc_id"), pa.array(words.counts), pa.array(removed), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in whole], pa.string())]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(whole, pa.string())] * text, names)

    return rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans").mapInArrow(apply, schema)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words kept and removed of every document, windows of 50 words.

    A null or blank text has no words; a text shorter than a window, or without
    doc_id, loses none and takes none from others; repeated rows are not smaller
    than one another and each gives a row; an empty table gives no rows.
    """
    return keep_first(read(spark, sf_dir, "documents"), text=False)
