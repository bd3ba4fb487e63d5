"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are normalised to lower-case words.  A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one
window.  The automaton of all items is streamed over every document: it keeps
the longest run of words that ends at each position and occurs in an item.
Where that run reaches a window's length, the words of the window are hit.

Only stretches of words that all occur in some item can hold a window, so the
rest of a document is passed over by a vectorised look-up and the automaton
sees the stretches alone.

Items are held in automata of at most MOST_WORDS item words each, which bounds
what is broadcast whatever the size of the test set.  A larger one takes several
passes over the documents, each with an automaton of its own, which is freed
before the next is built; the passes' hits, rows of the texts that have some,
are united.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import ALNUM, Words, slices, split_words
from .automaton import SuffixAutomaton
from .session import boxed, cut, read, unboxed, wider

WINDOW = 10
#: Item words in one automaton; a word takes up to two states, about 600 bytes in all.
MOST_WORDS = 200_000

#: Words of a text as it is, those that ALNUM finds in lower case.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")


class ItemIndex:
    """Automaton of some items, with the items that have a window ending in each state."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window = window
        self.ids: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        self.shortest = window
        ends: dict[tuple[int, int], set] = defaultdict(set)
        kept = []
        for item, words in items:
            if words:
                coded = [self.ids.setdefault(w, len(self.ids)) for w in words]
                self.automaton.add(coded)
                kept.append((item, coded))
                self.shortest = min(self.shortest, len(coded))
        for item, coded in kept:
            n = min(window, len(coded))
            for i, size, state in self.automaton.matching(coded, n):
                if size >= n and i + 1 >= n:
                    ends[self.automaton.ending(state, n), n].add(item)
        self.by_state: dict[int, list[tuple[int, frozenset]]] = defaultdict(list)
        for (state, n), found in ends.items():
            self.by_state[state].append((n, frozenset(found)))

    def windows(self, state: int, size: int) -> Iterator[tuple[int, frozenset]]:
        """(length, items) of every window that ends where `size` matched symbols end in `state`."""
        while state > 0:
            for n, items in self.by_state.get(state, ()):
                if n <= size:
                    yield n, items
            state = self.automaton.link[state]

    def scan(self, words: Words) -> tuple[np.ndarray, dict[int, set]]:
        """Whether each word of a slice is hit, and each document's items."""
        hit = np.zeros(len(words.flat), bool)
        items: dict[int, set] = defaultdict(set)
        if not len(words.flat) or not self.ids:
            return hit, items
        known = pc.index_in(words.flat, pa.array(list(self.ids), pa.string()))
        codes = pc.fill_null(known, -1).to_numpy(zero_copy_only=False)
        doc = words.doc_of_word()
        # stretches of known words within one document
        inside = codes >= 0
        edge = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0) | np.append(np.diff(doc, prepend=doc[0]) > 0, False))
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            if not inside[a] or b - a < self.shortest:
                continue
            for i, size, state in self.automaton.matching(codes[a:b].tolist(), self.shortest):
                for n, found in self.windows(state, size):
                    hit[a + i + 1 - n : a + i + 1] = True
                    items[int(doc[a])] |= found
        return hit, items


def _item_shards(items: DataFrame, window: int) -> Iterator[ItemIndex]:
    """Indexes of at most MOST_WORDS words each, or of one item if that is longer; the items come to the driver one partition at a time."""
    held, size = [], 0
    for row in items.where("text IS NOT NULL").select("item_id", F.col("text").cast("string")).toLocalIterator():
        words = split_words(pa.array([row.text]), ALNUM).flat.to_pylist()
        if held and size + len(words) > MOST_WORDS:
            yield ItemIndex(held, window)
            held, size = [], 0
        held.append((row.item_id, words))
        size += len(words)
    yield ItemIndex(held, window)


def _hits(docs: DataFrame, shared) -> DataFrame:
    """Every document row with its number of words, hit spans `[start, end)` in words and the items found in it; shared: a broadcast index."""
    out = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.list_(pa.int32()))), ("items", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words = split_words(part.column("text"), ALNUM)
                hit, items = shared.value.scan(words)
                spans: list[list] = [[] for _ in range(len(part))]
                doc = words.doc_of_word()
                edge = np.flatnonzero(hit & np.append(True, ~hit[:-1] | (np.diff(doc) > 0))) if len(hit) else []
                stop = np.flatnonzero(hit & np.append(~hit[1:] | (np.diff(doc) > 0), True)) if len(hit) else []
                for a, b in zip(edge, stop, strict=True):
                    at = words.starts[doc[a]]
                    spans[doc[a]].append([int(a - at), int(b + 1 - at)])
                found = [sorted(str(x) for x in items.get(i, ()) if x is not None) for i in range(len(part))]
                columns = [pa.array(words.counts), pa.array(spans, out.field("spans").type), pa.array(found, out.field("items").type)]
                yield pa.RecordBatch.from_arrays([*part.columns, *columns], [*part.schema.names, *out.names])

    return docs.mapInArrow(run, wider(docs, "n_words long, spans array<array<int>>, items array<string>"))


def _text_key(text) -> list:
    """128 bits that name a text."""
    return [F.xxhash64(text).alias("h1"), F.xxhash64(text, F.lit(1)).alias("h2")]


def find_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with `n_words`, `spans` and `items`.

    A test set of one automaton needs no shuffle.  Spans of several may overlap;
    the hits of all but the first are written to the shared folder pass by pass.
    """
    broadcast = docs.sparkSession.sparkContext.broadcast
    shards = _item_shards(items, window)
    found, more = _hits(docs, broadcast(next(shards))), None
    texts = docs.select("text").where("text IS NOT NULL")
    for index in shards:
        shared = broadcast(index)
        own = cut(_hits(texts, shared).where(F.size("spans") > 0).select(*_text_key("text"), "spans", "items").dropDuplicates(["h1", "h2"]))
        shared.destroy()
        more = own if more is None else more.unionAll(own)
    if more is None:
        return found
    lists = [F.flatten(F.collect_list(c)).alias(f"more_{c}") for c in ("spans", "items")]
    both = found.select("*", *_text_key("text")).join(more.groupBy("h1", "h2").agg(*lists), ["h1", "h2"], "left")
    joined = lambda c: F.concat(c, F.coalesce(f"more_{c}", F.array().cast(found.schema[c].dataType)))
    return both.select(*docs.columns, "n_words", joined("spans").alias("spans"), F.array_sort(F.array_distinct(joined("items"))).alias("items"))


def n_hit(spans: str = "spans"):
    """Words in the union of spans that may overlap."""
    step = "x[1] - greatest(x[0], acc.upto)"
    return F.expr(f"aggregate(array_sort({spans}), struct(0L AS n, 0 AS upto), (acc, x) -> struct(acc.n + greatest({step}, 0) AS n, greatest(acc.upto, x[1]) AS upto), acc -> acc.n)")


def without_words(text: str, spans: list[list[int]]) -> str:
    """text without the stretches from the first to the last word of each span `[start, end)`, and one of the blanks around each."""
    drop = set()
    for a, b in spans:
        drop.update(range(a, b))
    out, at, begin, end = [], 0, None, None
    for k, word in enumerate(_WORD.finditer(text)):
        if k in drop:
            begin, end = word.start() if begin is None else begin, word.end()
        elif begin is not None:
            out.append(text[at:begin])
            at, begin = end + (text[begin - 1 : begin].isspace() and text[end : end + 1].isspace()), None
    if begin is not None:
        out.append(text[at:begin])
        at = end + (text[begin - 1 : begin].isspace() and text[end : end + 1].isspace())
    return "".join([*out, text[at:]])


def remove_contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, least: int = 1, coverage: float = 0.5) -> DataFrame:
    """Documents without their hit spans of `least` words or more; documents hit in over `coverage` of their words go entirely.

    What is left of a text stays as it was written; n_chars, if there is one,
    follows a changed text.  A null text, or one without such a span, stays.
    """
    found = find_contamination(boxed(docs), items, window).withColumn("n_hit", n_hit()).where(~(F.col("n_hit") > F.lit(coverage) * F.col("n_words")))
    long_spans = F.filter("spans", lambda x: x[1] - x[0] >= least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                changed = np.flatnonzero(np.asarray(pc.greater(pc.list_value_length(part.column("long")), 0)))
                texts = part.column("text")
                if len(changed):
                    texts = texts.to_pylist()
                    for i in changed.tolist():
                        texts[i] = without_words(texts[i], part.column("long")[i].as_py())
                flags = np.zeros(len(part), bool)
                flags[changed] = True
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(texts, pa.string()) if len(changed) else texts, pa.array(flags)], ["row", "text", "changed"])

    boxes = boxed(docs).withColumn("text", F.col("text").cast("string"))
    cleaned = found.select("row", F.col("text").cast("string").alias("text"), long_spans.alias("long")).mapInArrow(run, wider(boxes, "changed boolean"))
    new = {}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return unboxed(cleaned, docs, **new)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in a window of a benchmark item.

    A null or wordless text has no words and no hits; a null or wordless item
    has no window; an item without id hits words but is not counted; a very long
    text counts whole; repeated rows of either table give the same results; no
    items: nothing is hit; an empty table gives no rows; further columns of
    either table are not read.
    """
    found = find_contamination(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("text").cast("string")), read(spark, sf_dir, "benchmark"))
    n = n_hit()
    return found.select(
        "doc_id", "n_words", n.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n > 0).alias("contaminated"),
    )

