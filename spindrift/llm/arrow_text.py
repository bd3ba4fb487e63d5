"""Vectorised word handling over Arrow string arrays.

Texts arrive in Arrow batches; every step below runs on whole batches (Arrow
kernels or numpy), so no Python code runs for a single character.  A word is
found by mapping separator bytes to a blank and splitting on blanks; both keep
UTF-8 intact, as only bytes below 0x80 are ever mapped.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; longer texts form a slice of their own.
SLICE_BYTES = 1_000_000

_SPACES = b"\t\n\x0b\x0c\r"
#: Words are `[^\x20\x09-\x0D]+`, unchanged.
PLAIN = bytes.maketrans(_SPACES, b" " * len(_SPACES))
_UPPER = bytes(range(0x41, 0x5B))
#: The same words with A-Z in lower case.
LOWER = bytes.maketrans(_SPACES + _UPPER, b" " * len(_SPACES) + _UPPER.lower())


def _alnum_table() -> bytes:
    table = bytearray(range(256))
    for b in range(0x80):
        c = chr(b).lower()
        table[b] = ord(c) if c.isascii() and c.isalnum() else 0x20
    return bytes(table)


#: A-Z in lower case; words are runs of 0-9, a-z and everything beyond ASCII.
ALNUM = _alnum_table()


@dataclass
class Words:
    """Words of a slice of documents; `starts` has one entry more than there are documents."""

    flat: pa.StringArray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)

    def joined(self) -> pa.StringArray:
        """Each document's words with one blank between them."""
        lists = pa.LargeListArray.from_arrays(pa.array(self.starts, pa.int64()), self.flat)
        return pc.binary_join(lists, " ")

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.starts) - 1), self.counts)

    def encoded(self) -> tuple[pa.StringArray, np.ndarray]:
        """Distinct words of the slice and each word's position among them."""
        d = self.flat.dictionary_encode()
        return d.dictionary, d.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def as_list(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


def hash_words(distinct: pa.StringArray, seed: int = 0) -> np.ndarray:
    """XXH64 of each word."""
    f = xxhash.xxh64_intdigest
    return np.fromiter((f(w, seed) for w in as_list(distinct)), np.uint64, len(distinct))


def split_words(texts: pa.Array, table: bytes) -> Words:
    """Words of every text; a null text has none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = memoryview(data)[offsets[0] : offsets[-1]].tobytes().translate(table) if data is not None and offsets[-1] > offsets[0] else b""
    mapped = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(raw))
    lists = pc.ascii_split_whitespace(mapped)
    flat = lists.flatten()
    starts = np.asarray(lists.offsets).astype(np.int64)
    starts = starts - starts[0]
    filled = np.asarray(pc.greater(pc.binary_length(flat), 0)) if len(flat) else np.zeros(0, bool)
    if not filled.all():
        before = np.concatenate(([0], np.cumsum(filled)))
        flat, starts = flat.filter(pa.array(filled)), before[starts]
    return Words(flat.cast(pa.string()), starts)


def give_back() -> None:
    """Freed memory goes back to the system: a worker lives on from stage to stage, beside the executor's heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch with about `limit` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = 0
    total = np.cumsum(sizes)
    while at < len(sizes):
        done = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, done + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()


def sum_by_doc(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of `values` rows per document, zero where a document has none."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), values.dtype)
    filled = np.flatnonzero(np.diff(starts))
    if len(filled):
        out[filled] = np.add.reduceat(values, starts[filled], axis=0)
    return out


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of each run, one run after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
