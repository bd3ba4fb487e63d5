"""Packing documents into sequences along a space-filling curve.

1. A document's tokens are hashed to signed numbers in a few dimensions; their
   mean places the document, and its Hilbert key orders places so that
   neighbours on the curve are alike.
2. The key is refined by a hash of doc_id, so that a place that holds very many
   documents is still cut into parts, and rows of a few numbers each are
   range-sorted.  Running sums of token counts inside each range, on top of the
   ranges' totals, give every document its place in one long stream of tokens.
3. The stream is cut every `length` tokens: every sequence is full but the last.
   A document's pieces follow from its place alone, so they are made wherever
   the document is, in any order and any number of times.

Tokens are those of a public tokenizer.  A text is split at blanks, which the
tokenizer drops, and each distinct piece is encoded once for each worker, or
again if it was forgotten since: the result is the tokenizer's own for the whole
text.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow_text import LOWER, Words, as_list, give_back, ragged, slices, split_words, sum_by_doc
from .session import cut, partitions, read

LENGTH, END = 2048, 1
#: Dimensions of a place, bits of each, and bits of the row's hash below them.
DIMS, BITS, TIE_BITS = 4, 10, 20
#: Bytes of text tokenised at once: the more, the fewer look-ups of a word.
SLICE = 1_500_000
#: Bytes that a worker's known pieces may take, and what a piece takes besides its letters and ids.
MOST_BYTES, PIECE_BYTES = 64_000_000, 200
#: Words of the last slices that Arrow looks up.
MOST_RECENT = 150_000

_EDGES = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum())
_IS_EDGE = np.isin(np.arange(256), [ord(c) for c in _EDGES])


class CachedTokenizer:
    """Ids of whole texts by way of their distinct pieces; forgets the half that is used least when they take over `most` bytes."""

    def __init__(self, path: str, most: int = MOST_BYTES):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        self.normalizer, self.nothing = self.tokenizer.normalizer, normalizers.Sequence([])
        names = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(names.values()) + 1, bool)
        self.closes[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held = 0
        self._forget_recent()
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.uses = np.zeros(1024, np.int32)
        self.cost = np.zeros(1024, np.int32)
        self.pool = np.zeros(4096, np.uint32)
        self.used = 0

    def _forget_recent(self) -> None:
        self.recent, self.recent_codes = pa.array([], pa.string()), np.zeros(0, np.int64)

    def forget_half(self) -> None:
        """Of pieces used as often, those known longer go first; uses count half from now on."""
        n = len(self.known)
        kept = np.zeros(n, bool)
        kept[np.lexsort((np.arange(n), self.uses[:n]))[n - n // 2 :]] = True
        kept = np.flatnonzero(kept)
        names = list(self.known)
        self.known = dict(zip((names[i] for i in kept.tolist()), range(len(kept)), strict=True))
        size = self.size[kept]
        self.pool = self.pool[ragged(self.start[kept], size)]
        self.used = len(self.pool)
        self.start, self.size, self.uses, self.cost = np.cumsum(size) - size, size, self.uses[kept] // 2, self.cost[kept]
        self.held = int(self.cost.sum())
        self._forget_recent()

    def _reserve(self, n: int) -> None:
        while self.used + n > len(self.pool):
            self.pool = np.resize(self.pool, 2 * len(self.pool) + 4096)

    def _store(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first, last = len(self.known), len(self.known) + len(pieces)
        while last > len(self.size):
            room = 2 * len(self.size) + 1024
            self.start, self.size, self.uses, self.cost = (np.resize(x, room) for x in (self.start, self.size, self.uses, self.cost))
        self._reserve(len(ids))
        self.start[first:last] = self.used + np.cumsum(sizes) - sizes
        self.size[first:last] = sizes
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.uses[first:last] = 0
        self.cost[first:last] = PIECE_BYTES + np.fromiter(map(len, pieces), np.int64, len(pieces)) + sizes * ids.itemsize
        self.held += int(self.cost[first:last].sum())
        self.known.update(zip(pieces, range(first, last), strict=True))

    def _learn(self, pieces: list[str]) -> None:
        """Words of letters alone are encoded together, a blank between them: each has one closing id."""
        words, others = [p for p in pieces if p.isalpha()], [p for p in pieces if not p.isalpha()]
        for at in range(0, len(words), 8192):
            some = words[at : at + 8192]
            text = " ".join(some)
            # normalising would leave such a text alone
            same = unicodedata.is_normalized("NFC", text) and text.lower() == text
            self.tokenizer.normalizer = self.nothing if same else self.normalizer
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            self.tokenizer.normalizer = self.normalizer
            ends = np.flatnonzero(self.closes[ids])
            if len(ends) == len(some):
                self._store(some, ids, np.diff(ends, prepend=-1))
            else:
                others += some
        for at in range(0, len(others), 8192):
            some = others[at : at + 8192]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            self._store(some, np.array([x for e in ids for x in e], np.uint32), np.array([len(e) for e in ids], np.int64))

    def _codes(self, pieces: list[str]) -> np.ndarray:
        look = lambda some: np.fromiter(map(self.known.get, some, repeat(-1)), np.int64, len(some))
        codes = look(pieces)
        missing = np.flatnonzero(codes < 0)
        if len(missing):
            some = [pieces[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(some)))
            codes[missing] = look(some)
        return codes

    def _recent(self, words: pa.StringArray) -> np.ndarray:
        """Codes of distinct words; Arrow finds those that were asked for lately, so only others become Python strings."""
        at = pc.fill_null(pc.index_in(words, value_set=self.recent), -1).to_numpy().astype(np.int64)
        others = words.filter(pa.array(at < 0))
        codes = self.recent_codes[at] if len(self.recent) else np.zeros(len(words), np.int64)
        codes[at < 0] = new = self._codes(as_list(others))
        if len(self.recent) + len(others) > MOST_RECENT:
            self.recent, self.recent_codes = words, codes
        else:
            self.recent, self.recent_codes = pa.concat_arrays([self.recent, others]), np.concatenate([self.recent_codes, new])
        return codes

    def _distinct(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word's ids begin in the pool, and how many they are.

        A letter or digit before a word's closing punctuation parts it from what
        comes before, so both are looked up on their own and put together past
        the pool's end.
        """
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset + 1 : words.offset + len(words) + 1] if len(words) else np.zeros(0, np.int32)
        edged = _IS_EDGE[np.frombuffer(words.buffers()[2], np.uint8)[ends - 1]] if len(words) else np.zeros(0, bool)
        whole = words.filter(pa.array(edged))
        core = pc.utf8_rtrim(whole, characters=_EDGES)
        parted = np.asarray(pc.match_substring_regex(core, r"[\p{L}\p{N}]$"), bool)
        split = np.flatnonzero(edged)[parted]
        core = core.filter(pa.array(parted))
        tails = [w[len(c) :] for w, c in zip(as_list(whole.filter(pa.array(parted))), as_list(core), strict=True)]
        edged[edged] = parted
        d = pc.replace_with_mask(words, pa.array(edged), core).dictionary_encode()
        code = self._recent(d.dictionary)
        self.uses[code] += 1
        head = code[d.indices.to_numpy(zero_copy_only=False)]
        tail = self._codes(tails)
        start, size = self.start[head], self.size[head]
        if len(split):
            pairs = np.stack([head[split], tail], axis=1).reshape(-1)
            both = self.pool[ragged(self.start[pairs], self.size[pairs])]
            self._reserve(len(both))
            self.pool[self.used : self.used + len(both)] = both
            size[split] += self.size[tail]
            start[split] = self.used + np.cumsum(size[split]) - size[split]
        return start, size

    def encode(self, texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each text's begin; `words` are the texts' words in lower case."""
        if self.held > self.most:
            self.forget_half()
        distinct, of_word = words.encoded()
        start, size = self._distinct(distinct)
        sizes = size[of_word]
        ids = self.pool[ragged(start[of_word], sizes)]
        starts = np.concatenate(([0], np.cumsum(sizes)))[words.starts]
        # a special token's name in a text is its id, and may hold letters of either case
        special = np.asarray(pc.fill_null(pc.match_substring(texts, "<|"), False))
        if special.any():
            parts = [ids[a:b] for a, b in zip(starts[:-1], starts[1:], strict=True)]
            for i in np.flatnonzero(special):
                parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, np.uint32)
            ids, starts = np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
        return ids, starts


_tokenizers: dict[str, CachedTokenizer] = {}


def tokenizer(path: str) -> CachedTokenizer:
    """One for each Python worker, kept from task to task with the pieces it has learned, unless the task forgets them."""
    if path not in _tokenizers:
        _tokenizers[path] = CachedTokenizer(path)
    return _tokenizers[path]


def forget_pieces() -> None:
    """For stages after tokenising, whose tasks run in the same workers."""
    for own in _tokenizers.values():
        if own.known:
            own.forget()
            give_back()


def _signs(n: int) -> np.ndarray:
    """For each id below n its hashed vector, DIMS numbers from -1 to 1."""
    x = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x.astype("<u8").view("<i2").reshape(-1, 4)[:, :DIMS].astype(np.float32) / 32768


def places(ids: np.ndarray, starts: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Each document's place, DIMS numbers of BITS bits: its tokens' hashed vectors averaged and squeezed into 0 to 1."""
    n = np.maximum(np.diff(starts), 1)[:, None]
    total = np.stack([sum_by_doc(signs[:, j][ids].astype(np.float64), starts) for j in range(DIMS)], axis=1)
    spread = 0.5 + np.arctan(total / np.sqrt(n)) / np.pi
    return np.minimum((spread * (1 << BITS)).astype(np.int64), (1 << BITS) - 1)


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions along the Hilbert curve of points with `bits` bits in each dimension.

    From the top bit down, the cube that a point lies in is named by the Gray
    code rank of its half-spaces, and what is left is turned to the curve's
    start in that cube.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            upper = (x[i] >> b & 1).astype(bool)
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[i] = np.where(upper, x[i], x[i] ^ swap)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> b & 1, (1 << b) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


TOKENS = "row long, doc_id long, key long, tokens long, ids binary"


def tokenise(docs: DataFrame, path: str, keep: bool = False) -> DataFrame:
    """Each row of `(doc_id, text)` with a number of its own, its place along the curve and its ids, the closing one included.

    Row numbers name a row for good once the table is written: a task that runs
    again writes the same partition.  With `keep` a worker remembers its pieces
    from task to task, which saves time where no other stages need the memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row, own = TaskContext.get().partitionId() << 40, tokenizer(path)
        signs = _signs(len(own.closes))
        kind = "<u2" if len(own.closes) <= 1 << 16 else "<u4"
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                ids, starts = own.encode(part.column("text"), split_words(part.column("text"), LOWER))
                key = hilbert_keys(places(ids, starts, signs), BITS)
                size = np.diff(starts) + 1
                head = np.cumsum(size) - size
                stream = np.full(int(size.sum()), END, kind)
                stream[ragged(head, size - 1)] = ids
                bounds = (np.append(head, size.sum()) * stream.itemsize).astype(np.int32)
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(bounds), pa.py_buffer(stream)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(size))), part.column("doc_id"), pa.array(key), pa.array(size), binary], ["row", "doc_id", "key", "tokens", "ids"])
                row += len(size)
        if not keep:
            own.forget()
        give_back()

    return docs.select("doc_id", "text").mapInArrow(run, TOKENS)


def place_in_stream(rows: DataFrame) -> DataFrame:
    """`(row, base)`: where each row's tokens begin in the stream.

    Range partitions are numbered along the curve.  Only their token totals, one
    number for each, come to the driver.
    """
    spark = rows.sparkSession
    at = F.shiftleft(F.col("key"), TIE_BITS) + F.pmod(F.xxhash64("doc_id"), F.lit(1 << TIE_BITS))
    order = ["at", "doc_id", "row"]
    ranged = rows.withColumn("at", at).select(*order, "tokens").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        forget_pieces()
        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            size = batch.column("tokens").to_numpy()
            base = total + np.cumsum(size) - size
            total += int(size.sum())
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("tokens"), pa.array(base), pa.array(np.full(len(size), part, np.int32))], ["row", "tokens", "base", "part"])

    based = cut(ranged.mapInArrow(run, "row long, tokens long, base long, part int"))
    totals = {r.part: r.total for r in based.groupBy("part").agg(F.sum("tokens").alias("total")).collect()}
    before, sofar = [], 0
    for part in range(max(totals, default=0) + 1):
        before.append(sofar)
        sofar += totals.get(part, 0)
    offset = F.get(F.array(*(F.lit(x).cast("long") for x in before)), F.col("part"))
    return based.select("row", (F.col("base") + offset).alias("base"))


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(docs: DataFrame, path: str, length: int = LENGTH, with_ids: bool = False, keep: bool = False) -> DataFrame:
    """Pieces of every document's tokens in sequences of `length`; with_ids adds each piece's ids, keep is for `tokenise`."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut(tokenise(texts, path, keep))
    based = rows.select("row", "doc_id", "tokens", "ids").join(place_in_stream(rows), "row").select("doc_id", "tokens", "base", "ids")
    schema = PIECE + (", ids array<int>" if with_ids else "")
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_pieces()
        for batch in batches:
            for part in slices(batch, "ids"):
                size, base = part.column("tokens").to_numpy(), part.column("base").to_numpy()
                binary = part.column("ids")
                bounds = np.frombuffer(binary.buffers()[1], np.int32)[binary.offset : binary.offset + len(size) + 1]
                wide = (bounds[-1] - bounds[0]) // int(size.sum())
                stream = np.frombuffer(binary.buffers()[2], np.uint8)[bounds[0] : bounds[-1]].view(f"<u{wide}").astype("<u4")
                head = np.cumsum(size) - size
                pieces = (base + size - 1) // length - base // length + 1
                doc = np.repeat(np.arange(len(size)), pieces)
                sequence = base[doc] // length + ragged(np.zeros(len(size), np.int64), pieces)
                start = np.maximum(sequence * length - base[doc], 0)
                end = np.minimum((sequence + 1) * length - base[doc], size[doc])
                lo, hi = head[doc] + start, head[doc] + end
                data = memoryview(stream.tobytes())
                crc = np.fromiter((zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)), np.int64, len(doc))
                offset = base[doc] + start - sequence * length
                columns = [part.column("doc_id").take(pa.array(doc)), *map(pa.array, (start, end - start, crc, size[doc], sequence, offset))]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.append(lo, hi[-1:]).astype(np.int32), pa.array(stream.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    return based.mapInArrow(run, schema)


def vocabulary() -> str:
    """The vocabulary file of the contract's tokenizer."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, the last one alone being shorter.

    A null or empty text has the closing id alone; repeated rows are packed each
    on their own; an empty table gives no pieces; a text longer than a sequence
    is cut; further columns are not read.
    """
    return pack(read(spark, sf_dir, "documents"), vocabulary(), keep=True)
