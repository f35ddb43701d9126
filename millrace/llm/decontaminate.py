"""Benchmark decontamination by spaced-seed hashing.

A mask fixes which of ``span`` consecutive words count; the others may differ.  The benchmark's masked windows are hashed into
a table; every document's masked windows are looked up in it; each hit names a place in a benchmark item.  Around a hit the
document and the item are compared word by word on that diagonal, and the overlap counts if, in some window of ``overlap``
words (or the whole item if that is shorter), at least ``agree`` of the words are equal: substitutions are tolerated.
The masks of a window length leave one of them whole whichever words may differ, so every such overlap is hit and verified.

The benchmark is taken in blocks of at most ``block_words`` words, which bounds what is broadcast; each block is one
pass over all documents.  Documents are never shuffled; a document holds as many rows as items it leaks.

Short items: one of fewer than ``shortest`` (8) words says too little inside a longer text; it leaks only into a text that has the same
words and no others.  Longer items that are shorter than the window need their whole length.

Defined cases: null and empty texts and items match nothing; a null item_id is an item like others, named ``null`` in item_ids; rows
that repeat a doc_id are searched one by one and merged in the result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHash, mix64, require_columns, text_bytes, worker_memory

#: (words of a window, words of them that may differ): masks of words that count (1); between them any word may stand.
#: Whichever words differ, some mask lies whole inside the window (the tests go through all cases).
MASKS = {
    (13, 3): ("110011011", "101001111", "11010111", "1110110001", "111000010011"),
    (12, 3): ("10100111", "111011", "1100001011", "11001011"),
    (11, 2): ("1111011", "1101100011", "110001111"),
    (10, 2): ("10010111", "1111001", "10111001"),
    (9, 2): ("101111", "10110011", "11001101", "1110101"),
    (8, 2): ("1111", "11101", "1010011"),
}
OVERLAP, AGREE, BLOCK_WORDS, SHORTEST = 13, 0.75, 4_000_000, 8


def masks(need: int, agree: float = AGREE) -> tuple[str, ...]:
    """Masks that reach every accepted overlap of ``need`` words; without a listed set, the run of equal words that must remain."""
    same = max(1, math.ceil(agree * need))
    wrong = need - same
    return MASKS.get((need, wrong), ("1" * -(-same // (wrong + 1)),))


def places(mask: str) -> tuple[int, ...]:
    return tuple(i for i, c in enumerate(mask) if c == "1")


#: Odd multipliers, one for each counted word of a mask.
_FACTORS = mix64(np.arange(1, 1025, dtype=np.uint64)) | np.uint64(1)


def masked_hashes(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash, at every start, of the words that the mask counts; words are hashes themselves, so a weighted sum will do."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for k, p in enumerate(places(mask)):
        acc += words[p : p + n] * _FACTORS[k % len(_FACTORS)]
    return mix64(acc)


def normal_words(text: bytes | None, hashes: WordHash) -> np.ndarray:
    """Hashes of lower-cased words without outer punctuation."""
    words = [w.strip(b".,;:!?\"'()[]{}*#$%&|<>") for w in text.lower().split()] if text else []
    return hashes.array([w for w in words if w])


class Index:
    """Masked windows of a block of items, with the masks that each item's length needs."""

    def __init__(self, items: list[tuple[int | None, bytes]], overlap: int = OVERLAP, agree: float = AGREE, shortest: int = SHORTEST):
        hashes, self.shortest = WordHash.shared(), shortest
        self.ids = [i for i, _ in items]
        words = [normal_words(t, hashes) for _, t in items]
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.base = np.concatenate(([0], np.cumsum(self.sizes)))
        self.words = np.concatenate(words) if words else np.empty(0, np.uint64)
        self.tables, self.short = [], {}
        for i in np.flatnonzero((self.sizes > 0) & (self.sizes < shortest)).tolist():
            self.short.setdefault(words[i].tobytes(), []).append(i)
        needs = np.where(self.sizes < shortest, 0, np.minimum(self.sizes, overlap))
        for need in np.unique(needs[needs > 0]).tolist():
            own = np.flatnonzero(needs == need).tolist()
            for mask in masks(need, agree):
                grams = [masked_hashes(words[i], mask) for i in own]
                h, at = np.concatenate(grams), np.concatenate([np.arange(len(g)) + self.base[i] for g, i in zip(grams, own, strict=True)])
                order = np.argsort(h, kind="stable")
                h, at = h[order], at[order]
                bits = 1 << max(16, int(len(h) * 16).bit_length())
                quick = np.zeros(bits, bool)
                quick[h & np.uint64(bits - 1)] = True
                self.tables.append((mask, h, at, quick))

    def hits(self, doc: np.ndarray) -> np.ndarray:
        """Distinct (item, diagonal) pairs; the diagonal is the document's place minus the item's."""
        found = []
        for mask, h, at, quick in self.tables:
            g = masked_hashes(doc, mask)
            maybe = np.flatnonzero(quick[g & np.uint64(len(quick) - 1)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(h, g[maybe], "left"), np.searchsorted(h, g[maybe], "right")
            n = hi - lo
            if not n.sum():
                continue
            where = np.repeat(maybe, n)
            place = at[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())]
            item = np.searchsorted(self.base, place, "right") - 1
            found.append((item << 32) + (where - (place - self.base[item]) + (1 << 31)))
        keys = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
        return np.stack((keys >> 32, (keys & 0xFFFFFFFF) - (1 << 31)), axis=1)

    def overlaps(self, doc: np.ndarray, overlap: int, agree: float) -> Iterator[tuple[int | None, int, int, int]]:
        """(item_id, first word, word after the last, equal words) of each verified overlap."""
        for item in self.short.get(doc.tobytes(), ()) if len(doc) < self.shortest else ():
            yield self.ids[item], 0, len(doc), len(doc)
        for item, shift in self.hits(doc).tolist():
            words = self.words[self.base[item] : self.base[item + 1]]
            lo, hi = max(0, -shift), min(len(words), len(doc) - shift)
            need = min(overlap, len(words))
            if hi - lo < need:
                continue
            same = doc[lo + shift : hi + shift] == words[lo:hi]
            sums = np.concatenate(([0], np.cumsum(same)))
            good = np.flatnonzero(sums[need:] - sums[:-need] >= agree * need)
            if len(good):
                a, b = int(good[0]), int(good[-1]) + need
                yield self.ids[item], a + lo + shift, b + lo + shift, int(sums[b] - sums[a])


def _search(broadcast, overlap: int, agree: float, shortest: int):
    tag = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, hashes = worker_memory(("index", tag), lambda: Index(broadcast.value, overlap, agree, shortest)), WordHash.shared()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                doc = normal_words(text, hashes)
                rows += [(doc_id, item, a, b, n) for item, a, b, n in index.overlaps(doc, overlap, agree)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], ["doc_id", "item_id", "first_word", "end_word", "n_equal"])

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, overlap: int = OVERLAP, agree: float = AGREE, block_words: int = BLOCK_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """doc_id, item_id, first_word, end_word and n_equal of each verified overlap of ``docs`` (doc_id, text) with ``benchmark``."""
    docs, benchmark = require_columns(docs, "doc_id", "text"), require_columns(benchmark, "item_id", "text")
    context, out = docs.sparkSession.sparkContext, None
    block, size = [], 0

    def search(items: list) -> DataFrame:
        return docs.mapInArrow(_search(context.broadcast(items), overlap, agree, shortest), "doc_id long, item_id long, first_word long, end_word long, n_equal long")

    for item_id, text in benchmark.toLocalIterator(prefetchPartitions=False):  # one block of the query set at a time
        raw = (text or "").encode()
        block.append((item_id, raw))
        size += raw.count(b" ") + 1
        if size >= block_words:
            found = search(block)
            out, block, size = found if out is None else out.unionByName(found), [], 0
    if block or out is None:
        found = search(block)
        out = found if out is None else out.unionByName(found)
    return out


def leaking_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, n_items, n_equal (most words shared with one item) and item_ids of every document with a verified overlap."""
    found = leaks(docs, benchmark, **options)
    item = F.struct("item_id")  # so that a null one counts
    named = F.transform(F.sort_array(F.collect_set(item)), lambda x: F.coalesce(x["item_id"].cast("string"), F.lit("null")))
    return found.groupBy("doc_id").agg(F.count_distinct(item).alias("n_items"), F.max("n_equal").alias("n_equal"), F.array_join(named, ",").alias("item_ids"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without any verified overlap, with all their columns."""
    bad = leaks(docs, benchmark, **options).select(F.struct(F.col("doc_id")).alias("leak")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of theirs meets those used here
    clean = rows.join(bad, F.col("row.doc_id").eqNullSafe(F.col("leak.doc_id")), "left_anti")
    return clean.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
