"""Exact substring dedup by a common-prefix-aware distributed merge sort of suffixes.

Removed is every byte covered by a ``length``-byte string that also starts anywhere else.  Sorting every suffix of a corpus
moves hundreds of times its size, so only suffixes that can matter are sorted, and none that matters is left out:

1. Anchors.  Every window of ``length`` bytes selects its least ``gram``-byte hash (leftmost among equals).  Equal windows select
   the same place, so a repeated window's anchor hash occurs twice.  Consecutive windows with one anchor form its context.
   One aggregation by anchor tells which occur at several places; one by (anchor, 128-bit hash of the context's bytes) tells
   which contexts repeat as a whole, and which anchors have several contexts, whose windows may agree in part.
2. Sides.  Where an anchor has several contexts, one place of each is sorted twice: by what follows the anchor, and by what
   precedes it, read backwards.  The common prefixes with its neighbours bound how far any other context agrees on either side.
   Two contexts agree backwards for exactly one of the common prefixes that neighbours of the second sort have (the least
   between them); these are the anchor's levels, at most as many as a context has windows.
3. Suffixes.  Sorted are, for a whole context, two of its places; and for one place of each of several contexts, the suffixes that
   begin a level before the anchor, within both bounds.  Contexts that agree on a window agree from one level on, where both have a
   suffix; so neighbours in this order give each suffix its longest repeated prefix.  A prefix of ``length`` bytes or more is covered:
   the bytes decide.  The other places of a whole context whose suffix is found to repeat are covered by its hash.
4. Removal.  Covered runs are cut out.

Sort.  A task sorts its suffixes, merges equal ones, front-codes the run (length of the prefix shared with the predecessor, then
the rest) and deals it by splitters.  A range's runs are merged by a loser tree that keeps each head's common prefix with the last
output: heads with different values are ordered without looking at a byte, others are compared from there on.

Skew: equal texts are one text from the start (with a copy, all of a text of ``length`` bytes goes); a context that repeats any
number of times is sorted at two places; equal suffixes of one task leave it once.  Aggregations combine before the shuffle; the
joins may be split.

Defined cases: null texts are empty; texts shorter than ``length`` lose nothing; rows that repeat a doc_id are documents of
their own; null ids are kept; other columns are ignored.  Texts are told apart by 128 bits of hash.
"""

from __future__ import annotations

import hashlib
import struct
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, materialize, mix64, require_columns, text_bytes

LENGTH, GRAM, RUN_BYTES, SEGMENT = 200, 40, 48 << 20, 1 << 16

_BYTE = mix64(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)
_X = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_X, -1, 1 << 64)

#: A text's key: two 64-bit hashes.
KEY = ("n1", "n2")
#: What a suffix carries: its text's key, its anchor and its place.
TAG = np.dtype([("n1", "<i8"), ("n2", "<i8"), ("anchor", "<i8"), ("place", "<i8")])
_PACKED = "<qqqq"


class Powers:
    """x**i and x**-i modulo 2**64."""

    def __init__(self):
        self.up = self.down = np.empty(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.up) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, base in (("up", _X), ("down", _INVERSE)):
                p = np.full(size, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x) - w + 1
    padded = np.concatenate((x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype))).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


def pieces(texts: list[bytes], length: int = LENGTH) -> Iterator[list[tuple[int, int, bytes]]]:
    """Blocks of (text, base, bytes) of about SEGMENT bytes that hold every window of every text once."""
    block, size = [], 0
    for k, text in enumerate(texts):
        for base in range(0, max(len(text) - length + 1, 0), SEGMENT):
            block.append((k, base, text[base : base + SEGMENT + length - 1]))
            size += len(block[-1][2])
            if size >= SEGMENT:
                yield block
                block, size = [], 0
    if block:
        yield block


def anchors(block: list[tuple[int, int, bytes]], powers: Powers, length: int = LENGTH, gram: int = GRAM) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a block, and of each context: its piece, anchor hash, first window, last window and anchor's place (in these bytes), and what to add for places in the text."""
    data = b"".join([p for _, _, p in block])
    n = len(data)
    powers.grow(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[np.frombuffer(data, np.uint8)] * powers.up[:n], out=sums[1:])
    h = mix64((sums[gram:] - sums[: n + 1 - gram]) * powers.down[: n + 1 - gram])
    low = np.uint64((1 << 20) - 1)
    least = sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    ends = np.cumsum([len(p) for _, _, p in block])
    inside = np.ones(len(least), bool)  # windows that lie in one piece
    inside[(ends[:-1, None] - np.arange(1, length)).ravel()] = False
    starts = np.flatnonzero(inside)
    chosen = (least[starts] & low).astype(np.int64)
    begins = np.concatenate(([0], np.flatnonzero(chosen[1:] != chosen[:-1]) + 1))
    first, last, at = starts[begins], starts[np.concatenate((begins[1:], [len(chosen)])) - 1], chosen[begins]
    piece = np.searchsorted(ends, first, "right")
    shift = np.array([b for _, b, _ in block], np.int64) - np.concatenate(([0], ends[:-1]))
    return data, piece, h[at], first, last, at, shift[piece]


def _anchors(length: int, gram: int, counting: bool):
    names = ["anchor", "place"] if counting else ["anchor", "c1", "c2", "n1", "n2", "span"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            n1, n2 = (batch.column(k).to_numpy() for k in KEY)
            held, size = [], 0
            for block in pieces(text_bytes(batch.column("text")), length):
                data, piece, a, first, last, at, shift = anchors(block, powers, length, gram)
                text = np.array([k for k, _, _ in block], np.int64)[piece]
                if counting:
                    place = mix64((first + shift).astype(np.uint64) + mix64(n1[text].view(np.uint64)))
                    held.append((a.view(np.int64), place.view(np.int64)))
                else:
                    digest = b"".join([xxhash.xxh3_128_digest(data[f:e]) for f, e in zip(first.tolist(), (last + length).tolist(), strict=True)])
                    c = np.frombuffer(digest, np.int64).reshape(-1, 2)
                    held.append((a.view(np.int64), c[:, 0], c[:, 1], n1[text], n2[text], (first + shift) << 16 | (last - first) << 8 | (at - first)))
                size += len(a)
                if size > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], names)

    return run


def places_of(span: int) -> tuple[int, int, int]:
    """First window, last window and anchor's place; a span packs place << 16 | further windows << 8 | anchor's distance."""
    first = span >> 16
    return first, first + (span >> 8 & 255), first + (span & 255)


def shared_contexts(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """Places (anchor, c1, c2, n1, n2, span) whose anchor occurs elsewhere too, and their contexts.

    A context (anchor, c1, c2) has one of its places, another where it is ``whole`` (repeats), and whether its anchor has ``several``.
    """
    if length - gram > 255:
        raise ValueError("a context may hold 256 windows at most: raise gram")
    once = texts.mapInArrow(_anchors(length, gram, True), "anchor long, place long")
    shared = materialize(once.groupBy("anchor").agg(F.min("place").alias("a"), F.max("place").alias("z")).where("a < z").select("anchor"), "anchors")
    again = texts.mapInArrow(_anchors(length, gram, False), "anchor long, c1 long, c2 long, n1 long, n2 long, span long")
    found = materialize(again.join(shared, "anchor", "left_semi"), "contexts")
    discard(shared)
    one = F.struct("n1", "n2", "span")
    contexts = materialize(found.groupBy("anchor", "c1", "c2").agg(F.min(one).alias("one"), F.max(one).alias("other")).withColumn("whole", F.col("one") < F.col("other")), "distinct")
    several = materialize(contexts.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor", F.lit(True).alias("several")), "several")
    flagged = contexts.join(several, "anchor", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    return found, flagged.where("whole or several")


def common_prefix(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix, known to be ``at`` at least: what differs first is the highest bit of the exclusive or."""
    n = min(len(a), len(b))
    differs = int.from_bytes(a[at:n], "big") ^ int.from_bytes(b[at:n], "big")
    return n - (differs.bit_length() + 7) // 8


def front_code(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Sorted (suffix, tag) as one front-coded run."""
    out, last = [], b""
    for s, tag in entries:
        shared = common_prefix(last, s, 0)
        out.append(struct.pack("<HH", shared, len(s) - shared))
        out.append(tag)
        out.append(s[shared:])
        last = s
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[bytes, int, bytes]]:
    """(suffix, prefix shared with the predecessor, tag)."""
    at, last, head, size = 0, b"", struct.Struct("<HH"), TAG.itemsize
    while at < len(run):
        shared, rest = head.unpack_from(run, at)
        at += 4 + size
        last = last[:shared] + run[at : at + rest]
        yield last, shared, run[at - size : at]
        at += rest


class LoserTree:
    """Merges front-coded runs in order; known common prefixes are never compared again."""

    def __init__(self, runs: list[Iterator[tuple[bytes, int, bytes]]]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        # common prefix of each head with the last output (nothing yet: 0)
        self.shared = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers = [-1] * self.size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            k = node - self.size
            return k if k < len(self.runs) else -1
        return self._play(node, self._build(2 * node), self._build(2 * node + 1))

    def _play(self, node: int, a: int, b: int) -> int:
        """The smaller of two heads; the other stays at the node, with its prefix shared with the winner."""
        if b < 0 or self.heads[b] is None:
            self.losers[node] = b
            return a
        if a < 0 or self.heads[a] is None:
            self.losers[node] = a
            return b
        x, y = self.shared[a], self.shared[b]
        if x != y:  # the head that shares more with the last output comes first; the other's value holds against it too
            win, lose = (a, b) if x > y else (b, a)
        else:
            s, t = self.heads[a][0], self.heads[b][0]
            p = common_prefix(s, t, x)
            win, lose = (a, b) if p == len(s) or (p < len(t) and s[p] < t[p]) else (b, a)
            self.shared[lose] = p
        self.losers[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(suffix, prefix shared with the last output, tag) in order."""
        while (k := self.winner) >= 0 and self.heads[k] is not None:
            s, _, tag = self.heads[k]
            yield s, self.shared[k], tag
            self.heads[k] = head = next(self.runs[k], None)
            self.shared[k] = head[1] if head else 0
            node = (k + self.size) // 2
            while node:
                k = self._play(node, self.losers[node], k)
                node //= 2
            self.winner = k


def reaches(runs: list[bytes]) -> Iterator[tuple[bytes, int, int]]:
    """(tag, prefix shared with the predecessor, greatest prefix shared with a neighbour) of all suffixes of a range."""
    last, before = None, 0
    for _, shared, tag in LoserTree([read_run(r) for r in runs]):
        if last is not None:
            yield last, before, max(before, shared)
        last, before = tag, shared
    if last is not None:
        yield last, before, before


def _lists(column: pa.Array) -> Iterator[list[dict]]:
    """Values of a list-of-struct column, null as an empty list."""
    for value in column:
        yield value.as_py() or []


def sides(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[bytes, bytes]]:
    """What follows and what precedes the anchor of one place of each of several contexts; the place holds the side in its last bit."""
    texts, keys = text_bytes(batch.column("text")), zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)
    for text, (n1, n2), rows in zip(texts, keys, _lists(batch.column("rows")), strict=True):
        for r in rows:
            if r["several"]:
                first, last, at = places_of(r["span"])
                yield b"R" + text[at : last + length], struct.pack(_PACKED, n1, n2, r["anchor"], 2 * first)
                yield b"L" + text[first : at + gram][::-1], struct.pack(_PACKED, n1, n2, r["anchor"], 2 * first + 1)


def suffixes(batch: pa.RecordBatch, length: int, gram: int) -> Iterator[tuple[bytes, bytes]]:
    """Whole contexts, and what begins a level before the anchor, within both bounds."""
    texts, keys = text_bytes(batch.column("text")), zip(*(batch.column(k).to_pylist() for k in KEY), strict=True)
    for text, (n1, n2), rows, bounds in zip(texts, keys, _lists(batch.column("rows")), _lists(batch.column("bounds")), strict=True):
        spans = {}
        for r in rows:
            first, last, at = places_of(r["span"])
            spans[first] = last, at
            if r["whole"]:
                yield text[first : last + length], struct.pack(_PACKED, n1, n2, r["anchor"], first)
        for b in bounds:
            last, at = spans[b["first"]]
            for level in b["levels"]:
                p = at - level
                if level <= b["before"] and p <= last and level + b["after"] >= length:
                    yield text[p : last + length], struct.pack(_PACKED, n1, n2, b["anchor"], p)


def _sample(entries, length: int, gram: int, each: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[tuple[int, bytes]] = []
        for batch in batches:
            for i in range(0, batch.num_rows, 16):  # splitters only need to be about even
                for s, tag in entries(batch.slice(i, 1), length, gram):
                    best.append((hash(tag), s[: min(gram, 24)]))  # what shares a gram shares a range
                if len(best) > 20 * each:
                    best = sorted(best)[:each]
        yield pa.RecordBatch.from_arrays([pa.array([s for _, s in sorted(best)[:each]], pa.binary())], ["prefix"])

    return run


_FOUND = "n1 long, n2 long, anchor long, place long, low int, reach int"


def _found(tags: list[bytes], low: list[int], reach: list[int]) -> list[pa.Array]:
    t = np.frombuffer(b"".join(tags), TAG)
    return [pa.array(np.ascontiguousarray(t[k])) for k in TAG.names] + [pa.array(low, pa.int32()), pa.array(reach, pa.int32())]


def _runs(entries, length: int, gram: int, run_bytes: int, splitters: list[bytes]):
    names = ["range", "run", *(f.split()[0] for f in _FOUND.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[bytes, bytes]] = []
        size = 0

        def close() -> Iterator[pa.RecordBatch]:
            held.sort()
            tags, sizes, ranges, k = [], [], {}, 0
            while k < len(held):
                s, j = held[k][0], k + 1
                while j < len(held) and held[j][0] == s:
                    j += 1
                ranges.setdefault(bisect_right(splitters, s), []).append(held[k])  # once for all: neighbours still meet it
                if j > k + 1 and len(same := {tag for _, tag in held[k:j]}) > 1:
                    tags += same
                    sizes += [len(s)] * len(same)
                k = j
            held.clear()
            blobs = [(b, zstandard.compress(front_code(es), 3)) for b, es in ranges.items()]
            if tags:  # known already: they are passed on
                yield pa.RecordBatch.from_arrays([pa.nulls(len(tags), pa.int32()), pa.nulls(len(tags), pa.binary()), *_found(tags, sizes, sizes)], names)
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([x for _, x in blobs], pa.binary())] + [pa.nulls(len(blobs), pa.int64())] * 4 + [pa.nulls(len(blobs), pa.int32())] * 2, names)

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for e in entries(batch.slice(at, 64), length, gram):
                    held.append(e)
                    size += len(e[0]) + 150
                    if size > run_bytes:
                        yield from close()
                        size = 0
        if held:
            yield from close()

    return run


def _merge(least: int):
    def run(table):
        tags, lows, best = [], [], []
        for tag, low, reach in reaches([zstandard.ZstdDecompressor().decompress(r) for r in table.column("run").to_pylist()]):
            if reach >= least:
                tags.append(tag)
                lows.append(low)
                best.append(reach)
        return pa.table(_found(tags, lows, best), names=[f.split()[0] for f in _FOUND.split(", ")])

    return run


def sort_suffixes(texts: DataFrame, entries, length: int, gram: int, run_bytes: int, least: int, name: str) -> DataFrame:
    """Key, anchor, place, low (prefix shared with the predecessor) and reach (greatest prefix shared with another) of the suffixes that
    ``entries`` gives, where the reach is ``least`` at least."""
    parts = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), 8)
    sample = sorted(bytes(r[0]) for r in texts.mapInArrow(_sample(entries, length, gram, 200), "prefix binary").collect())  # 200 a task
    splitters = sorted({sample[len(sample) * k // (4 * parts)] for k in range(1, 4 * parts)}) if sample else []
    runs = materialize(texts.mapInArrow(_runs(entries, length, gram, run_bytes, splitters), f"range int, run binary, {_FOUND}"), f"{name}-runs")
    merged = runs.where("run is not null").select("range", "run").groupBy("range").applyInArrow(_merge(least), _FOUND)
    out = materialize(merged.unionByName(runs.where("run is null").drop("range", "run")), name)
    discard(runs)
    return out


def cut(text: bytes, covered: Iterable[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Removed bytes, removed runs, and the remaining bytes, given (place, size) of what goes."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for place, size in sorted(covered):
        if place > end:
            if end >= 0:
                removed += end - at
            kept.append(text[max(end, 0) : place])
            at, end, runs = place, place + size, runs + 1
        else:
            end = max(end, place + size)
    if end >= 0:
        removed += end - at
    kept.append(text[max(end, 0) :])
    return removed, runs, b"".join(kept)


def _cut(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(text_bytes(batch.column("text")), _lists(batch.column("spans")), strict=True):
                removed, runs, rest = cut(text, [(s["place"], s["size"]) for s in spans])
                rows.append((removed, runs, hashlib.sha256(rest).hexdigest(), rest.decode("utf-8", "replace") if with_text else None))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in KEY), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], [*KEY, "n_removed", "n_spans", "kept_sha256", "kept_text"])

    return run


def text_key(text: Column) -> list[Column]:
    """Two 64-bit hashes of a text."""
    return [F.xxhash64(text).alias(KEY[0]), F.xxhash64(F.lit(1), text).alias(KEY[1])]


def removals(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES, with_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index of all documents, cuts by text key): the index holds doc_id, key, n_bytes, sha256 and whether the text has a copy."""
    docs = require_columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keys = docs.select("doc_id", *text_key(F.col("text")), F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    keys = materialize(keys, "keys")
    copies = materialize(keys.groupBy(*KEY).agg(F.count("*").alias("n")).where("n > 1").select(*KEY, F.lit(True).alias("copied")), "copies")
    index = keys.join(copies, list(KEY), "left").withColumn("copied", F.coalesce("copied", F.lit(False)))

    # a text once, whatever number of copies it has; the buckets of its key serve all joins below
    unique = docs.where(F.octet_length("text") >= length).select(*text_key(F.col("text")), "text").groupBy(*KEY).agg(F.any_value("text").alias("text"))
    unique = materialize(unique, "texts", KEY)
    found, contexts = shared_contexts(unique, length, gram)
    contexts = materialize(contexts, "flagged")

    one = contexts.select("one.*", "anchor", "whole", "several")
    other = contexts.where("whole").select("other.*", "anchor", "whole", F.lit(False).alias("several"))
    rows = one.unionByName(other).groupBy(*KEY).agg(F.collect_list(F.struct("span", "anchor", "whole", "several")).alias("rows"))  # at most a text's own contexts
    sorted_ = materialize(unique.join(rows, list(KEY)), "suspects", KEY)

    near = sort_suffixes(sorted_, sides, length, gram, run_bytes, 0, "sides")
    before, place = F.col("place") % 2 == 1, F.floor(F.col("place") / 2).cast("long")
    bounds = near.groupBy(*KEY, "anchor", place.alias("first")).agg(F.max(F.when(before, F.col("reach") - 1 - gram)).alias("before"), F.max(F.when(~before, F.col("reach") - 1)).alias("after"))
    levels = near.where(before & (F.col("low") > gram)).groupBy("anchor").agg(F.collect_set(F.col("low") - 1 - gram).alias("levels"))  # at most a context's windows
    bounds = materialize(bounds.where(F.col("before") + F.col("after") >= length), "bounds")
    levels = materialize(levels, "levels")
    bounds = bounds.join(levels, "anchor").groupBy(*KEY).agg(F.collect_list(F.struct("first", "anchor", "before", "after", "levels")).alias("bounds"))
    spans = sort_suffixes(sorted_.join(materialize(bounds, "bounds"), list(KEY), "left"), suffixes, length, gram, run_bytes, length, "spans")

    # a whole context that the sort has found again covers all its places
    size = F.shiftright(F.col("one.span").bitwiseAND(65535), 8) + length
    whole = contexts.where("whole").select("anchor", "c1", "c2", F.col("one.n1").alias("n1"), F.col("one.n2").alias("n2"), F.shiftright("one.span", 16).alias("place"), size.alias("size"))
    repeated = whole.join(spans.groupBy(*KEY, "place").agg(F.max("reach").alias("reach")), [*KEY, "place"]).where("reach >= size").select("anchor", "c1", "c2", "size")
    heirs = found.join(materialize(repeated, "repeated"), ["anchor", "c1", "c2"]).select(*KEY, F.shiftright("span", 16).alias("place"), "size")
    covered = heirs.unionByName(spans.select(*KEY, "place", F.col("reach").cast("long").alias("size")))
    covered = materialize(covered.groupBy(*KEY).agg(F.collect_set(F.struct("place", "size")).alias("spans")), "covered")
    cuts = unique.join(covered, list(KEY)).mapInArrow(_cut(with_text), "n1 long, n2 long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return index, cuts


def substring_dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, run_bytes: int = RUN_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of ``docs`` (doc_id, text)."""
    index, cuts = removals(docs, length, gram, run_bytes, with_text=False)
    gone = F.col("copied") & (F.col("n_bytes") >= length)
    whole = index.where(gone).select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"))
    rest = index.where(~gone).join(cuts.drop("kept_text"), list(KEY), "left")
    kept = rest.select("doc_id", "n_bytes", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_removed", "n_spans")), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))
    return whole.unionByName(kept)
