"""SentencePiece (unigram) encoding and decoding; giant documents by a max-plus parallel scan.

A document of more than ``chunk`` characters is split into chunks of that many.  The state at a chunk's border is how far the
last piece that starts before the border reaches beyond it (0 to longest piece - 1).  Then, in Spark stages:

1. every chunk yields its transfer matrix: best score from each entry state to each exit state;
2. per document the matrices are combined by an associative max-plus scan, which gives the exact best scores at all borders;
3. every chunk, seeded with those scores, yields the entry state to which each exit state's best path leads back;
4. per document these maps are followed from the end, which fixes one exit state per chunk;
5. every chunk is backtraced from its exit state, independently of the others.

Scores are whole numbers, so a chunk seeded with the scores at its border repeats the sequential run's comparisons and ties.
Inside a chunk, units between two forced cuts add a known score; a chunk without a cut is run once for each entry state.

Defined cases: null and empty texts have no ids; a text that holds the space mark itself decodes to a space there; rows that
repeat a doc_id are separate rows (they are told apart by an internal row id); other columns are ignored by ``encode``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, require_columns, text_bytes, worker_memory
from millrace.llm.token_counts import blocks
from millrace.llm.unigram import SPACE, Unigram

CHUNK = 32_768
NEVER = -(10**15)


def maxplus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Max-plus products of two stacks of matrices; unreachable stays unreachable."""
    out = np.full_like(a, NEVER)
    for k in range(a.shape[-1]):
        np.maximum(out, a[..., :, k, None] + b[..., None, k, :], out=out)
    return np.where(out < NEVER // 2, NEVER, out)


def prefix_products(mats: np.ndarray) -> np.ndarray:
    """Products of the first 1, 2, ... matrices, by doubling: the operation is associative."""
    out, step = mats.copy(), 1
    while step < len(out):
        out[step:] = maxplus(out[:-step], out[step:])
        step *= 2
    return out


class Chunk:
    """One chunk: ``text`` is its body and up to longest-1 further characters; pieces may start in the body only."""

    def __init__(self, model: Unigram, text: str, body: int, last: bool):
        self.model, self.text, self.body, self.last = model, text, body, last
        self.states = model.longest
        cuts = [i for i in self._cuts(text[: body + 1]) if i < body or last]
        self.head = next((i for i in cuts if i >= self.states), None)
        self.tail = None if self.head is None else cuts[-1]

    @staticmethod
    def _cuts(text: str) -> list[int]:
        return [i for i in _find_all(text, SPACE) if i and text[i - 1] != SPACE]

    def middle(self) -> list[tuple[bytes, int]]:
        """Ids and scores of the units between the two cuts."""
        units = self.model.units(self.text[self.head + 1 : self.tail].replace(SPACE, " ").encode()) if self.tail > self.head else []
        known = self.model.remember([units], self.model.ids_and_scores)
        return [known[u] for u in units]

    def _exits(self, best: list[int], base: int) -> list[int]:
        at = self.body - base
        got = best[at : at + 1] if self.last else best[at : at + self.states]
        return (got + [NEVER] * self.states)[: self.states]

    def matrix(self) -> np.ndarray:
        s = self.states
        if self.head is None:
            rows = [self._exits(self.model.lattice(self.text, {d: 0}, self.body)[0], 0) if d < self.body or (self.last and d <= self.body) else [NEVER] * s for d in range(s)]
            return np.array(rows, np.int64)
        head = np.array([self.model.lattice(self.text[: self.head], {d: 0})[0][-1] for d in range(s)], np.int64)
        tail = np.array(self._exits(self.model.lattice(self.text[self.tail :], None, self.body - self.tail)[0], self.tail), np.int64)
        out = head[:, None] + sum(score for _, score in self.middle()) + tail[None, :]
        return np.where(out < NEVER // 2, NEVER, out)

    def _seeds(self, entry: list[int]) -> dict[int, int]:
        return {d: int(v) for d, v in enumerate(entry) if v > NEVER // 2}

    def entries(self, entry: list[int]) -> list[int]:
        """For each exit state, the entry state of its best path (-1: unreachable)."""
        seeds = self._seeds(entry)
        if self.head is None:
            lat = self.model.lattice(self.text, seeds, self.body)
            best = self._exits(lat[0], 0)
            return [self.model.backtrace(self.text, lat, self.body + e)[1] if best[e] > NEVER // 2 else -1 for e in range(self.states)]
        text = self.text[: self.head]
        return [self.model.backtrace(text, self.model.lattice(text, seeds), self.head)[1]] * self.states

    def ids(self, entry: list[int], leave: int) -> list[int]:
        """Ids of the pieces that start in this chunk, on the path that leaves in this state."""
        seeds = self._seeds(entry)
        if self.head is None:
            return self.model.backtrace(self.text, self.model.lattice(self.text, seeds, self.body), self.body + leave)[0]
        text = self.text[: self.head]
        out = self.model.backtrace(text, self.model.lattice(text, seeds), self.head)[0]
        for ids, _ in self.middle():
            out.extend(np.frombuffer(ids, np.int32).tolist())
        text = self.text[self.tail :]
        out.extend(self.model.backtrace(text, self.model.lattice(text, None, self.body - self.tail), self.body - self.tail + leave)[0])
        return out


def _find_all(text: str, mark: str) -> Iterator[int]:
    at = text.find(mark)
    while at >= 0:
        yield at
        at = text.find(mark, at + 1)


def split(text: str, chunk: int, longest: int) -> list[tuple[str, int, bool]]:
    """(text with what follows, length of the body, whether it is the last) of the marked text's chunks."""
    t = SPACE + text.replace(" ", SPACE)
    chunk = max(chunk, 2 * longest)
    n = max(1, -(-len(t) // chunk))
    while n > 1 and len(t) - (n - 1) * chunk < longest:  # a last body must be longer than any piece
        n -= 1
    ends = [*(chunk * k for k in range(1, n)), len(t)]
    return [(t[a : min(b + longest - 1, len(t))], b - a, b == len(t)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def borders(mats: np.ndarray) -> np.ndarray:
    """Best scores at the entry of each chunk."""
    first = np.full(mats.shape[1], NEVER, np.int64)
    first[0] = 0
    return np.vstack((first, prefix_products(mats)[:-1, 0, :])) if len(mats) > 1 else first[None, :]


def leaves(maps: np.ndarray) -> list[int]:
    """Exit state of each chunk, followed from the end of the document."""
    out = [0]
    for m in maps[:0:-1]:
        out.append(int(m[out[-1]]))
    return out[::-1]


def _split_rows(chunk: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True):
                parts = split(text, chunk, longest)
                yield pa.RecordBatch.from_arrays([pa.array([row] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([p[0] for p in parts]), pa.array([p[1] for p in parts], pa.int32()), pa.array([p[2] for p in parts])], ["row", "k", "part", "body", "last"])

    return run


def _matrices(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_memory(("chunks", vocabulary), lambda: Unigram(vocabulary))
        for batch in batches:
            rows = batch.to_pylist()
            mats = [Chunk(model, r["part"], r["body"], r["last"]).matrix().ravel() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(mats, pa.list_(pa.int64()))], ["row", "k", "cells"])

    return run


def _borders(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    cells = np.array(pdf["cells"].tolist(), np.int64)
    s = int(round(cells.shape[1] ** 0.5))
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "entry": list(borders(cells.reshape(-1, s, s)))})


def _entries(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_memory(("chunks", vocabulary), lambda: Unigram(vocabulary))
        for batch in batches:
            found = [Chunk(model, r["part"], r["body"], r["last"]).entries(r["entry"]) for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(found, pa.list_(pa.int32()))], ["row", "k", "back"])

    return run


def _leaves(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("k")
    return pd.DataFrame({"row": pdf["row"], "k": pdf["k"], "leave": leaves(np.array(pdf["back"].tolist(), np.int64))})


def _backtraces(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_memory(("chunks", vocabulary), lambda: Unigram(vocabulary))
        for batch in batches:
            ids = [np.array(Chunk(model, r["part"], r["body"], r["last"]).ids(r["entry"], r["leave"]), np.int32).tobytes() for r in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("k"), pa.array(ids, pa.binary())], ["row", "k", "ids"])

    return run


def scan(giants: DataFrame, vocabulary: str, chunk: int = CHUNK) -> DataFrame:
    """(row, k, ids as int32 bytes) of every chunk of ``giants`` (row, text)."""
    longest = Unigram(vocabulary).longest
    parts = materialize(giants.mapInArrow(_split_rows(chunk, longest), "row long, k int, part string, body int, last boolean").repartition("row", "k"), "chunks")
    cells = parts.mapInArrow(_matrices(vocabulary), "row long, k int, cells array<long>")
    entry = materialize(cells.groupBy("row").applyInPandas(_borders, "row long, k int, entry array<long>"), "borders")
    seeded = parts.join(entry, ["row", "k"])
    back = seeded.mapInArrow(_entries(vocabulary), "row long, k int, back array<int>")
    leave = materialize(back.groupBy("row").applyInPandas(_leaves, "row long, k int, leave int"), "leaves")
    return seeded.join(leave, ["row", "k"]).mapInArrow(_backtraces(vocabulary), "row long, k int, ids binary")


def _short(vocabulary: str, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_memory(("ids", vocabulary), lambda: Unigram(vocabulary))
        for batch in batches:
            texts = text_bytes(batch.column("text"))
            for part in blocks(texts):
                units = [model.units(t) if t and len(t) < chunk else [] for t in texts[part]]
                known = model.remember(units, lambda us: [ids for ids, _ in model.ids_and_scores(us)])
                ids = [b"".join(map(known.__getitem__, us)) for us in units]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(part.start, part.stop - part.start), pa.array(ids, pa.binary())], ["row", "ids"])

    return run


class Decoder:
    """Many ids at once back to UTF-8 bytes."""

    def __init__(self, vocabulary: str):
        self.table, self.at = Unigram(vocabulary).byte_table()

    def bytes(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        size = self.at[ids + 1] - self.at[ids]
        ends = np.cumsum(size)
        return self.table[np.repeat(self.at[ids] - ends + size, size) + np.arange(ends[-1])].tobytes()

    def text(self, ids: np.ndarray) -> bytes:
        """Without the space that encoding added in front."""
        out = self.bytes(ids)
        return out[1:] if out[:1] == b" " else out


def _digest(vocabulary: str, with_ids: bool):
    def one(decoder: Decoder, text: bytes | None, raw: bytes) -> tuple[int, int, bool]:
        ids = np.frombuffer(raw, np.int32)
        return len(ids), zlib.crc32(raw), decoder.text(ids) == (text or b"")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_memory(("decoder", vocabulary), lambda: Decoder(vocabulary))
        for batch in batches:
            texts, raws = text_bytes(batch.column("text")), batch.column("ids").to_pylist()
            got = [one(decoder, t, r or b"") for t, r in zip(texts, raws, strict=True)]
            cols = [batch.column("doc_id"), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got])]
            names = ["doc_id", "n_tokens", "ids_crc32", "round_trip"]
            if with_ids:
                cols.append(pa.array([np.frombuffer(r or b"", np.int32) for r in raws], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "ids": [b"".join(pdf.sort_values("k")["ids"])]})


def encode(docs: DataFrame, vocabulary: str, chunk: int = CHUNK, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (int32, little-endian), round_trip (decoding gives the text back) and ids of ``docs``."""
    out = "doc_id long, n_tokens long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    docs = require_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    giant = F.coalesce(F.octet_length("text") >= chunk, F.lit(False))
    short = docs.where(~giant).mapInArrow(_encode_digest(vocabulary, chunk, with_ids), out)
    giants = materialize(docs.where(giant).withColumn("row", F.monotonically_increasing_id()), "giants")
    ids = scan(giants.select("row", "text"), vocabulary, chunk).groupBy("row").applyInPandas(_joined, "row long, ids binary")
    long = giants.join(ids, "row").select("doc_id", "text", "ids").mapInArrow(_digest(vocabulary, with_ids), out)
    return short.unionByName(long)


def _encode_digest(vocabulary: str, chunk: int, with_ids: bool):
    digest, short = _digest(vocabulary, with_ids), _short(vocabulary, 1 << 62)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def halves() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = text_bytes(batch.column("text"))
                for part in blocks(texts):
                    yield batch.slice(part.start, part.stop - part.start)

        kept: list[pa.RecordBatch] = []

        def rows() -> Iterator[pa.RecordBatch]:
            for b in halves():
                kept.append(b)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text")], ["row", "text"])

        def joined() -> Iterator[pa.RecordBatch]:
            for got in short(rows()):
                b = kept.pop(0)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), got.column("ids")], ["doc_id", "text", "ids"])

        yield from digest(joined())

    return run


def _decode(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = worker_memory(("decoder", vocabulary), lambda: Decoder(vocabulary))
        for batch in batches:
            texts = [decoder.text(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return run


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give an empty text."""
    return require_columns(encoded, "doc_id", "ids").mapInArrow(_decode(vocabulary), "doc_id long, text string")
