"""Chunks of documents: sections by heading or legal article, packed to a size, merged where short, with an overlap.

Every document is cut on its own inside one Arrow pass; nothing is shuffled.  Null and empty texts give no chunk; a word longer
than the limit is a chunk of its own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Sizes of chunks in characters, headings, legal articles, and where a text may break, coarsest first.
LEAST, MOST, OVERLAP = 250, 2200, 150
HEADING = re.compile(r"^#{1,3}\s+(?P<title>.+)$", re.M)
ARTICLE = re.compile(r"^(?P<title>(?:Article|Art(?:ykuł)?\.?|§|Section)\s+\d+\b.*)$", re.M | re.I)
LEVELS = ((re.compile(r"\n{2,}"), "\n\n"), (re.compile(r"(?<=[.!?…])\s+(?=[A-ZĄĆĘŁŃÓŚŹŻ\"(\[])"), " "), (re.compile(r"\s+"), " "))


def sections(text: str) -> list[tuple[str, str]]:
    """(title, body) by headings, else by legal articles, else the whole text; text before the first title and empty bodies go."""
    for pattern in (HEADING, ARTICLE):
        marks = list(pattern.finditer(text))
        bodies = [(m["title"].strip(), text[m.end() : n].strip()) for m, n in zip(marks, [m.start() for m in marks[1:]] + [len(text)], strict=True)] if marks else []
        found = [(t, b) for t, b in bodies if b]
        if found or (marks and pattern is HEADING):
            return found
    return [("", text.strip())]


def pack(text: str, most: int = MOST, level: int = 0) -> list[str]:
    """Pieces of up to ``most`` characters, filled in order; what is too long for a level is packed by the next finer one."""
    breaks, glue = LEVELS[level]
    done, open_ = [], ""
    for piece in breaks.split(text):
        if len(open_) + len(glue) + len(piece) <= most:
            open_ = f"{open_}{glue}{piece}".strip() if open_ else piece.strip()
            continue
        if open_:
            done.append(open_)
        open_ = piece.strip()
        if len(piece) > most and level + 1 < len(LEVELS):
            finer = pack(piece, most, level + 1)
            # after words the last piece stays open for the next sentence, after sentences a paragraph is closed
            open_ = finer.pop() if level and finer else ""
            done += finer
    return [*done, open_] if open_ else done


def chunks(text: str | None, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> list[tuple[str, str]]:
    """(title, body) of each chunk."""
    parts = [(t, p.strip()) for t, body in sections(text or "") for p in ([body] if len(body) <= most else pack(body, most)) if len(p.strip()) >= least // 2]
    merged: list[tuple[str, str]] = []
    for title, body in parts:
        if merged and len(merged[-1][1]) < least:
            merged[-1] = (merged[-1][0], merged[-1][1] + (f"\n\n## {title}\n\n" if title else "\n\n") + body)
        else:
            merged.append((title, body))
    merged = [c for c in merged if len(c[1]) >= least]
    if overlap <= 0:
        return merged
    return [(t, f"[...{merged[i - 1][1][-overlap:].strip()}]\n\n{b}" if i else b) for i, (t, b) in enumerate(merged)]


def chunk_documents(docs: DataFrame, key: str, body: str, least: int = LEAST, most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, title and body of all chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, i, t, b) for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (t, b) in enumerate(chunks(text, least, most, overlap))]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int32(), pa.string(), pa.string()))], ["key", "chunk_index", "title", "body"])

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(body).alias("body"))
    return rows.mapInArrow(run, "key long, chunk_index int, title string, body string").withColumnRenamed("key", key)
