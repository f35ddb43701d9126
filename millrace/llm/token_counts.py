"""Token counts without tokenizing: count-only Viterbi over the matches that an Aho-Corasick automaton enumerates.

The lattice carries, for each end position, the best score and the number of ids on the best path; there are no back pointers
and no ids.  Units (see ``unigram``) that were seen before are looked up.  Counts are those of a unigram model over the vocabulary
file's pieces; where the file itself is a model of another kind (its scores are merge ranks), its own tokenizer may count otherwise.

Defined cases: null and empty texts count 0 with score 0; rows are independent, so repeated rows and null ids stay as they
are; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import require_columns, text_bytes, worker_memory
from millrace.llm.unigram import Unigram

#: Texts are taken in blocks of about so many bytes, so that memory does not depend on the rows in a batch.
BLOCK = 1 << 20


def blocks(texts: list[bytes | None]) -> Iterator[slice]:
    at = 0
    while at < len(texts):
        stop, total = at, 0
        while stop < len(texts) and (stop == at or total < BLOCK):
            total += len(texts[stop] or b"")
            stop += 1
        yield slice(at, stop)
        at = stop


def _packed(model: Unigram):
    """Values of units as score * 2**40 + count: one sum over a text gives both."""
    return lambda units: [(score << 40) + n for n, score in model.counts(units)]


def _count(vocabulary: str, remembered: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = worker_memory(("counts", vocabulary), lambda: Unigram(vocabulary, remembered))
        values = _packed(model)
        for batch in batches:
            texts, totals = text_bytes(batch.column(1)), []
            for part in blocks(texts):
                units = [model.units(t) if t else [] for t in texts[part]]
                known = model.remember(units, values)
                totals += [sum(map(known.__getitem__, us)) for us in units]
            counts, best = [t & (1 << 40) - 1 for t in totals], [t >> 40 for t in totals]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(best, pa.int64())], ["doc_id", "n_tokens", "score"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, remembered: int = 500_000) -> DataFrame:
    """doc_id, n_tokens and score (of the best path) for each row of ``docs`` (doc_id, text)."""
    docs = require_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return docs.mapInArrow(_count(vocabulary, remembered), "doc_id long, n_tokens long, score long")
