"""Arrow batches inside tasks: list columns as NumPy views, and whole groups out of sorted batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def list_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each list of an Arrow list column as a NumPy view of its values, None for null lists; null elements of floats are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    for k, there in enumerate(valid):
        yield values[offsets[k] : offsets[k + 1]] if there else None


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column without nulls, all of one length, as one double matrix over the Arrow buffer."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal ``keys``, from batches sorted by them; the last group waits for more rows."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        same = np.ones(rows.num_rows, bool)
        for k in keys:
            same &= pc.equal(rows.column(k), rows.column(k)[rows.num_rows - 1]).to_numpy(zero_copy_only=False).astype(bool)
        start = rows.num_rows - int(same.sum())
        if start:
            yield rows.slice(0, start)
        rest = rows.slice(start)
    if rest is not None:
        yield rest
