"""Near-duplicates by cosine over all items: an exact join by cells around pivots, and the greedy filter on its pairs.

Unit vectors at a cosine of t or more lie within r = sqrt(2 - 2t) of each other.  Every vector has the cell of its nearest pivot as its home; if
y lies within r of x, then y's pivot is at most d + 2r from x, where d is x's distance from its own pivot.  So x visits exactly the cells
within that bound, and meets every y there; as y would meet x in x's cell as well, x visits only cells of a greater number, and each pair
meets once.  Cells are compared in blocks of bounded size, so no task holds a cell; a row travels once for each block that it meets, so blocks
are as large as a task can hold.  The pivots are a bounded sample; they decide how much is compared, never what is found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.arrow import matrix, whole_groups
from millrace.operators.dedup import greedy_keep

#: Pivots, numbers in a block's vectors, and rows and columns of a block that are compared at once.
PIVOTS, NUMBERS, ROWS, COLUMNS = 16, 1 << 21, 500, 4000


def _cells(pivots: np.ndarray, radius: float):
    """(key, v, cell, visits): each unit vector, its own cell, and those of a greater number that it must visit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = matrix(batch.column(1), pivots.shape[1])
            unit = v / np.sqrt((v * v).sum(axis=1))[:, None]
            far = np.sqrt(np.maximum(2 - 2 * unit @ pivots.T, 0))
            sound = np.isfinite(far).all(axis=1)  # others are near nothing
            unit, far = unit[sound], far[sound]
            own = far.argmin(axis=1)
            meets = (far <= far.min(axis=1, initial=np.inf)[:, None] + 2 * radius + 1e-9) & (np.arange(len(pivots)) > own[:, None])
            visits = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], meets.sum(axis=1).cumsum())), pa.int32()), pa.array(np.nonzero(meets)[1], pa.int32()))
            ends = pa.array(np.arange(len(unit) + 1) * v.shape[1], pa.int32())
            key = batch.column(0).filter(pa.array(sound))
            yield pa.RecordBatch.from_arrays([key, pa.ListArray.from_arrays(ends, pa.array(unit.ravel())), pa.array(own, pa.int32()), visits], ["key", "v", "cell", "visits"])

    return run


def _near(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, similarity) of rows of both that are near: single precision, with room for its error, says which to compute in double."""
    able = (a.astype(np.float32) @ b.astype(np.float32).T) >= np.float32(threshold - 1e-6 - (a.shape[1] + 8) * 1.2e-7)
    if np.count_nonzero(able) > able.size / 20:
        same = np.round(a @ b.T, 6)
        i, j = np.nonzero(same >= threshold)
        return i, j, same[i, j]
    i, j = np.nonzero(able)
    same = np.round((a[i] * b[j]).sum(axis=1), 6)
    return i[same >= threshold], j[same >= threshold], same[same >= threshold]


def _compare(threshold: float):
    """(a, b, similarity): rows at home in a block against those that meet them, or against each other where x = -1 - y."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["cell", "x", "y"]):
            spots = np.stack([rows.column(c).to_numpy() for c in ("cell", "x", "y")])
            at = np.concatenate(([0], np.flatnonzero((spots[:, 1:] != spots[:, :-1]).any(axis=0)) + 1, [rows.num_rows]))
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                part = rows.slice(lo, hi - lo)
                home, key = part.column("home").to_numpy(), part.column("key").to_numpy()
                v = part.column("v").combine_chunks().flatten().to_numpy().reshape(len(key), -1)
                inside = spots[1, lo] == -1 - spots[2, lo]
                mine, other = np.flatnonzero(home), np.flatnonzero(home if inside else ~home)
                for p in range(0, len(mine), ROWS):
                    for q in range(p if inside else 0, len(other), COLUMNS):
                        rows_, columns = mine[p : p + ROWS], other[q : q + COLUMNS]
                        i, j, same = _near(v[rows_], v[columns], threshold)
                        i, j = rows_[i], columns[j]
                        if inside:
                            once = i < j
                            i, j, same = i[once], j[once], same[once]
                        if len(i):
                            yield pa.RecordBatch.from_arrays([pa.array(f(key[i], key[j])) for f in (np.minimum, np.maximum)] + [pa.array(same)], ["a", "b", "similarity"])

    return run


def cosine_pairs(items: DataFrame, key: str, vector: str, threshold: float, checkpoint: Callable[[DataFrame], DataFrame], pivots: int = PIVOTS, block: int | None = None) -> DataFrame:
    """(a, b, similarity): all pairs of items with different vectors, a < b, at least so similar; keys are numbers.

    Equal vectors are one item, the first of them, and linked with it alone; null and zero vectors are near nothing.  Vectors have one length.
    """
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null and exists(v, x -> x <> 0)")
    classed = checkpoint(rows.withColumn("same", F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ","))))
    firsts = checkpoint(classed.groupBy("same").agg(F.min("key").alias("key"), F.any_value("v").alias("v")))
    centres = [r.v for r in firsts.orderBy(F.xxhash64("key"), "key").limit(pivots).collect()]  # a bounded sample
    if not centres:
        return rows.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("similarity")).limit(0)
    unit, size = np.array(centres) / np.linalg.norm(centres, axis=1)[:, None], block or max(NUMBERS // len(centres[0]), ROWS)
    radius = float(np.sqrt(max(2 - 2 * (threshold - 1e-6), 0)))  # similarities are rounded
    placed = checkpoint(firsts.select("key", "v").mapInArrow(_cells(unit, radius), "key long, v array<double>, cell int, visits array<int>"))
    number = lambda c: F.ceil(F.count("*") / size).cast("int").alias(c)
    visiting = placed.select(F.explode("visits").alias("cell")).groupBy("cell").agg(number("others"))
    sizes = placed.groupBy("cell").agg(number("homes")).join(visiting, "cell", "left").select("cell", "homes", F.coalesce("others", F.lit(0)).alias("others"))
    sizes = checkpoint(sizes)  # one row for each pivot
    own = lambda n: F.pmod(F.xxhash64("key"), F.col(n)).cast("int")
    every = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))
    home = placed.drop("visits").join(F.broadcast(sizes), "cell").withColumn("own", own("homes"))
    met = home.select("cell", F.col("own").alias("x"), F.explode(every("others")).alias("y"), F.lit(True).alias("home"), "key", "v")
    inside = home.withColumn("to", F.explode(every("homes"))).select("cell", F.least("own", "to").alias("x"), (-1 - F.greatest("own", "to")).alias("y"), (F.col("own") <= F.col("to")).alias("home"), "key", "v")
    guests = placed.select("key", "v", F.explode("visits").alias("cell")).join(F.broadcast(sizes), "cell").withColumn("own", own("others"))
    guests = guests.select("cell", F.explode(every("homes")).alias("x"), F.col("own").alias("y"), F.lit(False).alias("home"), "key", "v")
    blocks = met.unionByName(inside).unionByName(guests).repartition("cell", "x", "y").sortWithinPartitions("cell", "x", "y")
    found = blocks.mapInArrow(_compare(threshold), "a long, b long, similarity double")
    equal = classed.join(firsts.select("same", F.col("key").alias("a")), "same").where("a < key").select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    return found.unionByName(equal)


def semantic_keep(items: DataFrame, key: str, vector: str, checkpoint: Callable[[DataFrame], DataFrame], threshold: float = 0.88) -> DataFrame:
    """key and kept, in the order of ``key``: an item is dropped for an earlier, kept one at least so similar."""
    pairs = checkpoint(cosine_pairs(items, key, vector, threshold, checkpoint))
    return greedy_keep(items.select(F.col(key).cast("long").alias(key)), key, pairs, checkpoint)
