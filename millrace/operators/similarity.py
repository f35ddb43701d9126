"""Exact similarity joins that no hot key can stall: sets by prefixes in a global order of frequency, hashes by recursive blocks.

Both build groups in which every wanted pair meets, deal groups of many rows out as pairs of blocks, compare inside tasks, and
hand on only pairs that hold, each from the first group in which it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.arrow import list_rows, whole_groups

BLOCK, COLUMNS = 400, 20_000


def dealt(rows: DataFrame, group: list[str], key: str, block: int) -> DataFrame:
    """``rows`` of groups with more than one row, in order of (group, x, y): a group of n rows is ceil(n / block) blocks, and each
    pair of blocks x <= y is a part of its own; ``own`` is the block of a row."""
    sizes = rows.groupBy(*group).agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = rows.join(sizes, group).withColumn("own", F.pmod(F.xxhash64(key), blocks).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    placed = placed.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other")).drop("other", "n")
    return placed.repartition(*group, "x", "y").sortWithinPartitions(*group, "x", "y")


def _parts(rows: pa.Table, keys: list[str]) -> Iterator[tuple[int, int]]:
    """Bounds of the groups in sorted rows, those of one row left out."""
    change = np.zeros(rows.num_rows - 1, bool)
    for k in keys:
        v = rows.column(k).to_numpy()
        change |= v[1:] != v[:-1]
    at = np.concatenate(([0], np.flatnonzero(change) + 1, [rows.num_rows]))
    many = np.flatnonzero(np.diff(at) > 1)
    yield from zip(at[many].tolist(), at[many + 1].tolist(), strict=True)


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections in a part, some thousands of elements at a time."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    keep = (np.bincount(column) > 1)[column]  # what one set alone holds overlaps with nothing
    row, column = row[keep], column[keep]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for lo in range(0, len(values), COLUMNS):
        here = (column >= lo) & (column < lo + COLUMNS)
        if here.any():
            has = np.zeros((len(sets), COLUMNS), np.float32)
            has[row[here], column[here] - lo] = 1
            out += has @ has.T
    return out


def _set_pairs(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["code", "x", "y"]):
            code, x, y, own, key, sizes = (rows.column(c).to_numpy() for c in ("code", "x", "y", "own", "key", "size"))
            every, found = list(list_rows(rows.column("codes"))), ([], [], [])
            for lo, hi in _parts(rows, ["code", "x", "y"]):
                sets, size = every[lo:hi], sizes[lo:hi]
                both = _overlaps(sets)
                same = both / (size[:, None] + size[None, :] - both)
                fits = np.triu(same >= threshold - 1e-9, 1)
                if x[lo] != y[lo]:
                    fits &= own[lo:hi, None] != own[None, lo:hi]
                for i, j in zip(*np.nonzero(fits), strict=True):
                    if np.intersect1d(sets[i], sets[j], assume_unique=True)[0] == code[lo]:
                        a, b = sorted((key[lo + i], key[lo + j]))
                        found[0].append(a), found[1].append(b), found[2].append(both[i, j] / (size[i] + size[j] - both[i, j]))
            yield pa.RecordBatch.from_arrays([pa.array(f, t) for f, t in zip(found, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["a", "b", "similarity"])

    return run


def jaccard_pairs(rows: DataFrame, key: str, elements: str, threshold: float, checkpoint: Callable[[DataFrame], DataFrame], block: int = BLOCK) -> DataFrame:
    """(a, b, similarity): all pairs a < b of rows with unlike sets whose Jaccard similarity is at least ``threshold`` (over 0), and each
    row of an equal set with the first one.  Keys are numbers; null and empty sets are near nothing.  Made for texts of up to some
hundred elements (questions, titles, items): a set travels once for each of its first elements that another set has too.

    A set's elements are put in a global order, rare ones first.  Sets so similar share one of their first
    size - ceil(threshold * size) + 1 elements, and the first element that they share at all is one of those: there, and only there,
    the pair counts.  Elements of one set alone come first in that order and meet nothing: they count, but get no number and travel no further.
    """
    sets = rows.select(F.col(key).cast("long").alias("key"), F.sort_array(F.array_distinct(elements)).alias("s"))
    classed = checkpoint(sets.withColumn("same", F.md5(F.to_json("s")))).where("size(s) > 0")  # not before: the sets would be made twice
    firsts = checkpoint(classed.groupBy("same").agg(F.min("key").alias("key"), F.any_value("s").alias("s")))
    flat = firsts.select("key", (F.size("s") - F.get("s", F.lit(0)).isNull().cast("int")).alias("size"), F.explode("s").alias("element"))
    counts = flat.groupBy("element").agg(F.count("*").alias("n")).where("n > 1")
    codes = checkpoint(counts.repartitionByRange("n", "element").sortWithinPartitions("n", "element").select("element", F.monotonically_increasing_id().alias("code")))
    coded = checkpoint(flat.join(codes, "element").groupBy("key", "size").agg(F.sort_array(F.collect_list("code")).alias("codes")))
    prefix = F.size("codes") - F.ceil(F.lit(threshold) * F.col("size") - 1e-9).cast("int") + 1  # less what is the set's alone
    placed = coded.where(prefix > 0).select("key", "size", "codes", F.explode(F.slice("codes", F.lit(1), prefix)).alias("code"))
    near = dealt(placed, ["code"], "key", block).select("code", "x", "y", "own", "key", "size", "codes").mapInArrow(_set_pairs(threshold), "a long, b long, similarity double")
    equal = classed.join(firsts.select("same", F.col("key").alias("a")), "same").where("a < key").select("a", F.col("key").alias("b"), F.lit(1.0).alias("similarity"))
    return near.unionByName(equal)


def _hash_pairs(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["spot", "x", "y"]):
            x, y, own, key = (rows.column(c).to_numpy() for c in ("x", "y", "own", "key"))
            bits, found = rows.column("bits").to_numpy().view(np.uint64), ([], [], [])
            for lo, hi in _parts(rows, ["spot", "x", "y"]):
                far = np.bitwise_count(bits[lo:hi, None] ^ bits[None, lo:hi])
                fits = np.triu(far <= distance, 1)
                if x[lo] != y[lo]:
                    fits &= own[lo:hi, None] != own[None, lo:hi]
                i, j = np.nonzero(fits)
                found[0].append(np.minimum(key[lo + i], key[lo + j])), found[1].append(np.maximum(key[lo + i], key[lo + j])), found[2].append(far[i, j])
            columns = [pa.array(np.concatenate(f) if f else [], t) for f, t in zip(found, (pa.int64(), pa.int64(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", "distance"])

    return run


def _field(bits: str, lo: int, hi: int):
    """Bits lo to hi of a column of 64, counted from the lowest."""
    return F.shiftrightunsigned(bits, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1 if hi - lo < 63 else -1))


def hamming_pairs(hashes: DataFrame, key: str, bits: str, distance: int, checkpoint: Callable[[DataFrame], DataFrame], crowded: int = 1000, block: int = BLOCK) -> DataFrame:
    """(a, b, distance): all pairs a < b of unlike 64-bit hashes at most ``distance`` apart, and each row of an equal hash with the first.

    Of distance + 1 blocks of bits one is equal.  A block's value that more than ``crowded`` hashes share is cut again: the rest of
    the bits differs in at most ``distance`` places too, so of distance + 1 parts of it one is equal; and once more.
    What is crowded still is dealt out as pairs of blocks.
    """
    rows = hashes.select(F.col(key).cast("long").alias("key"), F.col(bits).cast("long").alias("bits")).where("bits is not null")
    firsts = checkpoint(rows.groupBy("bits").agg(F.min("key").alias("key")))
    equal = rows.join(firsts.select("bits", F.col("key").alias("a")), "bits").where("a < key").select("a", F.col("key").alias("b"), F.lit(0).alias("distance"))

    def cut(spans: list[tuple[int, int]], path: str, now: DataFrame, depth: int) -> list[DataFrame]:
        """Rows by the equal parts of the bits in ``spans``; crowded ones by the parts of what is left."""
        width, parts, at = sum(hi - lo for lo, hi in spans), [], 0
        flat = [b for lo, hi in spans for b in range(lo, hi)]
        for k in range(distance + 1):
            size = (width - at) // (distance + 1 - k)
            parts.append(flat[at : at + size])
            at += size
        out = []
        for k, part in enumerate(p for p in parts if p):
            runs = [(b, b + 1) for b in part]
            merged = [runs[0]]
            for lo, hi in runs[1:]:
                merged = [*merged[:-1], (merged[-1][0], hi)] if merged[-1][1] == lo else [*merged, (lo, hi)]
            name = f"{path}.{k}"
            value = F.concat_ws("_", F.lit(name), *([F.col("spot")] if depth else []), *[_field("bits", lo, hi).cast("string") for lo, hi in merged])
            out.append((name, merged, now.select("key", "bits", value.alias("spot"))))
        found = []
        for name, merged, placed in out:
            if depth >= 2:
                found.append(placed)
                continue
            full = checkpoint(placed.groupBy("spot").agg(F.count("*").alias("n")).where(F.col("n") > crowded))
            found.append(placed.join(full, "spot", "left_anti"))
            if full.limit(1).count():
                used = {b for lo, hi in merged for b in range(lo, hi)}
                rest = [(b, b + 1) for b in flat if b not in used]
                found += cut(rest, name, placed.join(full, "spot", "left_semi"), depth + 1)
        return found

    every = cut([(0, 64)], "h", firsts, 0)
    placed = every[0]
    for more in every[1:]:
        placed = placed.unionByName(more)
    near = dealt(placed.select("key", "bits", F.xxhash64("spot").alias("spot")), ["spot"], "key", block)
    near = near.select("spot", "x", "y", "own", "key", "bits").mapInArrow(_hash_pairs(distance), "a long, b long, distance int").distinct()
    return near.unionByName(equal)
