"""The n greatest rows without a sort: a threshold found by narrowing histograms, then a filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS, FEW = 1024, 10_000


def _narrowed(rows: DataFrame, n: int, of: str) -> tuple[float, float, int]:
    """(lo, hi, left): a range of ``of`` of few rows, or of one value, in which the n-th greatest lies, as the left-th greatest of it."""
    least, most, count = rows.agg(F.min(of), F.max(of), F.count(of)).first()
    left = n
    while count > FEW and least < most:
        width = (most - least) / BUCKETS
        if least + width == least:  # numbers next to each other
            break
        bucket = F.least(F.floor((F.col(of) - F.lit(least)) / F.lit(width)), F.lit(BUCKETS - 1))
        inside = rows.where(F.col(of).between(F.lit(least), F.lit(most)))
        found = inside.groupBy(bucket.alias("b")).agg(F.count("*").alias("n"), F.min(of).alias("lo"), F.max(of).alias("hi")).orderBy(F.desc("b")).collect()  # BUCKETS rows at most
        for r in found:
            if left <= r.n:
                break
            left -= r.n
        least, most, count = r.lo, r.hi, r.n
    return least, most, left


def greatest(rows: DataFrame, value: Column, key: str, n: int) -> DataFrame:
    """The n rows of greatest value, ties to smaller keys (numbers); null values are last and never taken.

    Each pass over the rows sends one histogram to the driver; no task holds more than a histogram, whatever n is.
    """
    named = rows.withColumn("_v", value.cast("double")).where("_v IS NOT NULL AND NOT isnan(_v)")
    total = named.count()
    if n >= total or n <= 0:
        return named.drop("_v") if n > 0 else named.limit(0).drop("_v")
    lo, hi, left = _narrowed(named, n, "_v")
    if lo < hi:  # few rows: the cut is among them
        last = named.where(F.col("_v").between(F.lit(lo), F.lit(hi))).select("_v", key).orderBy(F.desc("_v"), key).limit(left).collect()[-1]
        return named.where((F.col("_v") > last[0]) | ((F.col("_v") == last[0]) & (F.col(key) <= last[1]))).drop("_v")
    ties = named.where(F.col("_v") == lo).select((-F.col(key).cast("double")).alias("_k"))
    low, high, rest = _narrowed(ties, left, "_k")
    cut = low if low == high else ties.where(F.col("_k").between(F.lit(low), F.lit(high))).orderBy(F.desc("_k")).limit(rest).collect()[-1][0]
    return named.where((F.col("_v") > lo) | ((F.col("_v") == lo) & (-F.col(key).cast("double") >= cut))).drop("_v")
