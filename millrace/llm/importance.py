"""Quality classifier by importance resampling over hashed n-grams.

Two generative models of hashed word n-grams (1 and 2 words): raw text (all documents) and target text (documents labelled as
wanted).  A bucket's log ratio is ln((t + s) / (r + s)), with t its count in the target, r its count in the raw text scaled to the
target's size, and s a smoothing count.  Groups of copies make the counts of rare words jump, so ratios are shrunk by their evidence:
times max(0, 1 - c / z**2), where z is by how many standard deviations t differs from its expectation among all labelled rows.
A document's log importance weight is the plain sum of its n-grams' log ratios.  A standard Gumbel variate, hashed from doc_id and
seed, is added, and the k documents with the greatest sums are kept: sampling without replacement in proportion to the weights
(temperature 1).

k is ``share`` of the rows where given.  Otherwise it is the number of documents whose weight exceeds a cut, fitted on labelled
rows that the models have not seen (a quarter, by a hash of doc_id): the cut with the least sum of the rate of kept unwanted rows and
``clean_cost`` times the rate of dropped wanted rows.  Labelled rows are the bounded sample: where there are more than ``label_rows``
labels, those whose hash of doc_id lies below that share; raw counts and weights cover every document.

Counts are 3 * buckets numbers however large the corpus is; each task adds up its own before the shuffle.

Defined cases: null and empty texts have no n-grams and weight 0; a null doc_id has the Gumbel variate of a key of its own;
rows that repeat a doc_id each count and are judged by their own text; ties at the k-th place are all kept; without wanted or
unwanted labels every document is kept; other columns are ignored by ``classify`` and passed through by ``keep``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import WordHash, gram_hashes, materialize, require_columns, text_bytes

BUCKETS, SMOOTHING, SHRINKAGE, CLEAN_COST, SEED, LABEL_ROWS = 1 << 18, 5.0, 25.0, 5.0, 7, 200_000
#: Weights are fitted in steps of 1/STEPS, up to REACH in either direction.
STEPS, REACH = 100, 1000


def features(text: bytes | None, hashes: WordHash, buckets: int) -> np.ndarray:
    words = text.lower().split() if text else []
    h = hashes.array(words)
    return (np.concatenate((gram_hashes(h, (0,)), gram_hashes(h, (0, 1)))) % np.uint64(buckets)).astype(np.int64)


def _counts(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total = WordHash.shared(), np.zeros(buckets, np.int64)
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                np.add.at(total, features(text, hashes, buckets), 1)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int) -> np.ndarray:
    """Counts by bucket over all rows of ``texts`` (text)."""
    out = np.zeros(buckets, np.int64)
    table = texts.select("text").mapInArrow(_counts(buckets), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # at most ``buckets`` rows
    out[table.column("bucket").to_numpy()] = table.column("n").to_numpy()
    return out


def ratios(target: np.ndarray, labelled: np.ndarray, raw: np.ndarray, smoothing: float = SMOOTHING, shrinkage: float = SHRINKAGE) -> np.ndarray:
    """Shrunk log ratio of each bucket."""
    share = target.sum() / max(labelled.sum(), 1)
    expected = labelled * share
    z2 = (target - expected) ** 2 / (expected * (1 - share) + 0.1)
    kept = np.maximum(0.0, 1 - shrinkage / np.maximum(z2, 1e-9))
    return kept * np.log((target + smoothing) / (raw * (target.sum() / max(raw.sum(), 1)) + smoothing))


def _weights(broadcast):
    """Log importance weights of (row, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHash.shared(), broadcast.value
        for batch in batches:
            out = [round(float(table[features(text, hashes, len(table))].sum()), 9) for text in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], ["row", "weight"])

    return run


def fit_cut(bins: list[tuple[int, bool, int]], clean_cost: float = CLEAN_COST) -> float:
    """The cut with the least cost, given (step of the weight, wanted, rows)."""
    steps = sorted({b for b, _, _ in bins})
    at = {b: k for k, b in enumerate(steps)}
    good, bad = np.zeros(len(steps)), np.zeros(len(steps))
    for b, wanted, n in bins:
        (good if wanted else bad)[at[b]] += n
    cost = clean_cost * np.concatenate(([0], np.cumsum(good))) / max(good.sum(), 1) - np.concatenate(([0], np.cumsum(bad))) / max(bad.sum(), 1)
    k = int(np.argmin(cost))
    return float("-inf") if k == 0 else float("inf") if k == len(steps) else steps[k] / STEPS


def kth_largest(keys: DataFrame, k: int, bins: int = 1024) -> float:
    """Value of the k-th largest ``key``, by histograms over ever narrower ranges: no sort, and no task holds more than bins rows."""
    lo, hi = keys.agg(F.min("key"), F.max("key")).first()
    above = 0
    while hi > lo:
        width = (hi - lo) / bins
        if lo + width == lo:
            break
        bin_ = F.least(F.floor((F.col("key") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1))
        found = keys.where((F.col("key") >= lo) & (F.col("key") <= hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for _, n, bin_lo, bin_hi in sorted(found, reverse=True):
            if above + n >= k:
                if (bin_lo, bin_hi) == (lo, hi) and len(found) == 1:
                    return lo
                lo, hi = bin_lo, bin_hi
                break
            above += n
    return lo


def gumbel(key: Column, seed: Column | int) -> Column:
    """A standard Gumbel variate for each key and seed."""
    seed = F.lit(seed) if isinstance(seed, int) else seed
    u = (F.pmod(F.xxhash64(key, seed), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def score(rows: DataFrame, labels: DataFrame, share: float | None, buckets: int, smoothing: float, shrinkage: float, clean_cost: float, seed: int, label_rows: int) -> DataFrame:
    """row, weight, key and kept of ``rows`` (row with a doc_id, text), given ``labels`` (doc_id, wanted boolean)."""
    docs = rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text")
    named = require_columns(labels, "doc_id", "wanted").where("doc_id is not null and wanted is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("wanted").alias("wanted"))
    part = min(1.0, label_rows / max(named.count(), 1))
    named = named.where(F.pmod(F.xxhash64("doc_id", F.lit("label")), F.lit(1 << 20)) < round(part * (1 << 20)))
    # label_rows bounds what is broadcast, so texts need no shuffle
    labelled = materialize(docs.join(F.broadcast(named), "doc_id").withColumn("held_out", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) == 0), "labelled")
    seen, held = labelled.where("not held_out"), labelled.where("held_out")
    table = ratios(bucket_counts(seen.where("wanted"), buckets), bucket_counts(seen, buckets), bucket_counts(docs, buckets), smoothing, shrinkage)
    weigh = _weights(docs.sparkSession.sparkContext.broadcast(table))  # ``buckets`` numbers, whatever the corpus

    def weighed(frame: DataFrame) -> DataFrame:
        first = frame.schema[0]
        return frame.mapInArrow(weigh, T.StructType([T.StructField("row", first.dataType, first.nullable), T.StructField("weight", T.DoubleType())]))

    step = F.floor(F.greatest(F.least(F.col("weight"), F.lit(REACH)), F.lit(-REACH)) * STEPS)
    bins = weighed(held.select("wanted", "text")).groupBy(step.alias("step"), F.col("row").alias("wanted")).count().collect()  # at most 4 * STEPS * REACH rows
    cut = fit_cut([tuple(b) for b in bins], clean_cost) if {True, False} <= {b.wanted for b in bins} else float("-inf")
    keys = materialize(weighed(rows).withColumn("key", F.round(F.col("weight") + gumbel(F.col("row.doc_id").cast("long"), seed), 9)), "keys")
    k = keys.where(F.col("weight") >= cut).count() if share is None else round(share * keys.count())
    return keys.withColumn("kept", F.col("key") >= kth_largest(keys, k) if k else F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, smoothing: float = SMOOTHING, shrinkage: float = SHRINKAGE, clean_cost: float = CLEAN_COST, seed: int = SEED, label_rows: int = LABEL_ROWS) -> DataFrame:
    """doc_id, weight, key and kept of ``docs`` (doc_id, text), given ``labels`` (doc_id, wanted boolean)."""
    rows = require_columns(docs, "doc_id", "text").select(F.struct(F.col("doc_id").cast("long").alias("doc_id")).alias("row"), "text")
    return score(rows, labels, share, buckets, smoothing, shrinkage, clean_cost, seed, label_rows).select("row.doc_id", "weight", "key", "kept")


def keep(docs: DataFrame, labels: DataFrame, share: float | None = None, buckets: int = BUCKETS, smoothing: float = SMOOTHING, shrinkage: float = SHRINKAGE, clean_cost: float = CLEAN_COST, seed: int = SEED, label_rows: int = LABEL_ROWS) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns: whole rows travel with their weights, so nothing is joined."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"))
    kept = score(rows, labels, share, buckets, smoothing, shrinkage, clean_cost, seed, label_rows).where("kept")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
