"""Rendezvous (highest random weight) sharding of stable record keys over weighted shards.

A key's score on shard s of weight w is -ln(u) / w, with u uniform from a hash of key and shard; the least score wins.  The
choice depends on the key and the list of shards alone, so a further shard only takes records into itself, on average its
share, and no record moves between the others.

Slots number a shard's records without gaps from 0.  Records are numbered inside (shard, bucket), where buckets are hash
ranges of key and order that hold a bounded number of records on average, and a bucket's offset is the sum of its predecessors'
counts; so no task ever holds a shard.

Defined cases: a null key is a key of its own; a null or empty text has no bytes; rows that repeat a key share its shard and
get slots of their own; other columns stay, but ``assign`` refuses records that have a shard or slot already.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.llm.common import require_columns

ROWS_PER_BUCKET = 100_000


def _uniform(key: Column, shard: int) -> Column:
    """In (0, 1): 52 bits of an md5, which other engines compute alike; a null key is not the text "null"."""
    name = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    digest = F.md5(F.concat(name, F.lit(f"/{shard}")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """Number of the winning shard; for equal scores the lower number."""
    if not weights or min(weights) <= 0:
        raise ValueError("every shard needs a weight above 0")
    equal = len({float(w) for w in weights}) == 1
    scores = [F.struct((-_uniform(key, s) if equal else -F.log(_uniform(key, s)) / float(w)).alias("score"), F.lit(s).alias("shard")) for s, w in enumerate(weights)]
    return (F.least(*scores) if len(scores) > 1 else scores[0])["shard"]


def assign(records: DataFrame, key: str, weights: Sequence[float], order: Sequence[str] = (), rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``records`` with shard and slot; ``order`` breaks ties between rows of one key, and spreads them over buckets."""
    if {"shard", "slot"} & set(records.columns):
        raise ValueError("records already have a column shard or slot: rename it")
    buckets = max(64, -(-records.count() // rows_per_bucket))
    # whole rows travel in one column, so no name of theirs meets those used here
    rows = records.select(F.struct(*[F.col(f"`{c}`") for c in records.columns]).alias("row"))
    of = lambda c: F.col("row").getField(c)
    placed = rows.withColumn("shard", shard_of(of(key), weights)).withColumn("bucket", F.pmod(F.xxhash64(of(key), *map(of, order)), F.lit(buckets)))
    counts = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(W.partitionBy("shard", "bucket").orderBy(of(key).asc_nulls_first(), *map(of, order))) - 1
    slotted = placed.withColumn("inside", inside).join(offsets, ["shard", "bucket"])
    return slotted.select(*[of(c).alias(c) for c in records.columns], "shard", (F.col("offset") + F.col("inside")).alias("slot"))


def shard_documents(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of ``docs`` (doc_id, text) over equal shards."""
    docs = require_columns(docs, "doc_id", "text")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    out = assign(rows, "doc_id", [1.0] * shards, ("text_crc32", "size"))
    return out.withColumn("grown_shard", shard_of(F.col("doc_id"), [1.0] * (shards + 1))).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
