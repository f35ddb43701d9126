"""The data set's writer: what is accepted, in which order, with which marks, and its files.

Order is that of a key.  A refusal is written only while refusals are less than a share of what is written; this depends on all
earlier decisions, but has a closed form: with g ordinary records before the j-th refusal, the number of refusals accepted
is the least of B(k) + j - k over k <= j, where B(k) = ceil(cap / (1 - cap) * g(k)), and 1 at least if the very first record is a
refusal.  So running sums and minima by ranges suffice, and no task sees all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import questions, scores, watermarks
from millrace.operators import dataset

RANGE = 100_000


def accepted(rows: DataFrame, key: str, refusal: str, cap: float, size: int = RANGE) -> DataFrame:
    """Rows with ``written``: all but the refusals beyond the cap, in the order of ``key`` (a number without repeats)."""
    c = F.col
    placed = dataset.indexed(rows, key).drop("total").withColumn("part", F.floor(c("idx") / size))
    inside = W.partitionBy("part").orderBy("idx").rowsBetween(W.unboundedPreceding, 0)
    flag = c(refusal).cast("int")
    placed = placed.withColumn("bad_in", F.sum(flag).over(inside))
    # one row for each range
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = placed.groupBy("part").agg(F.sum(flag).alias("bad"), F.max(F.when(c("idx") == 0, flag)).alias("first"))
    parts = parts.select("part", F.coalesce(F.sum("bad").over(before), F.lit(0)).alias("bad_before"), F.max("first").over(W.partitionBy()).alias("first"))
    placed = placed.join(F.broadcast(parts), "part").withColumn("j", c("bad_before") + c("bad_in"))  # refusals up to and with the row
    ordinary = c("idx") + 1 - c("j")
    bound = F.greatest(F.ceil(F.round(cap / (1 - cap) * ordinary, 9)), c("first")) - c("j")
    placed = placed.withColumn("slack", F.when(c(refusal), bound)).withColumn("least_in", F.min("slack").over(inside))
    lows = placed.groupBy("part").agg(F.min("slack").alias("low"))
    lows = lows.select("part", F.min("low").over(before).alias("low_before"))
    placed = placed.join(F.broadcast(lows), "part")
    taken = c("j") + F.least(F.lit(0), F.coalesce(F.least("least_in", "low_before"), F.lit(0)))  # refusals accepted so far
    placed = placed.withColumn("taken", taken).withColumn("was", F.lag("taken").over(W.partitionBy("part").orderBy("idx")))
    # at a range's first row: what was taken before it
    edge = c("bad_before") + F.least(F.lit(0), F.coalesce("low_before", F.lit(0)))
    written = ~c(refusal) | (c("taken") > F.coalesce("was", edge))
    return placed.select(*rows.columns, written.alias("written"))


def records(conversations: DataFrame, key: str, phrase: str, cap: float, interval: int, client: str, batch: str, secret: str) -> DataFrame:
    """(key, idx, messages, hash) of the written conversations (key, messages): valid ones, refusals capped, numbered from 0; every
    ``interval``-th record but the first bears a mark in its last answer, and its hash."""
    valid = conversations.where(dataset.is_valid(F.col("messages"))).withColumn("refusal", dataset.mostly_refusals(F.col("messages"), phrase))
    kept = dataset.indexed(accepted(valid, key, "refusal", cap).where("written").drop("written", "refusal"), key).drop("total")
    due = (F.col("idx") > 0) & (F.col("idx") % interval == 0)
    last = F.size("messages") - F.array_position(F.transform(F.reverse("messages"), lambda m: m["role"] == "assistant"), True)
    marked = F.transform("messages", lambda m, i: F.when(i == last, F.struct(m["role"].alias("role"), watermarks.inject(m["content"], F.floor(F.col("idx") / interval)).alias("content"))).otherwise(m))
    hashed = F.when(due, scores.watermark(F.lit(client), F.lit(batch), F.col("idx"), secret))
    return kept.withColumn("messages", F.when(due, marked).otherwise(F.col("messages"))).withColumn("hash", hashed)


def lines(rows: DataFrame, metadata: list[str] = ()) -> DataFrame:
    """One JSON line for each record: its messages, and metadata where there are any."""
    extra = [F.struct(*[F.col(c) for c in metadata]).alias("metadata")] if metadata else []
    return rows.select(F.to_json(F.struct("messages", *extra)).alias("value"))


def chat_export(rows: DataFrame) -> DataFrame:
    """Lines of training chats; records without messages are left out."""
    return rows.where(F.size("messages") > 0).select(F.to_json(F.struct(F.col("messages").alias("conversations"))).alias("value"))


def write_dataset(rows: DataFrame, path: str, card: DataFrame | None = None, metadata: list[str] = ()) -> None:
    """The data set as JSON lines and as Parquet, in the order of idx over files, with its card beside it."""
    ordered = rows.repartitionByRange("idx").sortWithinPartitions("idx")
    ordered.write.mode("overwrite").parquet(f"{path}/parquet")
    lines(ordered, metadata).write.mode("overwrite").text(f"{path}/jsonl")
    if card is not None:
        card.select(F.to_json(F.struct(*card.columns)).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/card")  # a card is one row


def resume_counts(jsonl: DataFrame, phrase: str) -> DataFrame:
    """One row: records (lines that are not blank) and refusals (lines with the phrase) of files written before."""
    return jsonl.where(F.trim("value") != "").agg(F.count("*").alias("records"), F.count_if(F.contains("value", F.lit(phrase))).alias("refusals"))


def first_said(messages: Column, role: str) -> Column:
    return F.coalesce(F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"], F.lit(""))


def write_output(rows: DataFrame, key: str, duplicates, phrase: str, cap: float, interval: int, client: str, batch: str, secret: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The end of a run: (samples, preference pairs, chunk states) of rows (key, messages, rejected).

    Near-duplicates of an earlier first question (as ``duplicates`` (key, question) -> (key, kept) finds them) are left out before
    refusals are capped; every chunk is ready afterwards, written or not.
    """
    asked = rows.withColumn("question", first_said(F.col("messages"), "user")).withColumn("answer", first_said(F.col("messages"), "assistant"))  # without marks
    kept = duplicates(asked.where("question <> ''").select(key, "question")).where("kept").select(key)
    fresh = asked.where("question = ''").unionByName(asked.join(kept, key, "left_semi"))
    written = records(fresh, key, phrase, cap, interval, client, batch, secret)
    kind = F.when(F.col("question") == "", "factual").otherwise(questions.question_type(F.col("question")))
    difficulty = F.when(F.col("question") == "", "medium").otherwise(questions.difficulty(F.col("question")))
    samples = written.select(key, "idx", "question", "answer", kind.alias("question_type"), difficulty.alias("difficulty"), "messages", "rejected", "hash")
    pairs = samples.where("rejected is not null").select(key, F.col("question").alias("prompt"), F.col("answer").alias("chosen"), "rejected")
    states = rows.select(key).join(samples.select(key, "idx"), key, "left").select(key, F.lit("ready").alias("status"), F.coalesce("idx", F.lit(-1)).alias("record_index"))
    return samples, dataset.preference_pairs(pairs), states
