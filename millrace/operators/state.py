"""Run, review and subscription state as tables: updates, bounded histories, snapshots and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A run that has come to one of these has ended.
TERMINAL = ("done", "error", "cancelled")
LOG_LINES, FEEDBACKS, COMMENT = 500, 1000, 500

#: A run's snapshot; what is missing in it has these values.
RUN = T.StructType([T.StructField(n, t) for n, t in (("run_id", T.StringType()), ("batch_id", T.StringType()), ("status", T.StringType()), ("progress_pct", T.IntegerType()), ("chunks_total", T.IntegerType()), ("chunks_done", T.IntegerType()), ("records_written", T.IntegerType()), ("dpo_pairs", T.IntegerType()), ("started_at", T.DoubleType()), ("ended_at", T.DoubleType()), ("error", T.StringType()))])
RUN_DEFAULTS = {"status": "starting", "progress_pct": 0, "chunks_total": 0, "chunks_done": 0, "records_written": 0, "dpo_pairs": 0}


def decoded(snapshot: Column, now: float) -> Column:
    """A run's struct from its JSON text, with defaults where a key is missing."""
    read = F.from_json(snapshot, RUN)
    value = lambda f: F.coalesce(read[f.name], F.lit(now if f.name == "started_at" else RUN_DEFAULTS[f.name])) if f.name in RUN_DEFAULTS or f.name == "started_at" else read[f.name]
    return F.struct(*[value(f).alias(f.name) for f in RUN.fields])


def last_rows(rows: DataFrame, key: str | None, order: list, most: int) -> DataFrame:
    """The last ``most`` rows of each key (without one: of all) in this order."""
    if key is None:
        return rows.orderBy(*[F.desc(c) for c in order]).limit(most)
    own = W.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= most).drop("nth")


def run_update(status: Column, new_status: Column, ended: Column, now: Column) -> tuple[Column, Column]:
    """(status, ended_at) after an update: a terminal status sets the end once."""
    return F.coalesce(new_status, status), F.when(new_status.isin(*TERMINAL) & ended.isNull(), now).otherwise(ended)


def feedback(rating: Column, comment: Column) -> tuple[Column, Column]:
    """(rating within 1 and 5, comment cut to its length)."""
    return F.greatest(F.lit(1), F.least(rating, F.lit(5))), F.substring(F.coalesce(comment, F.lit("")), 1, COMMENT)


def auto_reviewed(zone: Column, human: Column, approved: Column) -> Column:
    """Whether a sample is approved after the automatic review: green yes, red no, grey as before; a human's word stands."""
    return F.when(human.isNotNull(), approved).when(zone == "green", True).when(zone == "red", False).otherwise(approved)


def decided(samples: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """Samples (key, answer, approved) after human decisions (key, action, edit): approve, reject, or edit, which approves a new answer."""
    joined = samples.join(decisions.select(key, "action", "edit"), key, "left")
    approved = F.when(F.col("action").isin("approve", "edit"), True).when(F.col("action") == "reject", False).otherwise(F.col("approved"))
    answer = F.when(F.col("action") == "edit", F.coalesce("edit", "answer")).otherwise(F.col("answer"))
    return joined.select(key, answer.alias("answer"), approved.alias("approved"), F.col("action").isNotNull().alias("human_reviewed"))


def listed(rows: DataFrame, key: str, prefix: str, limit: int, order: str) -> DataFrame:
    """The first ``limit`` rows by key whose key begins with the prefix, the latest by ``order`` first."""
    found = rows.where(F.startswith(F.col(key), F.lit(prefix))).orderBy(key).limit(limit)
    return found.withColumn("place", F.row_number().over(W.orderBy(F.desc(order), key)))  # ``limit`` rows


def remaining(at: Column, now: Column) -> Column:
    """Whole seconds until a time, 0 once it has passed."""
    return F.greatest(F.lit(0), F.unix_timestamp(at) - F.unix_timestamp(now))
