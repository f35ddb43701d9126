"""The datacard of a set of training records: volumes, shares, and distributions, as rows (section, name, value).

Everything is counted in one pass over the records and one over counts by value; no list of values is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# What a system message holds, by perspective, in order.
HINTS = {"cfo": "cfo", "prawnik": "radcy prawnego", "audytor": "biegłego rewidenta", "cross_doc": "wielu aktów"}
#: Numbers of records that meet a condition; those with a share are given in percent too.
SHARED = ("refusal", "reasoning", "cross_doc", "adversarial", "multi_turn")


def perspective(system: Column) -> Column:
    """The first perspective whose hint the system message holds; null without a message."""
    low = F.lower(system)
    return F.when(system.isNotNull(), F.coalesce(*[F.when(F.contains(low, F.lit(hint)), name) for name, hint in HINTS.items()], F.lit("unknown")))


def described(records: DataFrame, refusal: str) -> DataFrame:
    """What the card counts of each record (messages, quality_score, question_type, difficulty, perspective, adversarial, watermark_hash)."""
    of = lambda role: F.filter("messages", lambda m: m["role"] == role)
    last = F.try_element_at(of("assistant"), F.lit(-1))["content"]
    return records.select(
        F.size(of("user")).alias("turns"),
        F.length(F.get(of("user"), F.lit(0))["content"]).alias("question"),
        F.length(last).alias("answer"),
        F.coalesce(F.exists(of("assistant"), lambda m: F.contains(m["content"], F.lit(refusal))), F.lit(False)).alias("refusal"),
        F.coalesce(F.contains(last, F.lit("<reasoning>")), F.lit(False)).alias("reasoning"),
        perspective(F.get(of("system"), F.lit(0))["content"]).alias("by_perspective"),
        F.nullif("question_type", F.lit("")).alias("by_question_type"),
        F.nullif("difficulty", F.lit("")).alias("by_difficulty"),
        F.col("quality_score").cast("double").alias("judge_score"),
        F.coalesce(F.col("perspective") == "cross_doc", F.lit(False)).alias("cross_doc"),
        F.coalesce("adversarial", F.lit(False)).alias("adversarial"),
        (F.coalesce("watermark_hash", F.lit("")) != "").alias("watermarked"),
    ).withColumn("multi_turn", F.col("turns") > 1)


def _rows(wide: DataFrame, section: str, names: dict[str, Column]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(k).alias("name"), v.cast("double").alias("value")) for k, v in names.items()])
    return wide.select(F.explode(entries).alias("e")).select(F.lit(section).alias("section"), "e.name", "e.value")


def datacard(records: DataFrame, refusal: str) -> DataFrame:
    """section, name, value; percentages and distributions have one digit after the point.  Without records only the volume has rows."""
    each = described(records, refusal)
    percent = lambda n, total: F.when(total > 0, F.round(100.0 * n / total, 1)).otherwise(0.0)
    sums = each.agg(F.count("*").alias("total"), *[F.count_if(F.col(c)).alias(c) for c in (*SHARED, "watermarked")])
    volume = {"total_records": F.col("total"), "watermarked_count": F.col("watermarked"), "single_turn_count": F.col("total") - F.col("multi_turn")}
    volume |= {f"{c}_count": F.col(c) for c in SHARED} | {f"{c}_pct": percent(F.col(c), F.col("total")) for c in SHARED}
    out = _rows(sums, "volume", volume)

    kinds = F.array(*[F.struct(F.lit(c).alias("section"), F.col(f"by_{c}").alias("name")) for c in ("perspective", "question_type", "difficulty")])
    groups = each.select(F.explode(kinds).alias("k")).where("k.name IS NOT NULL").groupBy("k.section", "k.name").agg(F.count("*").alias("n"))
    groups = groups.crossJoin(F.broadcast(sums.select("total")))  # one row
    pairs = F.array(F.struct(F.lit("").alias("tail"), F.col("n").cast("double").alias("v")), F.struct(F.lit("_pct").alias("tail"), percent(F.col("n"), F.col("total")).alias("v")))
    named = groups.select("section", "name", F.explode(pairs).alias("e"))
    out = out.unionByName(named.select("section", F.concat("name", "e.tail").alias("name"), F.col("e.v").alias("value")))

    measures = ("turns", "judge_score", "question", "answer")
    values = F.array(*[F.struct(F.lit(c).alias("section"), F.col(c).cast("double").alias("v")) for c in measures])
    counts = each.select(F.explode(values).alias("k")).where("k.v IS NOT NULL").groupBy("k.section", "k.v").agg(F.count("*").alias("k"))
    own = W.partitionBy("section")
    run = counts.withColumn("upto", F.sum("k").over(own.orderBy("v"))).withColumn("n", F.sum("k").over(own))
    at = lambda place: F.min(F.when(F.col("upto") > place, F.col("v")))
    n = F.col("n")
    wide = run.groupBy("section").agg(
        F.max("n").alias("count"), F.min("v").alias("min"), (F.sum(F.col("v") * F.col("k")) / F.max("n")).alias("mean"),
        ((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("median"), at(F.floor(n * 0.75)).alias("p75"), at(F.floor(n * 0.9)).alias("p90"), F.max("v").alias("max"),
    )
    entries = F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.col(c).cast("double"), 1).alias("value")) for c in ("count", "min", "mean", "median", "p75", "p90", "max")])
    return out.unionByName(wide.select("section", F.explode(entries).alias("e")).select("section", "e.name", "e.value"))
