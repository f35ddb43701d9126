"""Evaluation and profiling of data sets: training cards, evaluation reports, calibration, centroids and distances."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text

PASS, FAIL, SHORT = 0.88, 0.70, 20


def share(condition: Column, digits: int = 1) -> Column:
    """Percentage of rows that meet a condition."""
    return F.round(100 * F.count_if(condition) / F.count("*"), digits)


def at_share(scores: DataFrame, value: str, q: float) -> Column:
    """Aggregate over counts by value (``upto`` and ``n``): the value at place floor(n * q) of the sorted rows."""
    return F.min(F.when(F.col("upto") > F.floor(F.col("n") * q), F.col(value)))


def _counted(rows: DataFrame, value: str) -> DataFrame:
    """Counts by value with their running sum and total: a few thousand rows of scores with three digits."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("k"))
    return counts.withColumn("upto", F.sum("k").over(W.orderBy(value))).withColumn("n", F.sum("k").over(W.partitionBy()))


def score_report(rows: DataFrame, score: str) -> DataFrame:
    """One row: n, mean (six digits), median, quartiles by index, pass and fail rates (percent) of scores that are rounded to three digits."""
    rounded = rows.select(F.round(score, 3).alias("v"))
    counts = _counted(rounded, "v")
    n, v, k = F.max("n"), F.col("v"), F.col("k")
    middle = (F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) / 2), v)) + at_share(counts, "v", 0.5)) / 2
    rate = lambda c: F.round(100 * F.sum(F.when(c, k).otherwise(0)) / n, 1)
    return counts.agg(n.alias("n"), F.round(F.sum(v * k) / n, 6).alias("mean"), F.round(middle, 4).alias("median"), at_share(counts, "v", 0.25).alias("p25"), at_share(counts, "v", 0.75).alias("p75"), rate(v >= PASS).alias("pass_rate"), rate(v < FAIL).alias("fail_rate"))


def judged(answers: DataFrame) -> DataFrame:
    """``answers`` (id, question, answer, judge_score): without a question left out, an answer under 20 characters scores 0."""
    asked = answers.where(F.trim(F.coalesce("question", F.lit(""))) != "")
    return asked.withColumn("score", F.when(F.length(F.trim(F.coalesce("answer", F.lit("")))) < SHORT, 0.0).otherwise(F.col("judge_score")))


def evaluation_report(answers: DataFrame, refusal: str) -> DataFrame:
    """One row: the score report of judged answers with their share of refusals and mean length."""
    rows = judged(answers)
    other = rows.agg(share(F.contains("answer", F.lit(refusal))).alias("refusal_rate"), F.round(F.avg(F.length("answer")), 0).alias("mean_length"))
    return score_report(rows, "score").crossJoin(other)  # one row each


def examples(answers: DataFrame, most: int = 5) -> DataFrame:
    """The first few judged answers (by id) that are weak or strong."""
    rows = judged(answers).where("score < 0.7 or score > 0.9")
    return rows.orderBy("id").limit(most).select("id", F.substring("question", 1, 200).alias("question"), F.substring("answer", 1, 300).alias("answer"), F.round("score", 3).alias("score"))


def training_card(conversations: DataFrame, score: str, group: str) -> DataFrame:
    """(section, name, value) rows of a training card: volume, multi-turn share, first answers' mean length, scores, shares by group.

    ``conversations`` has messages, a score and a group.
    """
    of = lambda role: F.filter("messages", lambda x: x["role"] == role)
    first = F.get(of("assistant"), F.lit(0))["content"]
    totals = conversations.agg(F.count("*").cast("double").alias("n_records"), F.count_if(F.size(of("user")) > 1).cast("double").alias("multi_turn_count"), share(F.size(of("user")) > 1).alias("multi_turn_pct"), F.round(F.avg(F.length(first)), 0).alias("avg_response_len"))
    scored = score_report(conversations.where(F.col(score).isNotNull()), score)
    long = lambda frame, section: frame.select(F.explode(F.array(*[F.struct(F.lit(section).alias("section"), F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in frame.columns])).alias("x")).select("x.*")
    groups = conversations.groupBy(F.coalesce(group, F.lit("unknown")).alias("name")).agg(F.count("*").cast("double").alias("value"))
    return long(totals, "dataset").unionByName(long(scored, "quality")).unionByName(groups.select(F.lit(group).alias("section"), "name", "value"))


def calibration(chunks: DataFrame, key: str, body: str, heading: Column) -> DataFrame:
    """One row: mean length, richness and density of a sample of chunks, share of headings, and the thresholds that follow.

    The reference samples the first 30 chunks for richness and the first 50 for density; the order here is that of ``key``.
    """
    first = chunks.orderBy(key).limit(50).select(key, F.substring(body, 1, 10_000).alias("cut"), F.col(body).alias("body"))
    ranked = first.withColumn("place", F.row_number().over(W.orderBy(key)))  # 50 rows
    richness = ranked.where("place <= 30").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "cut"))), lambda x: x["cut"]), " ").alias("s")).select(text.richness(F.col("s")).alias("richness"))
    density = ranked.agg(F.avg(text.density(F.col("body"))).alias("density"))
    sizes = chunks.agg(F.avg(F.when(F.length(body) > 0, F.length(body))).alias("length"), F.avg(heading.cast("int")).alias("headings"), F.count("*").alias("n"))
    c = F.col
    steps = 0.82 + F.when(c("length") < 250, -0.04).when(c("length") > 900, 0.02).otherwise(0.0) + F.when(c("richness") > 0.65, 0.02).when(c("richness") < 0.35, -0.02).otherwise(0.0) + F.when(c("density") > 0.6, 0.02).when(c("density") < 0.2, -0.03).otherwise(0.0)
    out = sizes.crossJoin(richness).crossJoin(density)  # one row each
    return out.select("n", F.round("length", 1).alias("length"), F.round("richness", 3).alias("richness"), F.round("density", 3).alias("density"), F.round("headings", 2).alias("headings"), F.round(F.greatest(F.lit(0.72), F.least(steps, F.lit(0.92))), 2).alias("threshold"), F.when(c("length") < 300, 2).otherwise(3).alias("max_turns"), F.when(c("density") < 0.15, 0.07).otherwise(0.10).alias("adversarial"))


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, pos, value): the mean vector of each group, divided by its norm (left as it is where that is next to nothing)."""
    means = rows.select(group, F.posexplode(vector).alias("pos", "x")).groupBy(group, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norm = F.sqrt(F.sum(F.col("mean") * F.col("mean")).over(W.partitionBy(group)))
    return means.withColumn("norm", norm).select(group, F.col("pos").cast("long").alias("pos"), F.when(F.col("norm") > 1e-9, F.col("mean") / F.col("norm")).otherwise(F.col("mean")).alias("value"))


def mean_distance(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, distance): the mean of 1 - cosine over all pairs of a group, from the sum of its unit vectors: no pair is formed.

    The squared norm of the sum is n plus twice the sum of all pairs' cosines.  Zero vectors have a cosine of 0 with all.
    """
    square = F.aggregate(F.transform(vector, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    unit = F.transform(vector, lambda x: F.when(square > 0, x.cast("double") / F.sqrt(square)).otherwise(F.lit(0.0)))
    sums = rows.select(group, F.posexplode(unit).alias("pos", "x")).groupBy(group, "pos").agg(F.sum("x").alias("s"))
    total = sums.groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("t"))
    sizes = rows.groupBy(group).agg(F.count("*").alias("n"), F.count_if(square > 0).alias("real"))
    pairs = F.col("n") * (F.col("n") - 1) / 2
    return sizes.join(total, group).where("n > 1").select(group, "n", F.round(1 - (F.col("t") - F.col("real")) / 2 / pairs, 6).alias("distance"))


def source_authority(sources: DataFrame, group: str, score: Column) -> DataFrame:
    """(group, authority): the mean tier score, 0.3 where a tier is unknown."""
    return sources.groupBy(group).agg(F.round(F.avg(F.coalesce(score, F.lit(0.3))), 6).alias("authority"))
