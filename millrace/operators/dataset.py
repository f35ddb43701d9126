"""Dataset operators: message arrays, validation, preference pairs, splits, distributions and the quality gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROLES = ("system", "user", "assistant")


def messages(turns: DataFrame, key: str, order: str, role: str, content: str) -> DataFrame:
    """One row for each key with its messages in order."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(content).alias("content"))))
    return turns.groupBy(key).agg(packed.alias("m")).select(key, F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def is_valid(m: Column) -> Column:
    return (F.size(m) > 0) & F.forall(m, lambda x: F.coalesce(x["role"].isin(*ROLES) & (F.trim(x["content"]) != ""), F.lit(False)))


def mostly_refusals(m: Column, phrase: str) -> Column:
    """More than half of the assistant's turns hold the phrase."""
    own = F.filter(m, lambda x: x["role"] == "assistant")
    return (F.size(own) > 0) & (F.size(F.filter(own, lambda x: F.contains(x["content"], F.lit(phrase)))) > 0.5 * F.size(own))


def preference_pairs(rows: DataFrame) -> DataFrame:
    """Rows (.., chosen, rejected) where both sides say something different."""
    a, b = F.trim("chosen"), F.trim("rejected")
    return rows.where((a != "") & (b != "") & (a != b))


def kto(rows: DataFrame) -> DataFrame:
    """Two labelled rows for each pair."""
    both = F.array(F.struct(F.col("chosen").alias("completion"), F.lit(True).alias("label")), F.struct(F.col("rejected").alias("completion"), F.lit(False).alias("label")))
    rest = [c for c in rows.columns if c not in ("chosen", "rejected")]
    return rows.select(*rest, F.explode(both).alias("x")).select(*rest, "x.completion", "x.label")


def indexed(rows: DataFrame, key: str, parts: int = 200) -> DataFrame:
    """Rows with idx, a gapless index from 0, and the total number of rows, in the order of ``key`` (a number, null first), without one
    task holding all rows.

    A row's range follows from its key alone, by fixed cuts near the quantiles; so a task that runs again numbers alike.
    """
    cuts = sorted(set(rows.stat.approxQuantile(key, [k / parts for k in range(1, parts)], 0.002)))
    ranged = F.coalesce(F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(key))), F.lit(0)) if cuts else F.lit(0)
    spread = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.greatest(ranged, F.lit(0)).alias("part"))
    counts = spread.groupBy("part").agg(F.count("*").alias("k"))
    # one row for each range of the key
    before = counts.select("part", F.coalesce(F.sum("k").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("k").over(W.partitionBy()).alias("total"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("row").getField(key))) - 1
    numbered = spread.withColumn("inside", inside).join(F.broadcast(before), "part")
    return numbered.select(*[F.col("row").getField(c).alias(c) for c in rows.columns], "total", (F.col("before") + F.col("inside")).alias("idx"))


def split(rows: DataFrame, key: str, modulo: int, validation: float) -> DataFrame:
    """idx, holdout (every modulo-th) and train (all but the last share) by the order of ``key``."""
    return indexed(rows, key).withColumn("holdout", F.lit(True) if modulo == 0 else F.col("idx") % modulo == 0).withColumn("train", F.col("idx") < F.floor(F.col("total") * (1 - validation))).drop("total")


def distribution(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, least, median, p75, p90 and most by index percentile, from counts by value: a group may hold most of the rows."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("k"))
    own = W.partitionBy(*keys)
    run = counts.withColumn("upto", F.sum("k").over(own.orderBy(value))).withColumn("n", F.sum("k").over(own))
    at = lambda q: F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * q), F.col("n") - 1), F.col(value)))
    return run.groupBy(*keys).agg(F.max("n").alias("n"), F.min(value).alias("least"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.max(value).alias("most"))


def full_gate(rows: DataFrame, score: str, group: str, pairs: DataFrame, talks: DataFrame, least: int = 500, least_pairs: int = 50, mean: float = 0.82, share: float = 0.60, multi_turn: float = 0.15, refusals: float = 0.20, advised: int = 1000) -> DataFrame:
    """One row for each of the reference's checks: name, value, passed and blocking; rows that do not block are its warnings.

    ``pairs`` are the preference pairs; ``talks`` has multi_turn and refusal of each conversation.  Without rows only the first check is made.
    """
    parts = rows.groupBy(group).agg(F.count("*").alias("k"), F.sum(score).alias("s"), F.count(score).alias("scored"))
    a = parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.try_divide(F.sum("s"), F.sum("scored")).alias("q"), F.try_divide(F.max("k"), F.sum("k")).alias("share"))
    b = pairs.agg(F.count("*").alias("pairs"))
    rate = lambda name: F.coalesce(F.try_divide(F.count_if(F.col(name)), F.count("*")), F.lit(0.0)).alias(name)
    t = talks.agg(rate("multi_turn"), rate("refusal"))
    c = F.col
    row = lambda name, value, passed, blocking=True: F.struct(F.lit(name).alias("name"), value.cast("double").alias("value"), passed.alias("passed"), F.lit(blocking).alias("blocking"))
    first = row("min_samples", c("n"), c("n") >= least)
    rest = (
        row("min_dpo_pairs", c("pairs"), c("pairs") >= least_pairs),
        row("avg_score", F.round(F.coalesce("q", F.lit(mean)), 6), F.coalesce(c("q") >= mean, F.lit(True))),
        row("max_share", F.round("share", 6), c("share") <= share),
        row("multi_turn_pct", F.round("multi_turn", 6), c("multi_turn") >= multi_turn),
        row("has_scores", c("q").isNotNull(), c("q").isNotNull(), False),
        row("refusal_pct", F.round("refusal", 6), c("refusal") <= refusals, False),
        row("advised_samples", c("n"), c("n") >= advised, False),
    )
    # one row each
    return a.crossJoin(b).crossJoin(t).select(F.explode(F.when(c("n") == 0, F.array(first)).otherwise(F.array(first, *rest))).alias("c")).select("c.*")


def accept_with_refusal_cap(flags: Column, cap: float) -> Column:
    """Decisions over a short ordered array of refusal flags: a refusal is accepted first, or while less than ``cap`` of the accepted are."""
    start = F.struct(F.array().cast("array<boolean>").alias("out"), F.lit(0).alias("n"), F.lit(0).alias("r"))

    def step(acc, x):
        ok = ~x | (acc["n"] == 0) | (acc["r"] < cap * acc["n"])
        return F.struct(F.concat(acc["out"], F.array(ok)).alias("out"), (acc["n"] + ok.cast("int")).alias("n"), (acc["r"] + (ok & x).cast("int")).alias("r"))

    return F.aggregate(flags, start, step, lambda acc: acc["out"])
