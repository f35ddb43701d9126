"""Nodes of the generation loop as column updates over rows in progress; models are passed in as functions of columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import is_refusal, let

Model = Callable[[Column], Column]


def is_adversarial(keys: list[Column], ratio: float) -> Column:
    """A share ``ratio`` of rows, decided by their keys: a task that runs again decides alike."""
    return F.pmod(F.xxhash64(*keys), F.lit(1_000_000)) < int(ratio * 1_000_000)


def simulate_question(rows: DataFrame, keys: list[str], prompt: Column, ask: Model, fallback: str, hostile_fallback: str, ratio: float = 0.1) -> DataFrame:
    """Adds adversarial and question; where the model gives none, the branch's fixed question."""
    rows = rows.withColumn("adversarial", is_adversarial([F.col(k) for k in keys], ratio))
    return rows.withColumn("question", F.coalesce(F.nullif(F.trim(ask(prompt)), F.lit("")), F.when(F.col("adversarial"), hostile_fallback).otherwise(fallback)))


def bigram_jaccard(a: Column, b: Column) -> Column:
    """Similarity of the word pairs of two texts; a text of fewer than two words is one pair, itself."""

    def bigrams(x: Column) -> Column:
        w = F.filter(F.split(F.lower(x), r"\s+"), lambda t: t != "")
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(w, i, 2)))
        return F.when(F.size(w) < 2, F.array(F.lower(x))).otherwise(F.array_distinct(pairs))

    return let(bigrams(a), lambda x: let(bigrams(b), lambda y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))))


def repeats_earlier(question: Column, earlier: Column, threshold: float = 0.75) -> Column:
    """Whether a follow-up says again what an earlier question said."""
    return F.exists(F.coalesce(earlier, F.array().cast("array<string>")), lambda e: bigram_jaccard(question, e) >= threshold)


def follow_up(rows: DataFrame, prompt: Column, ask: Model, earlier: Column, fallbacks: list[str], pick: Column, threshold: float = 0.75) -> DataFrame:
    """Adds question: the model's, or a fixed one (number ``pick``) where it gives none or repeats an earlier question; never adversarial."""
    fixed = F.get(F.array(*map(F.lit, fallbacks)), F.pmod(pick, F.lit(len(fallbacks))).cast("int"))
    said = F.nullif(F.trim(ask(prompt)), F.lit(""))
    rows = rows.withColumn("question", said)
    good = F.col("question").isNotNull() & ~repeats_earlier(F.col("question"), earlier, threshold)
    return rows.withColumn("question", F.when(good, F.col("question")).otherwise(fixed)).withColumn("adversarial", F.lit(False))


def answer_context(base: Column, contexts: Column, tokens: int, most: int = 6) -> Column:
    """The base chunk and the first contexts that differ from it, cut to four characters a token (500 at least)."""
    parts = F.array_distinct(F.concat(F.array(base), F.slice(contexts, 1, most)))
    return F.substring(F.concat_ws("\n\n", parts), 1, max(tokens * 4, 500))


def generate_answer(rows: DataFrame, base: str, contexts: str, answer: Model, refusal: str, tokens: int = 3000) -> DataFrame:
    return rows.withColumn("answer", F.coalesce(answer(answer_context(F.col(base), F.col(contexts), tokens)), F.lit(refusal)))


def append_turn(rows: DataFrame) -> DataFrame:
    """History grows by question and answer; the turn's own columns start anew."""
    say = lambda role, c: F.struct(F.lit(role).alias("role"), F.col(c).alias("content"))
    rows = rows.withColumn("history", F.concat("history", F.array(say("user", "question"), say("assistant", "answer")))).withColumn("turn", F.col("turn") + 1)
    for name, kind in (("question", "string"), ("answer", "string"), ("score", "double"), ("critique", "string")):
        rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.withColumn("retries", F.lit(0))


def route_after_append(turn: Column, max_turns: int) -> Column:
    return F.when(turn < max_turns, "follow_up").otherwise("write")


def increment_retry(rows: DataFrame) -> DataFrame:
    """The answer at hand becomes the rejected one."""
    return rows.withColumn("retries", F.col("retries") + 1).withColumn("rejected", F.col("answer"))


def skips_revision(on: bool, adversarial: Column, answer: Column, prior: Column, skip_above: float = 0.92) -> Column:
    return F.lit(not on) | adversarial | (F.length(F.trim(answer)) < 30) | F.coalesce(prior >= skip_above, F.lit(False))


def is_revision(revised: Column, original: Column) -> Column:
    """20 characters or more, and different beyond white space."""
    bare = lambda c: F.regexp_replace(c, r"\s+", "")
    return F.coalesce((F.length(F.trim(revised)) >= 20) & (bare(revised) != bare(original)), F.lit(False))


def constitutional_revision(rows: DataFrame, critique: Model, revise: Callable[[Column, Column], Column], on: bool = True) -> DataFrame:
    """Answers that need no skip are criticised and revised; the first rejected answer stays."""
    skip = skips_revision(on, F.col("adversarial"), F.col("answer"), F.col("score"))
    rows = rows.withColumn("_revised", F.when(~skip, revise(F.col("answer"), critique(F.col("answer")))))
    changed = is_revision(F.col("_revised"), F.col("answer"))
    rows = rows.withColumn("_changed", changed)
    rows = rows.withColumn("rejected", F.when(F.col("_changed"), F.coalesce("rejected", "answer")).otherwise(F.col("rejected")))
    return rows.withColumn("answer", F.when(F.col("_changed"), F.col("_revised")).otherwise(F.col("answer"))).drop("_revised", "_changed")


def judge_fast_path(adversarial: Column, answer: Column) -> Column:
    """Score without a model: 1 or 0 for adversarial rows, 0 for short answers; null where a model has to judge."""
    return F.when(adversarial, is_refusal(answer).cast("double")).when(F.length(F.trim(answer)) < 30, 0.0)


def judge_cascade(score: Column, confidence: Column, second: Column, second_confidence: Column, threshold: float = 0.7) -> Column:
    """The second model's score where the first is unsure and the second at least as sure; failure is 0."""
    return F.coalesce(F.when((confidence < threshold) & (second_confidence >= confidence), second).otherwise(score), F.lit(0.0))


def tag(text: Column, name: str) -> Column:
    """What stands in the first <name>…</name>, whatever the case."""
    return F.regexp_extract(text, rf"(?is)<{name}>\s*(.*?)\s*</{name}>", 1)


def bullets(text: Column, name: str) -> Column:
    """The lines that begin with a hyphen inside a tag, without it."""
    return F.regexp_extract_all(tag(text, name), F.lit("- (.+)"), F.lit(1))


def critique_pair(raw: Column) -> Column:
    """improved and degraded answers; null unless both are there."""
    good, bad = tag(raw, "improved"), tag(raw, "degraded")
    return F.when((good != "") & (bad != ""), F.struct(good.alias("improved"), bad.alias("degraded")))


def critique_rate(seen: Column, critiqued: Column, base: float, most: float = 0.80) -> Column:
    return F.when(seen < 10, F.lit(base)).otherwise(F.least(base * (1 + 2 * critiqued / seen), F.lit(most)))


def moving_average(values: Column, alpha: float = 0.3) -> Column:
    """Exponential moving average of an ordered array; null of an empty one."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(alpha * x + (1 - alpha) * acc))
