"""Quality rules: a threshold table compiled into one Spark projection, evaluated without user functions.

A rule names a measure and the range in which a document stays.  Measures are ratios of words, symbols, stop words and lines;
``compile_rules`` turns the table into one boolean column and one column that lists the rules a document breaks.

Repeated words.  Every position's 3-word window is hashed to 64 bits; (hash, position) pairs are sorted inside the row; runs
of equal hashes give the positions of repeated windows; these positions, sorted, cover min(3, distance to the next) words
each.  So the work is n log n per text and nothing is shuffled.

Defined cases: null and empty texts have no words and fail the base rule; rows are independent, so repeated rows and null ids
stay as they are; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import let, require_columns

#: White space that separates words.
SPACES = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the corpus's languages (en, de, fr, es).
STOP_WORDS = (
    "a an and are as at be by for from had has have he her his in is it not of on or she that the they this to was were will with you "
    "aber als an auch auf aus bei das dem den der des die ein eine einer er es für hat ich im in ist mit nach nicht oder sich sie sind und von vor war wie wird zu zum "
    "au aux avec ce cette dans de des du elle en est et il ils je la le les leur mais ne nous on ont ou par pas pour qui que sa se ses son sur un une vous "
    "al como con cuando de del donde el ella en entre es esta este la las lo los más no o para pero por que se sin sobre su sus un una y ya"
).split()


@dataclass(frozen=True)
class Rule:
    name: str
    measure: str
    least: float | None = None
    most: float | None = None


#: Production thresholds.  The base rule of the contract stands apart: n_words and n_repeat_words.
RULES = (
    Rule("word_length", "mean_word_length", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.30),
    Rule("stop_words", "stop_word_ratio", 0.01, None),
    Rule("duplicate_lines", "duplicate_line_ratio", None, 0.50),
    Rule("capitals", "capital_ratio", None, 0.60),
    Rule("one_word", "distinct_word_ratio", 0.05, None),
)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACES + "+"), "")


def repeated_words(words: Column, window: int = 3) -> Column:
    """Number of words in ``window``-word windows found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def runs(p: Column) -> Column:
            again = F.filter(p, lambda x, k: (x["h"] == F.get(p, k - 1)["h"]) | (x["h"] == F.get(p, k + 1)["h"]))
            at = F.sort_array(F.transform(again, lambda x: x["i"]))
            return let(at, lambda q: F.aggregate(F.transform(q, lambda x, k: F.least(F.lit(window), F.coalesce(F.get(q, k + 1) - x, F.lit(window)))), F.lit(0), lambda s, x: s + x))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, runs))

    grams = let(words, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - (window - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, window)])))
    return let(grams, covered).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and all measures."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = require_columns(docs, "doc_id", "text").select(
        "doc_id",
        F.length(text).cast("long").alias("n_chars"),
        words_of(text).alias("words"),
        F.size(lines).cast("long").alias("n_lines"),
        F.size(F.array_distinct(lines)).cast("long").alias("n_distinct_lines"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]", ""))).cast("long").alias("n_capitals"),
    )
    counted = base.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.col("n_lines") - F.col("n_distinct_lines")).alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
        F.size(F.filter("words", lambda w: F.lower(w).isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct_words"),
        "n_capitals",
        "n_lines",
    )
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counted.select(
        "*",
        (F.col("word_chars") / words).alias("mean_word_length"),
        (F.col("n_symbols") / words).alias("symbol_ratio"),
        (F.col("n_stop_words") / words).alias("stop_word_ratio"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("duplicate_line_ratio"),
        (F.col("n_capitals") / chars).alias("capital_ratio"),
        (F.col("n_distinct_words") / words).alias("distinct_word_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(all hold, names of those that do not)."""

    def breaks(rule: Rule) -> Column:
        tests = [F.col(rule.measure) < rule.least] * (rule.least is not None) + [F.col(rule.measure) > rule.most] * (rule.most is not None)
        out = tests[0] if tests else F.lit(False)
        for test in tests[1:]:
            out = out | test
        return out

    broken = [breaks(r) for r in rules]
    fails = F.lit(False)
    for b in broken:
        fails = fails | b
    return ~fails, F.array_compact(F.array(*[F.when(b, r.name) for b, r in zip(broken, rules, strict=True)])) if rules else F.array().cast("array<string>")


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """The base counts, base_failed, kept and the names of broken rules for each row of ``docs`` (doc_id, text)."""
    holds, broken = compile_rules(rules)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return measures(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & holds).alias("kept"), F.array_join(broken, ",").alias("broken"))
