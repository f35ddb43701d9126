"""Secret scans: fixed patterns, and a comparison of two character Markov models.

Models.  Labelled samples (token, label 1 for random strings, 0 for ordinary identifiers) train two first-order Markov
models of characters by one aggregation; their log-likelihood ratio is a table over pairs of characters, whose size is bound
by the alphabet.  A candidate token of at least ``min_length`` characters that no pattern covers is a secret where its mean
log-likelihood ratio a character exceeds the threshold.

Everything is a projection of built-in functions.  Positions come from splitting a text at the matches: lengths of the
pieces and of the matches, summed.

Defined cases: null and empty texts have no spans; rows are independent, so repeated rows and null ids stay as they are;
other columns are ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, require_columns

# Fixed patterns: assignment of a named secret, access key, hexadecimal string.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# Runs are matched whole, so a least length in the pattern equals dropping shorter matches afterwards.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: (kind, pattern, group that is measured, least length)
BASE = (("assign", ASSIGN, 2, 8), ("access", ACCESS, 0, 16), ("hex", HEX, 0, 32))
#: One of these is in the lower-cased text of every match of ASSIGN.
ASSIGN_NEEDS = ("passw", "secret", "token", "apikey", "api_key")
CANDIDATE = r"[A-Za-z0-9+/_=-]"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
MIN_LENGTH, THRESHOLD = 20, 0.5


def fold_blocks(items: Column, carry: Callable[[Column, Column], Column], start: Column, element: Callable[[Column, Column], Column], size: int = 256) -> Column:
    """``element(carried value before it, item)`` for each item, with ``carry(value, item)`` giving the next value.

    Growing an array inside a fold copies it each time; done in blocks, the cost stays near linear for very many items.
    """
    blocks = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(items) / size).cast("int") - 1, F.lit(0)))
    block = lambda b: F.slice(items, b * size + 1, size)

    def with_heads(heads: Column) -> Column:
        def inside(b: Column) -> Column:
            first = element(F.get(heads, b), F.get(items, F.lit(0)))
            empty = F.struct(F.slice(F.array(first), 1, 0).alias("out"), F.get(heads, b).alias("at"))
            return F.aggregate(block(b), empty, lambda acc, x: F.struct(F.concat(acc["out"], F.array(element(acc["at"], x))).alias("out"), carry(acc["at"], x).alias("at")), lambda acc: acc["out"])

        return F.flatten(F.transform(blocks, inside))

    heads = F.aggregate(blocks, F.array(start), lambda acc, b: F.concat(acc, F.array(F.aggregate(block(b), F.element_at(acc, -1), carry))))
    return let(heads, with_heads)


def spans(text: Column, kind: str, order: int, pattern: str, group: int, least: int, needs: Column) -> Column:
    """Array of (start, order, end, kind, token) of the leftmost non-overlapping matches whose measured group is long enough.

    ``needs`` must hold for every text with such a match; the patterns run only where it does.
    """
    fields = lambda at, x: F.struct((at + x["gap"]).alias("start"), F.lit(order).alias("order"), (at + x["gap"] + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["token"].alias("token"))

    def found(pieces: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else None

        def placed(tokens: Column) -> Column:
            items = F.transform(whole, lambda m, i: F.struct(F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("size"), (F.get(tokens, i) if group else m).alias("token")))
            return let(items, lambda xs: F.filter(fold_blocks(xs, lambda at, x: at + x["gap"] + x["size"], F.lit(0), fields), lambda x: F.length(x["token"]) >= least))

        return let(measured, placed) if group else placed(pieces)

    none = F.array().cast("array<struct<start:int,order:int,end:int,kind:string,token:string>>")
    return F.when(needs, let(F.split(text, pattern), found)).otherwise(none)


def train(samples: DataFrame, alphabet: str = ALPHABET, smoothing: float = 1.0) -> list[float]:
    """Log-likelihood ratios (random against ordinary) by previous and next character, from samples (token, label)."""
    n = len(alphabet)
    code = lambda c: F.instr(F.lit(alphabet), c) - 1
    chars = F.filter(F.transform(F.split("token", ""), code), lambda x: x >= 0)
    pairs = samples.where("token is not null and label is not null").select(F.col("label").cast("int").alias("label"), chars.alias("c"))
    pairs = pairs.select("label", F.explode(F.transform(F.slice("c", 1, F.greatest(F.size("c") - 1, F.lit(0))), lambda x, i: x * n + F.get("c", i + 1))).alias("pair"))
    counts = {0: [smoothing] * (n * n), 1: [smoothing] * (n * n)}
    for label, pair, k in pairs.groupBy("label", "pair").count().collect():  # at most 2 * n * n rows
        counts[int(label > 0)][pair] += k
    rows = {label: [sum(c[i * n : (i + 1) * n]) for i in range(n)] for label, c in counts.items()}
    return [math.log(counts[1][i] / rows[1][i // n]) - math.log(counts[0][i] / rows[0][i // n]) for i in range(n * n)]


#: Parts of ordinary identifiers in the documents' languages.
SYLLABLES = (
    "get set make data user name count list index file path value item node test load read write base time page text line word main view form "
    "code type key map id er ing ation en le de la que re ment ich ung sch ein ado cion para http www com html org the and with status max size "
    "inter national service schaft gesell keit lich heit ver bund ober land straat tion ment eau oir aux ille con tra pre sion idad mente cia ero "
    "over under system report price order customer street number version release config default error message request response server client"
).split()


def samples(spark: SparkSession, each: int = 4000) -> DataFrame:
    """Labelled samples (id, token, label): random strings over several alphabets (1), and identifiers joined from syllables in usual styles, and rules of one symbol (0)."""
    i = F.col("id")
    digest = lambda salt, bits: F.base64(F.unhex(F.sha2(F.concat(F.lit(salt), i.cast("string")), bits)))
    letters = lambda salt: F.substring(F.regexp_replace(F.concat(digest(salt, 512), digest(f"{salt}2", 512)), "[^A-Za-z]", ""), 1, 40)
    wide = F.base64(F.unhex(F.substring(F.sha2(F.concat(F.lit("s"), i.cast("string")), 256), 1, 60)))
    plain = F.regexp_replace(digest("t", 256), "[+/=]", "")
    upper = F.upper(F.regexp_replace(digest("u", 512), "[+/=]", ""))
    styles = (wide, plain, upper, letters("v"), F.lower(letters("w")))
    secret = spark.range(each).select("id", F.get(F.array(*styles), (i % len(styles)).cast("int")).alias("token"), F.lit(1).alias("label"))
    syllables = F.array(*map(F.lit, SYLLABLES))
    part = lambda k: F.get(syllables, F.pmod(F.xxhash64(i, F.lit(k)), F.size(syllables)).cast("int"))
    parts = F.slice(F.array(*[part(k) for k in range(9)]), F.lit(1), (5 + F.pmod(F.xxhash64(i), F.lit(5))).cast("int"))
    joined = (F.array_join(parts, "_"), F.array_join(F.transform(parts, F.initcap), ""), F.array_join(parts, "-"), F.array_join(parts, "/"), F.array_join(parts, ""))
    styled = F.get(F.array(*joined), (i % len(joined)).cast("int"))
    ended = F.when(i % 4 == 0, F.concat(styled, F.lit("_"), (i % 2000).cast("string"))).otherwise(styled)
    ordinary = spark.range(each).select("id", F.when(i % 7 == 0, F.upper(ended)).otherwise(ended).alias("token"), F.lit(0).alias("label"))
    rules = spark.range(each // 20).select("id", F.repeat(F.substring(F.lit("-=_+/"), (i % 5 + 1).cast("int"), F.lit(1)), (20 + i % 30).cast("int")).alias("token"), F.lit(0).alias("label"))
    return secret.unionByName(ordinary).unionByName(rules)


def accuracy(samples: DataFrame, table: list[float], threshold: float, min_length: int) -> DataFrame:
    """One row: n, precision and recall of the models on labelled samples (token, label) of at least ``min_length`` characters."""
    found = likelihood_ratio(F.col("token"), table) > threshold
    held = samples.where("token is not null and label is not null").where(F.length("token") >= min_length).select((F.col("label") > 0).alias("real"), found.alias("found"))
    hits = F.count_if(F.col("real") & F.col("found"))
    return held.agg(F.count("*").alias("n"), (hits / F.count_if("found")).alias("precision"), (hits / F.count_if("real")).alias("recall"))


def likelihood_ratio(token: Column, table: list[float], alphabet: str = ALPHABET) -> Column:
    """Mean log-likelihood ratio a character pair."""
    n = len(alphabet)
    codes = F.transform(F.split(token, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    ratios = F.array(*[F.lit(round(x, 6)) for x in table])

    def mean(c: Column) -> Column:
        total = F.aggregate(F.sequence(F.lit(1), F.size(c) - 1), F.lit(0.0), lambda s, k: s + F.coalesce(F.get(ratios, F.get(c, k - 1) * n + F.get(c, k)), F.lit(0.0)))
        return F.when(F.size(c) > 1, total / (F.size(c) - 1)).otherwise(F.lit(0.0))

    return let(F.filter(codes, lambda x: x >= 0), mean)


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, text, base (array of spans by the patterns) and added (array of spans by the models) of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    docs = require_columns(docs, "doc_id", "text").withColumn("body", text)
    body = F.col("body")
    named = reduce(lambda a, b: a | b, [F.contains(F.lower(body), F.lit(x)) for x in ASSIGN_NEEDS])
    run = f"{CANDIDATE}{{{min_length},}}"
    long_run = body.rlike(f"{CANDIDATE}{{{min(min_length, 32)}}}")  # a long hexadecimal string is such a run too
    needs = {"assign": named, "access": F.contains(body, F.lit("AKIA")), "hex": long_run}
    base = [spans(body, kind, k, p, g, n, needs[kind]).alias(kind) for k, (kind, p, g, n) in enumerate(BASE)]
    found = docs.select("doc_id", "text", *base, spans(body, "markov", len(BASE), run, 0, min_length, long_run).alias("candidates"))
    found = found.select("doc_id", "text", F.sort_array(F.concat(*[k[0] for k in BASE])).alias("base"), "candidates")
    free = F.filter("candidates", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    found = found.select("doc_id", "text", "base", free.alias("free"))
    added = F.when(F.size("free") > 0, F.filter("free", lambda c: likelihood_ratio(c["token"], table) > threshold)).otherwise(F.col("free"))
    return found.select("doc_id", "text", "base", added.alias("added"))


def joined(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, table: list[float]) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_added for each row of ``docs`` (doc_id, text)."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan(docs, table).select("doc_id", *[count(k[0]) for k in BASE], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.sort_array(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def redact(docs: DataFrame, table: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced; texts without spans, nulls among them, and other columns stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id"), "text")  # the whole row travels as the key
    found = scan(rows, table).select(F.col("doc_id").alias("row"), "text", F.sort_array(F.concat("base", "added")).alias("s"))
    text = F.col("text")
    keep = lambda at, x: F.when(x["start"] >= at, F.concat(F.substring(text, at + 1, x["start"] - at), F.lit(mark))).otherwise(F.lit(""))
    furthest = F.aggregate("s", F.lit(0), lambda at, x: F.greatest(at, x["end"]))
    clean = F.concat(F.array_join(fold_blocks(F.col("s"), lambda at, x: F.greatest(at, x["end"]), F.lit(0), keep), ""), F.substring(text, furthest + 1, F.length(text)))
    found = found.select("row", F.when(F.size("s") > 0, clean).otherwise(text).alias("clean"))
    return found.select(*[(F.col("clean") if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])


def redact_documents(docs: DataFrame, table: list[float], mark: str = "[SECRET]") -> DataFrame:
    """``redact``, with n_chars (where there is such a column) brought in line with the new text."""
    out = redact(docs, table, mark)
    if "n_chars" not in docs.columns:
        return out
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))).select(docs.columns)
