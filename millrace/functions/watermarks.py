"""Watermarks of dataset texts: spacing and synonyms, keyed synonyms, and invisible characters."""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.scores import watermark

# Synonyms, in order, and words behind which the space is doubled.
SYNONYMS = {"wymogi": "wymogi normatywne", "obowiązki": "powinności prawne", "raportowanie": "sprawozdawczość regulacyjna", "ujawnienia": "ujawnienia informacyjne"}
KEYWORDS = "dyrektywa|directive|rozporządzenie|regulation"
# Keyed synonyms, in order.
KEYED = {
    "wymogi": ("wymogi normatywne", "wymagania", "obowiązki prawne"),
    "raportowanie": ("sprawozdawczość", "raportowanie regulacyjne", "ujawnianie informacji"),
    "ujawnienia": ("ujawnienia informacyjne", "ujawnienia ESG", "ujawnienia wymagane"),
    "podmioty": ("podmioty zobowiązane", "jednostki", "przedsiębiorstwa"),
    "wskaźniki": ("wskaźniki ESG", "mierniki", "parametry"),
    "zgodność": ("zgodność regulacyjna", "compliance", "spełnienie wymogów"),
    "obowiązek": ("obowiązek prawny", "powinność", "wymóg"),
    "ocena": ("ocena ryzyka", "ewaluacja", "analiza"),
    "requirements": ("regulatory requirements", "obligations", "mandates"),
    "reporting": ("disclosure reporting", "mandatory reporting", "regulatory reporting"),
    "disclosure": ("mandatory disclosure", "ESG disclosure", "required disclosure"),
    "compliance": ("regulatory compliance", "adherence", "conformance"),
}
# Invisible characters, two for each bit.
INVISIBLE = "\u200b\u200c\u200d\u2060"
_KEYWORD = rf"(?is)^(.*?(?<![\p{{L}}\p{{N}}_])(?:{KEYWORDS}))(?![\p{{L}}\p{{N}}_])"
_SHOWN = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{KEYWORDS})  "


def inject(text: Column, index: Column) -> Column:
    """Even index: two more spaces behind the first keyword; odd: the first synonym in the table's order, once, else as even."""
    spaced = F.regexp_replace(text, _KEYWORD, "$1  ")
    swapped = [F.when(F.contains(text, F.lit(a)), F.concat(F.substring_index(text, a, 1), F.lit(b), F.substring(text, F.instr(text, a) + len(a), F.length(text)))) for a, b in SYNONYMS.items()]
    return F.when(index % 2 == 0, spaced).otherwise(F.coalesce(*swapped, spaced))


def shows(text: Column) -> Column:
    """Whether a text bears a visible mark."""
    found = text.rlike(_SHOWN)
    for rare in SYNONYMS.values():
        found = found | F.contains(text, F.lit(rare))
    return found


def registry(records: DataFrame, index: str, body: str, client: str, batch: str, interval: int, secret: str) -> DataFrame:
    """Records that should bear a mark (every ``interval``-th): index, hash and whether the text shows a mark."""
    due = records.where(F.col(index) % interval == interval - 1)
    return due.select(index, watermark(F.lit(client), F.lit(batch), F.col(index), secret).alias("hash"), shows(F.col(body)).alias("verified"))


class Keyed:
    """Keyed marks of one client and batch: a synonym chosen by HMAC, and 32 bits in invisible characters."""

    def __init__(self, client: str, batch: str, secret: str):
        self.key = hmac.new(secret.encode(), f"{client}|{batch}".encode(), hashlib.sha256).digest()

    def _number(self, message: str, size: int) -> int:
        return int.from_bytes(hmac.new(self.key, message.encode(), hashlib.sha256).digest()[:size], "big")

    def synonym(self, word: str, index: int) -> str:
        return KEYED[word][self._number(f"{word}|{index}", 2) % len(KEYED[word])]

    def embed(self, text: str, index: int) -> str:
        word = next((w for w in KEYED if w in text), None)
        if word:
            text = text.replace(word, self.synonym(word, index), 1)
        places = [m.end(1) for m in re.finditer(r"([.,:;!?])\s", text)]
        if len(places) < 8:
            places = [m.start() for m in re.finditer(r"\s+", text)]
        out, last = [], 0
        for k, (place, bit) in enumerate(zip(places, f"{self._number(f'zwc|{index}', 4):032b}", strict=False)):
            out += [text[last:place], INVISIBLE[int(bit) * 2 + k % 2]]
            last = place
        return "".join([*out, text[last:]])

    def verify(self, text: str, index: int) -> bool:
        """Whether a word stands there with the synonym that this key and index choose."""
        return any(word in text and self.synonym(word, index) in text for word in KEYED)


def embed(records: DataFrame, index: str, body: str, client: str, batch: str, secret: str) -> DataFrame:
    """(index, marked, verified): texts with both keyed marks; nulls stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = Keyed(client, batch, secret)
        for b in batches:
            rows = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            marked = [None if t is None else keyed.embed(t, i) for i, t in rows]
            good = [None if t is None else keyed.verify(t, i) for (i, _), t in zip(rows, marked, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(marked, pa.string()), pa.array(good, pa.bool_())], [index, "marked", "verified"])

    return records.select(F.col(index).cast("long"), body).mapInArrow(run, f"{index} long, marked string, verified boolean")


def hidden_bits(text: Column) -> Column:
    """The bits that a text's invisible characters spell, as far as they can be trusted.

    Characters alternate between two alphabets, so the first one out of step shows that some are lost: bits end there.
    """
    hidden = F.regexp_replace(text, f"[^{INVISIBLE}]", "")
    steps = F.regexp_extract(F.translate(hidden, INVISIBLE, "0101"), "^((?:01)*0?)", 1)
    return F.substring(F.translate(hidden, INVISIBLE, "0011"), F.lit(1), F.least(F.length(steps), F.lit(32)))


def signatures(indices: DataFrame, index: str, candidates: list[tuple[str, str]], secret: str) -> DataFrame:
    """(index, client, batch, spelled): the 32 bits that a record of each candidate (client, batch) would bear."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keyed = [(c, b, Keyed(c, b, secret)) for c, b in candidates]
        for batch in batches:
            rows = [(i, c, b, f"{k._number(f'zwc|{i}', 4):032b}") for i in batch.column(0).to_pylist() for c, b, k in keyed]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], ["index", "client", "batch", "spelled"])

    return indices.select(F.col(index).cast("long")).mapInArrow(run, "index long, client string, batch string, spelled string")


def votes(records: DataFrame, index: str, body: str, candidates: list[tuple[str, str]], secret: str, least: int = 8, doubt: float = 1e-6) -> DataFrame:
    """client, batch, n_read, n_match, expected, log10_bound, found: whose marks a set of records bears.

    Every record with ``least`` trusted bits votes for the candidates whose signature of its index starts with them.  Of a
    stranger's records ``expected`` (the sum of 2 to the minus bits) would; the chance that as many match is at most
    (e * expected / matches) ** matches * e ** -expected, times the number of candidates.  Below ``doubt`` the candidate is found.
    """
    read = records.select(F.col(index).cast("long").alias("index"), hidden_bits(F.col(body)).alias("bits")).where(F.length("bits") >= least)
    each = read.join(signatures(read.select("index").distinct(), "index", candidates, secret), "index")
    match = F.expr("substring(spelled, 1, length(bits)) = bits")
    sums = each.groupBy("client", "batch").agg(
        F.count("*").alias("n_read"), F.count_if(match).alias("n_match"), F.sum(F.pow(F.lit(2.0), -F.length("bits"))).alias("expected")
    )
    m, mu = F.col("n_match"), F.col("expected")
    bound = F.when(m > mu, (m * (1 + F.log(mu / m)) - mu) / F.log(F.lit(10.0))).otherwise(0.0) + F.log10(F.lit(float(max(len(candidates), 1))))
    bound = F.least(bound, F.lit(0.0))
    return sums.withColumn("log10_bound", bound).withColumn("found", F.col("log10_bound") < F.log10(F.lit(doubt)))


def detect(text: Column) -> Column:
    """Struct of technique (both, zwc, synonym, none) and confidence, without knowing client or batch."""
    hidden = text.rlike(f"[{INVISIBLE}]")
    swapped = F.lit(False)
    for words in KEYED.values():
        for w in words:
            swapped = swapped | F.contains(text, F.lit(w))
    technique = F.when(hidden & swapped, "both").when(hidden, "zwc").when(swapped, "synonym").otherwise("none")
    confidence = F.when(hidden & swapped, 0.95).when(hidden, 0.80).when(swapped, 0.60).otherwise(0.0)
    return F.struct(technique.alias("technique"), confidence.alias("confidence"))
