"""Column builders over text: language, domain, density, classification, markup."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characteristic letters by language, in order of preference.
LETTERS = {
    "pl": "ąćęłńóśźż",
    "de": "äöüß",
    "fr": "àâæçéèêëîïôœùûüÿ",
    "es": "áéíóúüñ¿¡",
    "it": "àèéìîòóùú",
    "pt": "ãõàáâçéêíóôú",
    "ru": "абвгдеёжзийклмнопрстуфхцчшщъыьэюя",
    "uk": "іїєґ",
}
# Common words by language.
STOP_WORDS = {
    "en": ["the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "shall", "may"],
    "pl": ["w", "i", "z", "na", "do", "że", "się", "nie", "o", "przez", "po", "jest", "są"],
    "de": ["der", "die", "das", "und", "in", "zu", "von", "den", "mit", "des", "ist", "ein"],
    "fr": ["le", "de", "et", "en", "les", "des", "du", "un", "une", "la", "est", "que"],
}
# Document categories and their marker words, in order.
CATEGORIES = {
    "legal_regulatory": ("regulation", "directive", "act", "compliance", "liability", "court"),
    "climate_finance": ("taxonomy", "sfdr", "csrd", "carbon", "cbam", "esg", "emissions"),
    "health_medtech": ("fda", "medical device", "ivdr", "mdr", "clinical", "ema"),
    "ai_data_governance": ("ai act", "gdpr", "privacy", "model", "data transfer", "copyright"),
    "capital_markets": ("mifid", "mica", "basel", "aml", "tokenization", "derivatives"),
}
# Page texts that mean an error instead of content.
ERROR_PAGE = (
    r"(?i)(404\s*not\s*found|page\s*not\s*found|access\s*denied|403\s*forbidden|captcha|verify\s*you\s*are\s*human|i\s*am\s*not\s*a\s*robot|"
    r"cloudflare\s*ray\s*id|ddos\s*protection|this\s*page\s*(is\s*)?not\s*available|content\s*unavailable|requires\s*subscription|purchase\s*access|"
    r"pay\s*per\s*view|javascript\s*(must\s*be\s*)?is\s*disabled|enable\s*javascript)"
)
# Phrases of a refusal.
REFUSALS = ("brak danych w dyrektywie", "brak informacji w dyrektywie", "nie ma danych w tekście", "poza zakresem dyrektywy", "brak danych w tekście")


def tokens(text: Column) -> Column:
    """Runs of letters, digits and underscores: the same in every engine that knows Unicode classes."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def best_of(scores: dict[str, Column]) -> Column:
    """Struct of the greatest score and its first name."""
    ranked = [F.struct(s.cast("double").alias("score"), F.lit(-k).alias("order"), F.lit(name).alias("name")) for k, (name, s) in enumerate(scores.items())]
    return F.array_max(F.array(*ranked))


def detect_language(text: Column) -> Column:
    """Language by characteristic letters, else by common words; each score is computed once."""

    plain = {k: [w for w in v if re.fullmatch("[a-z]{2,}", w)] for k, v in STOP_WORDS.items()}  # words of other letters never count
    every = F.array(*map(F.lit, sorted({w for v in plain.values() for w in v})))
    left = lambda s, chars: F.length(F.translate(s, chars, ""))

    def by_words(words: Column) -> Column:
        best = best_of({k: F.size(F.array_intersect(words, F.array(*map(F.lit, v)))) / F.lit(len(STOP_WORDS[k])) for k, v in plain.items()})
        return let(best, lambda x: F.when(x["score"] > 0.3, x["name"]).otherwise("en"))

    def of_sample(sample: Column) -> Column:
        def of_other(other: Column) -> Column:  # what is not ASCII: all characteristic letters are there
            ascii_letters = F.length(sample) - F.length(F.regexp_replace(sample, "[a-z]+", ""))
            letters = F.greatest(ascii_letters + F.length(other) - F.length(F.regexp_replace(other, r"\p{L}+", "")), F.lit(1))
            return let(letters, lambda n: best_of({k: (F.length(other) - left(other, v)) / n for k, v in LETTERS.items()}))

        best = let(F.regexp_replace(sample, r"[\x00-\x7F]+", ""), of_other)
        words = F.array_intersect(every, F.split(sample, r"[^\p{L}\p{N}_]+"))
        return let(best, lambda x: F.when(x["score"] > 0.01, x["name"]).otherwise(let(words, by_words)))

    found = let(F.lower(F.substring(text, 1, 5000)), of_sample)
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, "unknown").otherwise(found)


def is_polish(text: Column) -> Column:
    return (F.length(text) >= 50) & (F.regexp_count(F.lower(text), F.lit(f"[{LETTERS['pl']}]")) / F.length(text) > 0.02)


def category(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(*[F.when(any_of(low, words), F.lit(name)) for name, words in CATEGORIES.items()], F.lit("general"))


def any_of(text: Column, needles) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(n)) for n in needles])


def is_refusal(text: Column) -> Column:
    return any_of(F.lower(text), REFUSALS)


# The letters of words that count for richness.
RICH_LETTERS = "a-zA-ZąćęłńóśźżÄÖÜäöüàâéèêëîïôœùûü"
# What makes a text dense: references (3), numbers, dates (2), acronyms.
DENSE = (
    (3, r"(?i)\b(art(?:ykuł)?\.?\s*\d+|article\s+\d+|§\s*\d+|ustęp|ust\.|paragraph|section)\b"),
    (1, r"\b\d{1,3}(?:[.,]\d+)*\s*(?:%|EUR|PLN|mln|mld|tys\.)?\b"),
    (2, r"\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b"),
    (1, r"\b[A-Z]{2,6}\b"),
)
#: What a match of each can begin with: asked first, it spares the borders at all other places.
DENSE_STARTS = (r"[AaPpSsUu§]", r"\d", r"\d", r"[A-Z]")
#: A word border as every engine knows it once letters, digits and underscores are spelled out.
_WORD = r"[\p{L}\p{N}_]"
_BORDER = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def bordered(pattern: str) -> str:
    """The pattern with Unicode word borders, digits and white space of ASCII."""
    return pattern.replace(r"\b", _BORDER)


def richness(text: Column) -> Column:
    """Distinct share of words of three of these letters or more; letters, digits and underscores border a word."""
    words = F.regexp_extract_all(F.lower(text), F.lit(bordered(f"\\b[{RICH_LETTERS}]{{3,}}\\b")), F.lit(0))
    return let(words, lambda w: F.when(F.size(w) == 0, 0.0).otherwise(F.size(F.array_distinct(w)) / F.size(w)))


def dense_patterns() -> list[tuple[int, str]]:
    """Weights and patterns of ``DENSE``, each behind a look at its first letter."""
    return [(weight, f"(?={start})(?:{bordered(pattern)})") for (weight, pattern), start in zip(DENSE, DENSE_STARTS, strict=True)]


def density(text: Column) -> Column:
    """Legal references, numbers, dates and acronyms by length, capped at 1."""
    hits = reduce(lambda a, b: a + b, [weight * F.regexp_count(text, F.lit(pattern)) for weight, pattern in dense_patterns()])
    return F.least(hits / (F.greatest(F.length(text), F.lit(1)) / 100.0) / 10.0, F.lit(1.0))


def strip_tags(html: Column) -> Column:
    """Last-resort extraction: tags become spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]+>", " "), "[ \t\r\n]+", " "))


def strip_reasoning(text: Column) -> Column:
    return F.regexp_replace(text, r"(?is)<reasoning>.*?</reasoning>\s*", "")


def subtitle_text(raw: Column) -> Column:
    """Spoken text of an SRT or VTT file."""
    body = F.regexp_replace(raw, r"(?m)^WEBVTT.*$", "")
    body = F.regexp_replace(body, r"(?m)^\d{1,2}:\d{2}(:\d{2})?[.,]\d{3} --> .*$", "")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^\d+\s*$", ""), "<[^>]+>", "")
    return F.trim(F.regexp_replace(body, r"\s+", " "))


def context_xml(index: Column, ref: Column, body: Column) -> Column:
    escaped = F.replace(F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return F.concat(F.lit('<document index="'), index.cast("string"), F.lit('" ref="'), ref, F.lit('">'), escaped, F.lit("</document>"))


def snippet(text: Column, at: Column, radius: int = 100) -> Column:
    start = F.greatest(at - radius, F.lit(1))
    return F.trim(F.replace(F.substring(text, start, at - start + radius), F.lit("\n"), F.lit(" ")))


def strip_fences(raw: Column) -> Column:
    """A model's answer without code fences around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, "```(?:json)?", ""), r"^\s+|\s+$", ""))
