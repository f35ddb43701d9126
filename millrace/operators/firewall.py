"""Five-point verification of sources by tier; what needs the network (HTTP, cross-source) comes in as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text, urls

#: White space as in Python's str.split.
SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
ERROR_PAGE = text.ERROR_PAGE.replace(r"\s", SPACE)
BINARY = (".pdf", ".docx", ".xlsx", ".pptx", ".mp3", ".mp4")
HEAD_BYTES, DENSITY, LEAST_CHARS = 8192, 0.10, 100


def content_reason(url: Column, html: Column) -> Column:
    """Why the first 8 KB of a page are no content, or null: error page, low density, too short; unread pages and binary files pass."""
    head = F.make_valid_utf8(F.substring(F.encode(html, "UTF-8"), 1, HEAD_BYTES).cast("string"))

    def judge(h: Column) -> Column:
        clean = F.length(F.trim(F.regexp_replace(F.regexp_replace(h, "<[^>]+>", " "), SPACE + "+", " ")))
        density = clean / F.greatest(F.length(h), F.lit(1))
        shown = F.when(density.isin(0.015, 0.045, 0.075), density - 0.001).otherwise(density)  # doubles just under the tie
        error = F.regexp_extract(h, ERROR_PAGE.replace("(?i)", "(?iu)"), 1)
        return (
            F.when(error != "", F.concat(F.lit("error_pattern:"), F.regexp_replace(F.substring(error, 1, 40), f"^{SPACE}+|{SPACE}+$", "")))
            .when((F.length(h) > 500) & (density < DENSITY), F.concat(F.lit("low_density:"), F.format_string("%.2f", shown)))
            .when(clean < LEAST_CHARS, "too_short")
        )

    path = F.substring_index(F.lower(url), "?", 1)
    binary = F.lit(False)
    for e in BINARY:
        binary = binary | F.endswith(path, F.lit(e))
    return F.when(binary, F.lit(None)).otherwise(text.let(head, judge))


def verify(rows: DataFrame, now: Column) -> DataFrame:
    """The rows with tier, passed and reasons (an array), from url, html, published (timestamp), http and cross_source.

    http is the reason of a failed request, null or empty where it went through; cross_source is whether another source
    confirms the page.  A date more than seven days ahead ends the checks.  S: date; A: and HTTP; B: and content; C: and
    cross-source.  Content is judged only where HTTP went through.
    """
    c, tier = F.col, F.col("tier")
    http = F.when((tier != "S") & (F.coalesce("http", F.lit("")) != ""), c("http"))
    cross = F.when((tier == "C") & ~F.coalesce("cross_source", F.lit(False)), "cross_verification_failed")
    content = F.when(tier.isin("B", "C") & http.isNull(), content_reason(c("url"), c("html")))
    future = F.when(c("published") > now + F.expr("INTERVAL 7 DAYS"), F.concat(F.lit("future_date:"), F.date_format("published", "yyyy-MM-dd")))
    reasons = F.when(future.isNotNull(), F.array(future)).otherwise(F.array_compact(F.array(http, cross, content)))
    return rows.withColumn("tier", urls.tier(c("url"))).withColumn("reasons", reasons).withColumn("passed", F.size("reasons") == 0)
