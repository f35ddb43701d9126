"""Queries over documents' and pages' text."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import scores, text, urls
from millrace.plans.core import query
from millrace.sources import main_content
from millrace.sources.tables import load

_q = lambda s: "'" + s.replace("'", "''") + "'"
_chars = lambda t, cls: f"len(regexp_extract_all({t}, '{cls}'))"
_L = {k: f"({_chars('s', f'[{v}]')} / n)" for k, v in text.LETTERS.items()}
_W = {k: f"(len(list_intersect(ws, [{', '.join(map(_q, v))}])) / {len(v)})" for k, v in text.STOP_WORDS.items()}
LANGUAGE_CTE = f"""
lang_a AS (SELECT doc_id, text, lower(text[1:5000]) AS s FROM documents),
lang_b AS (SELECT *, greatest({_chars('s', r'[\p{L}]')}, 1) AS n, list_distinct(list_filter(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{2,}}$'))) AS ws FROM lang_a),
lang_c AS (SELECT *, greatest({', '.join(_L.values())}) AS bl, greatest({', '.join(_W.values())}) AS bw FROM lang_b),
lang AS (SELECT doc_id, text, CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown' WHEN bl > 0.01 THEN CASE {' '.join(f"WHEN {v} = bl THEN '{k}'" for k, v in _L.items())} END
  WHEN bw > 0.3 THEN CASE {' '.join(f"WHEN {v} = bw THEN '{k}'" for k, v in _W.items())} END ELSE 'en' END AS language FROM lang_c)"""


@query(f"""WITH {LANGUAGE_CTE}, g AS (SELECT language, list_sort(list(length(text))) AS l FROM lang GROUP BY language)
SELECT language, len(l) AS n_docs, round(len(l) / (SELECT count(*) FROM documents), 6) AS share, l[1] AS min_chars, l[(floor(len(l) * 0.5) + 1)::INT] AS median_chars, l[(floor(len(l) * 0.75) + 1)::INT] AS p75_chars, l[-1] AS max_chars FROM g""")
def profile_by_language(spark, sf):
    """Lengths by detected language: counts by (language, length) first, so no task holds a language's rows."""
    docs = load(spark, sf, "documents").select(text.detect_language(F.col("text")).alias("language"), F.length("text").alias("n"))
    counts = docs.groupBy("language", "n").agg(F.count("*").alias("k"))
    from pyspark.sql import Window as W

    own = W.partitionBy("language")
    run = counts.withColumn("upto", F.sum("k").over(own.orderBy("n"))).withColumn("total", F.sum("k").over(own))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.col("total") * q), F.col("n")))
    out = run.groupBy("language").agg(F.max("total").alias("n_docs"), F.min("n").alias("min_chars"), at(0.5).alias("median_chars"), at(0.75).alias("p75_chars"), F.max("n").alias("max_chars"))
    return out.select("language", "n_docs", F.round(F.col("n_docs") / F.sum("n_docs").over(W.partitionBy()), 6).alias("share"), "min_chars", "median_chars", "p75_chars", "max_chars")


@query(f"WITH {LANGUAGE_CTE} SELECT doc_id, language FROM lang")
def detect_language(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.detect_language(F.col("text")).alias("language"))


@query(f"SELECT doc_id, length(text) >= 50 AND {_chars('lower(text)', '[' + text.LETTERS['pl'] + ']')} / length(text) > 0.02 AS is_polish FROM documents")
def is_polish(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.is_polish(F.col("text")).alias("is_polish"))


@query("SELECT doc_id, CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{w}')" for w in ws) + f" THEN '{k}'" for k, ws in text.CATEGORIES.items()) + " ELSE 'general' END AS category FROM documents")
def document_category(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.category(F.col("text")).alias("category"))


@query(rf"""WITH w AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[{text.RICH_LETTERS}]{{3,}}')) AS ws FROM documents)
SELECT doc_id, round(CASE WHEN len(ws) = 0 THEN 0.0 ELSE len(list_distinct(ws)) / len(ws) END, 6) AS richness FROM w""")
def vocabulary_richness(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.round(text.richness(F.col("text")), 6).alias("richness"))


# DuckDB knows word borders of ASCII only: other letters become an x there, and the two that patterns need their plain form.
_ASCII = r"regexp_replace(translate(text, 'łęŁĘ', 'leLE'), '[^\x00-\x7F§–—…„“”’‘«»¿¡°€]', 'x', 'g')"
_DENSE = " + ".join(f"{w} * len(regexp_extract_all(a, '{p.translate(str.maketrans('łę', 'le'))}'))" for w, p in text.DENSE)


@query(f"WITH t AS (SELECT doc_id, text, {_ASCII} AS a FROM documents) SELECT doc_id, round(least(({_DENSE}) / (greatest(length(text), 1) / 100.0) / 10.0, 1.0), 6) AS density FROM t")
def information_density(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.round(text.density(F.col("text")), 6).alias("density"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS text FROM pages")
def html_regex_text(spark, sf):
    return load(spark, sf, "pages").select("page_id", text.strip_tags(F.col("html")).alias("text"))


@query(f"""WITH p AS (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g')) AS t FROM pages)
SELECT page_id, regexp_matches(html[1:8192], {_q(text.ERROR_PAGE)}) AS error_page, length(t) < 100 AS too_short, length(html) > 500 AND length(t) / length(html) < 0.10 AS too_thin FROM p""")
def content_integrity(spark, sf):
    t = text.strip_tags(F.col("html"))
    return load(spark, sf, "pages").select("page_id", F.substring("html", 1, 8192).rlike(text.ERROR_PAGE).alias("error_page"), (F.length(t) < 100).alias("too_short"), ((F.length("html") > 500) & (F.length(t) / F.length("html") < 0.10)).alias("too_thin"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^www\.', '')"
_NORMAL = rf"""(SELECT page_id, url, h, CASE WHEN sch = '' THEN lower(trim(url)) ELSE sch || '://' || regexp_replace(full_host, '^[w.]+', '') || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN ps <> '' THEN '?' || ps ELSE '' END END AS n FROM (
SELECT page_id, url, {_HOST} AS h, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) AS full_host, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS sch,
regexp_replace(regexp_replace(regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1), ';[^/]*$', ''), '/+$', '') AS path,
array_to_string(list_sort(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: string_split(p, '=')[1] NOT IN ({', '.join(map(_q, urls.TRACKING))}))), '&') AS ps FROM pages))"""


@query(f"SELECT page_id, n AS normal_url, sha256(n)[1:16] AS fingerprint FROM {_NORMAL}")
def normalise_urls(spark, sf):
    return load(spark, sf, "pages").select("page_id", urls.normalise(F.col("url")).alias("normal_url"), urls.fingerprint(F.col("url")).alias("fingerprint"))


@query(f"SELECT min(page_id) AS page_id, n AS normal_url, count(*) AS n_pages FROM {_NORMAL} GROUP BY n")
def dedup_urls(spark, sf):
    """First page of each normalised URL."""
    return load(spark, sf, "pages").groupBy(urls.normalise(F.col("url")).alias("normal_url")).agg(F.min("page_id").alias("page_id"), F.count("*").alias("n_pages"))


_in = lambda ds: "(" + " OR ".join(f"h = '{d}' OR ends_with(h, '.{d}')" for d in ds) + ")"


@query(f"SELECT page_id, h AS host, CASE WHEN {_in(urls.TIER_S)} THEN 'S' WHEN {_in(urls.TIER_A)} OR regexp_matches(h, '\\.(edu|gov|ac\\.uk)$') THEN 'A' WHEN {_in(urls.TIER_B)} THEN 'B' ELSE 'C' END AS tier, CASE {' '.join(f'WHEN contains(lower(url), {_q(p)}) THEN {_q(f)}' for p, f in urls.FORMATS)} ELSE 'html' END AS format FROM {_NORMAL}")
def source_tiers(spark, sf):
    u = F.col("url")
    return load(spark, sf, "pages").select("page_id", urls.host(u).alias("host"), urls.tier(u).alias("tier"), urls.file_format(u).alias("format"))


@query("SELECT doc_id, sha256(text) AS file_hash, md5(text) AS md5, sha1(text)[1:12] AS short_id FROM documents")
def stable_ids(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("file_hash"), F.md5("text").alias("md5"), F.substring(F.sha1("text"), 1, 12).alias("short_id"))


@query("SELECT doc_id, sha256('client|batch-' || (doc_id // 100) || '|' || doc_id || '|key') AS watermark_hash, doc_id % 50 = 0 AND doc_id > 0 AS marked FROM documents")
def watermark_hashes(spark, sf):
    batch = F.concat(F.lit("batch-"), F.floor(F.col("doc_id") / 100).cast("string"))
    return load(spark, sf, "documents").select("doc_id", scores.watermark(F.lit("client"), batch, F.col("doc_id"), "key").alias("watermark_hash"), ((F.col("doc_id") % 50 == 0) & (F.col("doc_id") > 0)).alias("marked"))


@query("SELECT conv_id, turn, '<document index=\"' || turn || '\" ref=\"' || role || '\">' || replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</document>' AS xml FROM conversations")
def context_xml(spark, sf):
    return load(spark, sf, "conversations").select("conv_id", "turn", text.context_xml(F.col("turn"), F.col("role"), F.col("text")).alias("xml"))


@query("SELECT doc_id, trim(regexp_replace(text, '(?is)<reasoning>.*?</reasoning>\\s*', '', 'g')) AS clean, length(text) AS n, ceil(length(text) / 4)::BIGINT AS approx_tokens FROM documents")
def strip_reasoning(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.trim(text.strip_reasoning(F.col("text"))).alias("clean"), F.length("text").cast("long").alias("n"), F.ceil(F.length("text") / 4).alias("approx_tokens"))


@query("SELECT doc_id, replace(trim(text[1:20000]), chr(10), ' ') AS preview FROM documents")
def document_preview(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.replace(F.trim(F.substring("text", 1, 20000)), F.lit("\n"), F.lit(" ")).alias("preview"))


@query()
def page_content(spark, sf):
    """Main content of every page, by the scan over blocks; held against brute force in a test."""
    return main_content.with_content(load(spark, sf, "pages"), "page_id", "html")
