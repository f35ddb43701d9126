"""Queries that put operators together: context for a question, choice of domains and critiques, feedback, translation, deliveries."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rules, scores, text
from millrace.operators import chunker, dataset, pairing
from millrace.plans.core import ORACLES, query
from millrace.plans.retrieval_queries import _HYBRID, _fused
from millrace.plans.rule_queries import feedback_adjustments
from millrace.sources import parsers
from millrace.sources.tables import load


@query(f"""WITH {_HYBRID}, k AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM fu), b AS (SELECT query, k, doc_id, trim(text) AS t FROM k JOIN documents ON doc_id = id WHERE k <= 8)
SELECT query, count(*) AS n, md5(string_agg('<document index="' || k || '" ref="' || doc_id || '">' || chr(10) || replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || chr(10) || '</document>', chr(10) ORDER BY k)) AS context FROM b GROUP BY query""")
def retrieve_context(spark, sf):
    """The eight best documents of each query, as escaped and numbered XML in the order of their scores."""
    from pyspark.sql import Window as W

    ranked = _fused(spark, sf, 8).withColumn("k", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "id")))
    bodies = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.trim("text").alias("t"))
    xml = text.context_xml(F.col("k"), F.col("id").cast("string"), F.concat(F.lit("\n"), F.col("t"), F.lit("\n")))
    parts = ranked.join(bodies, "id").groupBy("query").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("k", xml.alias("x")))).alias("xs"))  # eight rows
    return parts.select("query", "n", F.md5(F.array_join(F.transform("xs", lambda x: x["x"]), "\n")).alias("context"))


_POOL = """p AS (SELECT DISTINCT p_type || p_size AS domain FROM part), gone AS (SELECT DISTINCT p_type || p_size AS domain FROM part WHERE p_partkey % 3 = 0), recent AS (SELECT DISTINCT p_type || p_size AS domain FROM part WHERE p_partkey % 2 = 0),
a AS (SELECT domain FROM p WHERE domain NOT IN (FROM gone) AND domain NOT IN (FROM recent)), b AS (SELECT domain FROM p WHERE domain NOT IN (FROM gone))"""


@query(f"WITH {_POOL} SELECT domain FROM p WHERE CASE WHEN (SELECT count(*) FROM a) >= 200 THEN domain IN (FROM a) WHEN (SELECT count(*) FROM b) >= 200 THEN domain IN (FROM b) ELSE true END")
def domain_choice(spark, sf):
    """Domains that were neither excluded nor used of late; if fewer than 200, those not excluded; if still fewer, all."""
    domain = F.concat("p_type", F.col("p_size").cast("string")).alias("domain")
    part = load(spark, sf, "part")
    mark = lambda rows, name: rows.select(domain).distinct().withColumn(name, F.lit(True))
    pool = part.select(domain).distinct().join(mark(part.where("p_partkey % 3 = 0"), "gone"), "domain", "left").join(mark(part.where("p_partkey % 2 = 0"), "recent"), "domain", "left")
    fresh, allowed = F.col("gone").isNull() & F.col("recent").isNull(), F.col("gone").isNull()
    counts = pool.agg(F.count_if(fresh).alias("n_fresh"), F.count_if(allowed).alias("n_allowed"))  # one row
    return pool.crossJoin(F.broadcast(counts)).where(F.when(F.col("n_fresh") >= 200, fresh).when(F.col("n_allowed") >= 200, allowed).otherwise(True)).select("domain")


@query("SELECT doc_id, score < 0.75 OR ('0x' || md5(doc_id::VARCHAR)[1:8])::BIGINT % 1000000 < 300000 AS critiqued FROM (SELECT doc_id, doc_id % 101 / 100 AS score FROM documents)")
def critique_choice(spark, sf):
    """Weak answers are always criticised, of the others a share that follows from their ids."""
    drawn = F.conv(F.substring(F.md5(F.col("doc_id").cast("string")), 1, 8), 16, 10).cast("long") % 1_000_000 < 300_000
    return load(spark, sf, "documents").select("doc_id", ((F.col("doc_id") % 101 / 100 < 0.75) | drawn).alias("critiqued"))


@query(f"""WITH a AS ({ORACLES['feedback_adjustments']}) SELECT doc_id, CASE WHEN doc_id % 5 >= 3 THEN 0.82 ELSE threshold END AS threshold, CASE WHEN doc_id % 5 >= 3 THEN 0.10 ELSE adversarial END AS adversarial, CASE WHEN doc_id % 5 >= 3 THEN 3 ELSE turns END::INT AS turns, doc_id % 5 >= 3 AS was_reset FROM a""")
def feedback_cycle(spark, sf):
    """A cycle's calibration: after three regressions in a row (here: by the id) the defaults, else the adjusted one."""
    reset = F.col("doc_id") % 5 >= 3
    kept = lambda default, c: F.when(reset, default).otherwise(F.col(c)).alias(c)
    return feedback_adjustments(spark, sf).select("doc_id", kept(0.82, "threshold"), kept(0.10, "adversarial"), kept(3, "turns"), reset.alias("was_reset"))


@query("SELECT doc_id, md5(CASE WHEN trim(text) = '' OR lang = 'pl' OR is_polish THEN text ELSE '[pl] ' || text END) AS translated FROM (SELECT doc_id, text, lang, length(text) >= 50 AND len(regexp_extract_all(lower(text), '[ąćęłńóśźż]')) / length(text) > 0.02 AS is_polish FROM documents)")
def translations(spark, sf):
    """Texts through an injected translator (here: a mark in front); blank and Polish ones pass."""
    t = F.col("text")
    passes = (F.trim(t) == "") | (F.col("lang") == "pl") | text.is_polish(t)
    return load(spark, sf, "documents").select("doc_id", F.md5(F.when(passes, t).otherwise(F.concat(F.lit("[pl] "), t))).alias("translated"))


@query("SELECT doc_id, len(l)::INT AS n_tokens, len(list_distinct(l))::INT AS n_terms FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS l FROM documents)")
def search_columns(spark, sf):
    """The derived search column (terms of the lower-cased text), by its sizes."""
    return load(spark, sf, "documents").select("doc_id", text.tokens(F.lower("text")).alias("l")).select("doc_id", F.size("l").alias("n_tokens"), F.size(F.array_distinct("l")).alias("n_terms"))


@query()
def document_partners(spark, sf):
    """A partner for each document whose id is divisible by 20, by the vectors of the same ids; held against brute force in a test."""
    names = F.get(F.array(*map(F.lit, ("CSRD report", "sfdr note", "Taxonomy act", "csddd", "others"))), (F.col("doc_id") % 5).cast("int"))
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), names.alias("name")).join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), "id")
    return pairing.partners(docs, docs.where("id % 20 = 0"))


@query()
def chunk_lengths(spark, sf):
    """Lengths of all chunks: n, least, median, quartile and most."""
    made = chunker.chunk_documents(load(spark, sf, "documents"), "doc_id", "text")
    return dataset.distribution(made.select(F.lit("all").alias("g"), F.length("body").alias("v")), ["g"], "v")


@query("SELECT page_id, trim(url) AS url FROM pages WHERE page_id % 3 <> 1 AND trim(url) <> ''")
def signed_deliveries(spark, sf):
    """Pushed feeds whose signature fits the secret, or that have none to fit; a third is signed with another secret."""
    p = F.col("page_id")
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    payload = F.concat(F.lit("<rss><channel><item><title>x</title><link>"), escaped, F.lit("</link></item></channel></rss>"))
    rows = load(spark, sf, "pages").select("page_id", payload.alias("payload"), F.lit("A").alias("tier"))
    sent = F.when(p % 3 == 0, scores.hmac_sha256("secret", F.col("payload"))).when(p % 3 == 1, scores.hmac_sha256("other", F.col("payload")))
    rows = rows.withColumn("signature", sent).withColumn("has_secret", p % 3 != 2)
    good = rows.where(~F.col("has_secret") | (F.col("signature") == scores.hmac_sha256("secret", F.col("payload"))))
    return parsers.feed(good, "page_id", "payload", "tier").select("page_id", "url")


@query("SELECT doc_id, round(1 - (doc_id % 11) / 10, 6) AS hallucination_rate, CASE WHEN doc_id % 11 / 10 < 0.7 THEN 'factual_accuracy' ELSE '' END AS weak FROM labels")
def feedback_nodes(spark, sf):
    """What a judged answer hands to the feedback loop: the hallucination rate and its weakness."""
    dim = F.col("doc_id") % 11 / 10
    return load(spark, sf, "labels").select("doc_id", F.round(1 - dim, 6).alias("hallucination_rate"), F.array_join(rules.weaknesses({d: dim if d == "hallucination" else F.lit(1.0) for d in rules.WEAKNESSES}), ",").alias("weak"))
