"""Queries of topic discovery: firewall, scores and ranking, with a fixed clock."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import scores, text, urls
from millrace.operators import firewall as checks
from millrace.plans.core import query
from millrace.plans.text_queries import _NORMAL, _in
from millrace.sources.tables import load

NOW = "2024-02-01"

_TOPIC = """t AS (SELECT user_id % 40 AS topic, count(*) AS n, count(DISTINCT event_type) AS kinds, max(ts) AS last_at, avg(value) AS v FROM events GROUP BY 1),
s AS (SELECT topic, n, round(greatest(1 - date_diff('day', last_at::DATE, DATE '2024-02-01') / 365.0, 0), 3) AS recency, kinds / 5.0 AS diversity, least(n / 400.0, 1) AS demand, least(v / 200.0, 1) AS quality FROM t)"""


def topics(spark, sf):
    t = load(spark, sf, "events").groupBy((F.col("user_id") % 40).alias("topic")).agg(F.count("*").alias("n"), F.count_distinct("event_type").alias("kinds"), F.max("ts").alias("last_at"), F.avg("value").alias("v"))
    recency = F.round(F.greatest(1 - F.datediff(F.lit(NOW).cast("date"), F.to_date("last_at")) / 365.0, F.lit(0.0)), 3)
    return t.select("topic", "n", recency.alias("recency"), (F.col("kinds") / 5.0).alias("diversity"), F.least(F.col("n") / 400.0, F.lit(1.0)).alias("demand"), F.least(F.col("v") / 200.0, F.lit(1.0)).alias("quality"))


@query(f"WITH {_TOPIC} SELECT topic, n, recency, round(diversity, 6) AS diversity FROM s")
def topic_recency(spark, sf):
    return topics(spark, sf).select("topic", "n", "recency", F.round("diversity", 6).alias("diversity"))


@query(f"WITH {_TOPIC} SELECT topic, round(0.25 * recency + 0.20 * quality + 0.15 * 0.5 + 0.15 * least(greatest((13 * n / 1000.0 - 1) / 4, 0), 1) + 0.10 * least(greatest(1 - log10(greatest(1.0, n)) / 5, 0), 1) + 0.08 * 0.5 + 0.04 * demand + 0.03 * diversity, 4) AS gap FROM s")
def knowledge_gap(spark, sf):
    parts = {"temporal_gap": F.col("recency"), "llm_uncertainty": F.col("quality"), "cross_model_divergence": F.lit(None).cast("double"), "citation_velocity": scores.citation_velocity(F.col("n"), F.lit(1000)), "niche_penetration": scores.niche(F.col("n")), "source_authority": F.lit(None).cast("double"), "multilingual_gap": F.col("demand"), "format_diversity": F.col("diversity")}
    return topics(spark, sf).select("topic", scores.knowledge_gap(parts).alias("gap"))


@query(f"WITH {_TOPIC} SELECT topic, round(0.20 * (n > 250)::INT + 0.45 * quality + 0.25 * diversity + 0.20 * recency + 0.10 * demand, 6) AS priority FROM s ORDER BY priority DESC, topic LIMIT 10")
def ranked_topics(spark, sf):
    c = F.col
    rows = topics(spark, sf).select("topic", F.round(scores.priority(c("n") > 250, c("quality"), c("diversity"), c("recency"), c("demand")), 6).alias("priority"))
    return rows.orderBy(F.desc("priority"), "topic").limit(10)


@query("SELECT event_type, user_id, total FROM (SELECT event_type, user_id, round(sum(value), 4) AS total, row_number() OVER (PARTITION BY event_type ORDER BY round(sum(value), 4) DESC, user_id) AS k FROM events GROUP BY 1, 2) WHERE k <= 3")
def top_per_model(spark, sf):
    t = load(spark, sf, "events").groupBy("event_type", "user_id").agg(F.round(F.sum("value"), 4).alias("total"))
    return t.withColumn("k", F.row_number().over(W.partitionBy("event_type").orderBy(F.desc("total"), "user_id"))).where("k <= 3").drop("k")


_HEAD = "left(html, list_max(list_filter(range(2048, 8193), lambda i: strlen(left(html, i)) <= 8192)))"
_BINARY = " OR ".join(f"ends_with(string_split(lower(url), '?')[1], '{e}')" for e in checks.BINARY)


_FIREWALL = rf"""WITH i AS (SELECT p.page_id, p.url, h, TIMESTAMP '{NOW}' + to_days((p.page_id % 17 - 8)::INT) AS published, CASE WHEN p.page_id % 13 = 0 THEN 'http_404' END AS http, p.page_id % 5 <> 0 AS cross_source,
CASE WHEN strlen(html) <= 8192 THEN html ELSE {_HEAD} || CASE WHEN strlen({_HEAD}) < 8192 THEN chr(65533) ELSE '' END END AS html FROM {_NORMAL} JOIN pages p USING (page_id)),
c AS (SELECT *, CASE WHEN {_in(urls.TIER_S)} THEN 'S' WHEN {_in(urls.TIER_A)} OR regexp_matches(h, '\.(edu|gov|ac\.uk)$') THEN 'A' WHEN {_in(urls.TIER_B)} THEN 'B' ELSE 'C' END AS tier,
length(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '{checks.SPACE}+', ' ', 'g'))) AS clean, regexp_extract(html, '{checks.ERROR_PAGE}', 1) AS error FROM i),
r AS (SELECT page_id, tier, CASE WHEN published > TIMESTAMP '{NOW}' + INTERVAL 7 DAY THEN ['future_date:' || strftime(published, '%Y-%m-%d')] ELSE list_filter([
CASE WHEN tier <> 'S' THEN http END,
CASE WHEN tier = 'C' AND NOT cross_source THEN 'cross_verification_failed' END,
CASE WHEN tier IN ('A', 'S') OR http IS NOT NULL OR {_BINARY} THEN NULL WHEN error <> '' THEN 'error_pattern:' || regexp_replace(error[1:40], '^{checks.SPACE}+|{checks.SPACE}+$', '', 'g')
WHEN length(html) > 500 AND clean / length(html) < 0.10 THEN 'low_density:' || printf('%.2f', clean / length(html)) WHEN clean < 100 THEN 'too_short' END], lambda x: x IS NOT NULL) END AS reasons FROM c)
SELECT page_id, tier, len(reasons) = 0 AS passed, array_to_string(reasons, ',') AS reasons FROM r"""


@query(_FIREWALL)
def firewall_checks(spark, sf):
    """All five checks by tier; dates, HTTP results and cross-source results are input columns made of the page's number."""
    p, now = F.col("page_id"), F.lit(NOW).cast("timestamp")
    rows = load(spark, sf, "pages").select("page_id", "url", "html", (now + F.make_dt_interval((p % 17 - 8).cast("int"))).alias("published"), F.when(p % 13 == 0, "http_404").alias("http"), (p % 5 != 0).alias("cross_source"))
    return checks.verify(rows, now).select("page_id", "tier", "passed", F.array_join("reasons", ",").alias("reasons"))


@query(_FIREWALL)
def firewall(spark, sf):
    return firewall_checks(spark, sf)


@query("SELECT page_id FROM pages WHERE page_id NOT IN (SELECT page_id FROM pages WHERE page_id % 7 = 0) AND url NOT IN (SELECT url FROM pages WHERE page_id < 10)")
def history_anti_join(spark, sf):
    p = load(spark, sf, "pages")
    gone = p.where("page_id % 7 = 0").select("page_id")
    recent = p.where("page_id < 10").select("url")
    return p.join(gone, "page_id", "left_anti").join(F.broadcast(recent), "url", "left_anti").select("page_id")


_USERS = "SELECT event_type, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS users FROM events GROUP BY event_type"


@query(_USERS)
def union_of_all_arrays(spark, sf):
    """All users of each event type."""
    users = load(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("u")).distinct()
    return users.groupBy("event_type").agg(F.array_join(F.array_sort(F.collect_list("u")), ",").alias("users"))


@query(_USERS)
def union_of_arrays(spark, sf):
    return union_of_all_arrays(spark, sf)
