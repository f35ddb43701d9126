"""Queries over parsing, chunking, question types, streams and the generation loop."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import questions, urls
from millrace.operators import chunker, generation
from millrace.plans.core import query
from millrace.plans.text_queries import _HOST
from millrace.session import shared_dir
from millrace.sources import parsers
from millrace.sources.tables import load
from millrace.streaming import streams


@query()
def chunk_documents(spark, sf):
    return chunker.chunk_documents(load(spark, sf, "documents"), "doc_id", "text")


@query("SELECT doc_id, 1 AS one FROM documents WHERE length(trim(text)) >= 250 AND NOT regexp_matches(text, '(?m)^#{1,3}\\s+.+$') AND NOT regexp_matches(text, '(?im)^(Article|Art(ykuł)?\\.?|§|Section)\\s+\\d+') AND length(text) <= 2200 AND text = trim(text)")
def single_chunk_documents(spark, sf):
    """Untitled texts of one chunk's size come out as one chunk, untouched."""
    docs = load(spark, sf, "documents").where("length(text) <= 2200 AND text = trim(text)")
    made = chunker.chunk_documents(docs, "doc_id", "text").where("title = ''")
    return made.groupBy("doc_id").agg(F.count("*").alias("one")).where("one = 1").select("doc_id", F.col("one").cast("int").alias("one"))


@query()
def question_types(spark, sf):
    asked = load(spark, sf, "conversations").where("role = 'user'")
    return asked.select("conv_id", "turn", questions.question_type(F.col("text")).alias("question_type"), questions.difficulty(F.col("text")).alias("difficulty"))


@query()
def html_markdown(spark, sf):
    pages = load(spark, sf, "pages").select(F.col("page_id").cast("string").alias("path"), F.lit("html").alias("format"), F.col("html").cast("binary").alias("content"))
    return parsers.parse(pages).select(F.col("path").cast("long").alias("page_id"), "text", "error")


@query("SELECT page_id, trim(url) AS url, 'Page ' || page_id AS title, 'S' AS source_tier, true AS verified FROM pages WHERE trim(url) <> ''")
def feed_items(spark, sf):
    escaped = F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    rss = F.concat(F.lit("<rss><channel><item><title>Page "), F.col("page_id").cast("string"), F.lit("</title><link>"), escaped, F.lit("</link></item></channel></rss>"))
    pages = load(spark, sf, "pages").select("page_id", rss.alias("payload"), F.lit("S").alias("tier"))
    return parsers.feed(pages, "page_id", "payload", "tier").select("page_id", "url", "title", "source_tier", "verified")


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/millrace-stream-{uuid.uuid4().hex}"


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY ALL")
def stream_daily_cost(spark, sf):
    """Tumbling days of an event stream."""
    rows = streams.windowed_cost(streams.table_stream(spark, f"{sf}/events.parquet"), "ts", ["event_type"], "value")
    return streams.drain(rows, _folder(spark), "complete").withColumn("total", F.round("total", 4)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_first_seen(spark, sf):
    rows = streams.first_seen(streams.table_stream(spark, f"{sf}/events.parquet"), ["user_id", "event_type"], "ts", "90 days")
    return streams.drain(rows.select("user_id", "event_type"), _folder(spark))


@query(f"SELECT {_HOST} AS topic, count(DISTINCT url) AS n_urls FROM pages GROUP BY 1")
def stream_topic_merge(spark, sf):
    """Deliveries merged by topic, each URL once."""
    rows = streams.table_stream(spark, f"{sf}/pages.parquet").select(urls.host(F.col("url")).alias("topic"), "url")
    return streams.drain(streams.merge_new_urls(rows, "topic", "url"), _folder(spark), then=lambda t: t.groupBy("topic").agg(F.count("*").alias("n_urls")))


def _talks(spark, sf):
    """Conversations as rows in progress, with a question and an answer to append."""
    said = F.struct("turn", "role", F.col("text").alias("content"))
    talks = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(said)).alias("m"))
    history = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    return talks.select("conv_id", history.alias("history"), F.lit("why?").alias("question"), F.concat(F.lit("answer "), F.col("conv_id").cast("string")).alias("answer"), F.lit(0.9).alias("score"), F.lit("c").alias("critique"), (F.col("conv_id") % 4).alias("turn"), (F.col("conv_id") % 3).alias("retries"))


@query("SELECT conv_id, count(*) + 2 AS n_messages, 'answer ' || conv_id AS last_content, conv_id % 4 + 1 AS turn, true AS cleared, CASE WHEN conv_id % 4 + 1 < 3 THEN 'follow_up' ELSE 'write' END AS route FROM conversations GROUP BY conv_id")
def append_turn(spark, sf):
    t = generation.append_turn(_talks(spark, sf))
    return t.select("conv_id", F.size("history").cast("long").alias("n_messages"), F.element_at("history", -1)["content"].alias("last_content"), "turn", (F.col("question").isNull() & F.col("score").isNull()).alias("cleared"), generation.route_after_append(F.col("turn"), 3).alias("route"))


@query("SELECT DISTINCT conv_id, conv_id % 3 + 1 AS retries, 'answer ' || conv_id AS rejected FROM conversations")
def increment_retry(spark, sf):
    return generation.increment_retry(_talks(spark, sf)).select("conv_id", "retries", "rejected")


_JUDGED = "SELECT doc_id, quality::DOUBLE AS s, doc_id % 10 / 10.0 AS c, toxic::DOUBLE AS s2, doc_id % 7 / 7.0 AS c2 FROM labels"


@query(f"SELECT doc_id, round(CASE WHEN c < 0.7 AND c2 >= c THEN s2 ELSE s END, 6) AS score FROM ({_JUDGED})")
def judge_cascade(spark, sf):
    k = F.col("doc_id")
    return load(spark, sf, "labels").select("doc_id", F.round(generation.judge_cascade(F.col("quality").cast("double"), k % 10 / 10.0, F.col("toxic").cast("double"), k % 7 / 7.0), 6).alias("score"))


@query("SELECT doc_id, 'better ' || doc_id AS improved, 'worse' AS degraded FROM labels WHERE quality = 1")
def critique_pairs(spark, sf):
    """Pairs read out of raw critiques; rows without both tags go."""
    raw = F.concat(F.lit("x <Improved> better "), F.col("doc_id").cast("string"), F.lit("\n</improved> y"), F.when(F.col("quality") == 1, "<degraded>worse</DEGRADED>").otherwise("<degraded> </degraded>"))
    return load(spark, sf, "labels").select("doc_id", generation.critique_pair(raw).alias("p")).where("p is not null").select("doc_id", "p.improved", "p.degraded")


@query("SELECT doc_id, NOT (doc_id % 11 = 0 OR length(trim(text)) < 30 OR coalesce(quality >= 0.92, false)) AS revised FROM documents LEFT JOIN labels USING (doc_id)")
def revision_rules(spark, sf):
    rows = load(spark, sf, "documents").join(load(spark, sf, "labels"), "doc_id", "left")
    return rows.select("doc_id", (~generation.skips_revision(True, F.col("doc_id") % 11 == 0, F.col("text"), F.col("quality").cast("double"))).alias("revised"))


@query("SELECT doc_id, round(CASE WHEN doc_id < 10 THEN 0.2 ELSE least(0.2 * (1 + 2 * (doc_id % 10) / doc_id), 0.8) END, 6) AS rate FROM documents")
def critique_rates(spark, sf):
    k = F.col("doc_id")
    return load(spark, sf, "documents").select("doc_id", F.round(generation.critique_rate(k, k % 10, 0.2), 6).alias("rate"))


@query("""WITH RECURSIVE o AS (SELECT conv_id, length(text)::DOUBLE AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
e AS (SELECT conv_id, i, x AS v FROM o WHERE i = 1 UNION ALL SELECT o.conv_id, o.i, 0.3 * o.x + (1 - 0.3) * e.v FROM e JOIN o ON o.conv_id = e.conv_id AND o.i = e.i + 1)
SELECT conv_id, round(arg_max(v, i), 6) AS average FROM e GROUP BY conv_id""")
def moving_average(spark, sf):
    turns = load(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("x")))).alias("m"))
    return turns.select("conv_id", F.round(generation.moving_average(F.transform("m", lambda r: r["x"])), 6).alias("average"))


@query("SELECT doc_id, (text || chr(10) || chr(10) || 'other')[1:500] AS context FROM documents WHERE text IS NOT NULL AND text <> 'other'")
def answer_context(spark, sf):
    """The base chunk once, though it is among the contexts too."""
    text = F.col("text")
    return load(spark, sf, "documents").where("text is not null AND text <> 'other'").select("doc_id", generation.answer_context(text, F.array(text, F.lit("other"), text), 10).alias("context"))


@query()
def adversarial_rows(spark, sf):
    rows = generation.simulate_question(load(spark, sf, "documents"), ["doc_id", "source"], F.col("text"), lambda p: F.lit(None).cast("string"), "Who must comply?", "What is the weather?", 0.1)
    return rows.select("doc_id", "adversarial", "question")


_FALLBACKS = ("Which duties follow from this?", "Who is bound by it?", "From when does it apply?")
_PAIRS = "(CASE WHEN len({0}) < 2 THEN [lower({1})] ELSE list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1])) END)"
_SPLIT = "list_filter(regexp_split_to_array(lower({0}), '\\s+'), lambda x: x <> '')"


@query(f"""WITH d AS (SELECT doc_id, coalesce(text[1:60], '') AS first FROM documents),
m AS (SELECT doc_id, first, CASE doc_id % 4 WHEN 0 THEN first || ' now' WHEN 1 THEN NULL WHEN 2 THEN ' ' ELSE 'what about number ' || doc_id END AS said FROM d),
w AS (SELECT doc_id, first, nullif(trim(said), '') AS said, {_SPLIT.format("first")} AS a, {_SPLIT.format("trim(said)")} AS b FROM m),
p AS (SELECT doc_id, said, {_PAIRS.format("a", "first")} AS x, {_PAIRS.format("b", "said")} AS y FROM w)
SELECT doc_id, CASE WHEN said IS NULL OR len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) >= 0.75
  THEN {list(_FALLBACKS)}[(doc_id % 3 + 1)::INT] ELSE said END AS question FROM p""")
def follow_ups(spark, sf):
    """Second questions of an injected model: some repeat the first, some are missing; those are replaced by fixed ones."""
    d = load(spark, sf, "documents").select("doc_id", F.coalesce(F.substring("text", 1, 60), F.lit("")).alias("first"))
    kind = F.col("doc_id") % 4
    model = lambda prompt: F.when(kind == 0, F.concat(prompt, F.lit(" now"))).when(kind == 2, " ").when(kind == 3, F.concat(F.lit("what about number "), F.col("doc_id").cast("string")))
    return generation.follow_up(d, F.col("first"), model, F.array("first"), list(_FALLBACKS), F.col("doc_id")).select("doc_id", "question")


@query("""WITH d AS (SELECT doc_id, text[1:200] AS base, [source, text[1:200], lang, source] AS extra FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, array_to_string(list_concat([base], list_filter([source_, lang_], lambda x: x <> base)), chr(10) || chr(10))[1:500] AS context
  FROM (SELECT *, extra[1] AS source_, CASE WHEN extra[3] = extra[1] THEN base ELSE extra[3] END AS lang_ FROM d)),
a AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'Brak danych w dyrektywie.' ELSE 'Because: ' || context END AS answer FROM c)
SELECT doc_id, md5(answer) AS answer, CASE WHEN doc_id % 5 = 0 THEN (doc_id % 7 = 0)::INT::DOUBLE WHEN length(trim(answer)) < 30 THEN 0.0 END AS score FROM a""")
def generated_answers(spark, sf):
    """Answers of an injected model from each document's context, the refusal where it gives none, and the score that needs no judge."""
    d = load(spark, sf, "documents").where("text IS NOT NULL")
    d = d.select("doc_id", F.substring("text", 1, 200).alias("base"), F.array("source", F.substring("text", 1, 200), "lang", "source").alias("extra"))
    model = lambda context: F.when(F.col("doc_id") % 7 != 0, F.concat(F.lit("Because: "), context))
    rows = generation.generate_answer(d, "base", "extra", model, "Brak danych w dyrektywie.", 100)
    score = generation.judge_fast_path(F.col("doc_id") % 5 == 0, F.col("answer"))
    return rows.select("doc_id", F.md5("answer").alias("answer"), score.alias("score"))
