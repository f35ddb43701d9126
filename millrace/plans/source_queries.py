"""Queries of the connectors on answers to the pages of a table, of polling rules, of batch results, and of stateful streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from millrace.functions import rules
from millrace.plans.connector_answers import ANSWERS
from millrace.plans.core import query
from millrace.session import shared_dir
from millrace.sources import connector_source, connectors
from millrace.sources.tables import load
from millrace.streaming import keyed, shedding, streams


def _folder(spark, name):
    return f"{shared_dir(spark)}/millrace-{name}-{uuid.uuid4().hex}"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_EXPECTED = ", ".join(
    f"({k}, '{a.source}', '{a.layer}', {_quoted(a.url)}, {_quoted(a.title)}, '{a.published_at}', '{a.tier}', {a.verified}, {_quoted(a.snippet)})"
    for k, a in enumerate(ANSWERS)
)
#: A page of the table asks the source of its number; each answer holds one item, or none where it is broken.
_BROKEN = "page_id % 97 = 13"
_ITEMS = f"""e(k, source, layer, url, title, published_at, tier, verified, snippet) AS (VALUES {_EXPECTED})
SELECT source, layer, lpad(page_id::VARCHAR, 12, '0') AS mark, 0 AS position, replace(e.url, '{{n}}', page_id::VARCHAR) AS url,
  replace(e.title, '{{n}}', page_id::VARCHAR) AS title, published_at, tier, verified, replace(snippet, '{{n}}', page_id::VARCHAR) AS snippet
FROM pages JOIN e ON k = page_id % {len(ANSWERS)} WHERE NOT {_BROKEN}"""


def _answers(spark, sf):
    """(source, mark, payload): what the sources answer to a request for each page of the table."""
    n = F.col("page_id").cast("string")
    pick = lambda field: F.get(F.array(*[F.lit(getattr(a, field)) for a in ANSWERS]), (F.col("page_id") % len(ANSWERS)).cast("int"))
    payload = F.when(F.expr(_BROKEN), F.substring(pick("payload"), 1, 40)).otherwise(F.replace(pick("payload"), F.lit("{n}"), n))
    return load(spark, sf, "pages").select(pick("source").alias("source"), F.lpad(n, 12, "0").alias("mark"), payload.alias("payload"))


@query(f"WITH {_ITEMS}".replace("lpad(page_id::VARCHAR, 12, '0') AS mark, ", ""))
def connector_items(spark, sf):
    """Items of the sources' answers, as rows."""
    return connectors.sources(_answers(spark, sf))


def _written_answers(spark, sf, folder, low=0, high=1):
    """Adds the answers to a part of the table's pages to an archive."""
    most = load(spark, sf, "pages").agg(F.max("page_id")).first()[0] + 1
    part = F.col("mark").cast("long") / most
    rows = _answers(spark, sf).where((part >= low) & (part < high))
    rows.repartition("source").write.partitionBy("source").mode("append").parquet(f"{folder}/answers")


@query(f"WITH {_ITEMS}")
def connector_batch(spark, sf):
    """The connectors as a data source: every source's pages, a partition or more each."""
    folder = _folder(spark, "archive")
    _written_answers(spark, sf, folder)
    kind = connector_source.connector_format("connector_pages", connector_source.FolderArchive(f"{folder}/answers"), per_partition=50)
    return connector_source.items(spark, kind)


@query(f"WITH {_ITEMS}")
def connector_stream(spark, sf):
    """The same as a stream that starts three times from one checkpoint, each time after more pages, with a clock that moves on."""
    folder = _folder(spark, "ticks")
    clock = shedding.SharedNumber(f"{folder}/clock", 0)
    archive = connector_source.FolderArchive(f"{folder}/answers")
    kind = connector_source.connector_format("connector_ticks", archive, clock=clock, per_partition=50, control=f"{folder}/control")
    for k in range(3):
        _written_answers(spark, sf, folder, k / 3, (k + 1) / 3)
        clock.put(k * 10_000)
        rows = streams.drain(connector_source.item_stream(spark, kind), folder)
    return rows


_LISTED = ", ".join(f"('{name}', '{s.layer}', '{s.tier}', {s.poll})" for name, s in connectors.SPECS.items())


@query(f"""WITH s(source, layer, tier, poll) AS (VALUES {_LISTED}), {_ITEMS.split("SELECT source")[0]},
i AS (SELECT e.source FROM pages JOIN e ON k = page_id % {len(ANSWERS)} WHERE NOT {_BROKEN})
SELECT layer, count(DISTINCT source) AS n_sources, count(*) AS n_items, min(poll)::INT AS fastest, max(poll)::INT AS slowest
FROM i JOIN s USING (source) GROUP BY layer""")
def connector_layers(spark, sf):
    """Items and sources by layer, with the shortest and longest interval of the sources that answered."""
    polls = spark.createDataFrame([(n, s.poll) for n, s in connectors.SPECS.items()], "source string, poll int")
    rows = connectors.sources(_answers(spark, sf)).join(F.broadcast(polls), "source").groupBy("layer")
    return rows.agg(F.countDistinct("source").alias("n_sources"), F.count("*").alias("n_items"), F.min("poll").alias("fastest"), F.max("poll").alias("slowest"))


@query("""WITH i AS (SELECT 's' || page_id % 7 AS source, lpad((page_id * 37 % 1000)::VARCHAR, 4, '0') AS id FROM pages), m AS (SELECT 's' || k AS source, lpad((k * 150)::VARCHAR, 4, '0') AS mark FROM range(5) t(k))
SELECT source, count(*) FILTER (mark IS NULL OR id > mark) AS fresh, max(CASE WHEN mark IS NULL OR id > mark THEN id ELSE mark END) AS mark FROM i LEFT JOIN m USING (source) GROUP BY source""")
def high_water(spark, sf):
    """Items beyond each source's mark, and the marks afterwards."""
    items = load(spark, sf, "pages").select(F.concat(F.lit("s"), (F.col("page_id") % 7).cast("string")).alias("source"), F.lpad((F.col("page_id") * 37 % 1000).cast("string"), 4, "0").alias("id"))
    marks = spark.range(5).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("source"), F.lpad((F.col("id") * 150).cast("string"), 4, "0").alias("mark"))
    seen, after = connectors.newer(items, marks, "id")
    return after.join(seen.groupBy("source").agg(F.count("*").alias("fresh")), "source", "left").select("source", F.coalesce("fresh", F.lit(0)).alias("fresh"), "mark")


@query("""WITH c AS (SELECT page_id, 'old' || page_id AS payload, 'e' || page_id AS etag FROM pages WHERE page_id % 2 = 0), a AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 304 ELSE 200 END AS status, 'new' || page_id AS payload, 'f' || page_id AS etag FROM pages WHERE page_id % 3 = 0)
SELECT page_id AS source, CASE WHEN a.status IS NULL OR a.status = 304 THEN c.payload ELSE a.payload END AS payload, CASE WHEN a.status IS NULL OR a.status = 304 THEN c.etag ELSE a.etag END AS etag, NOT (a.status IS NULL OR a.status = 304) AS changed FROM c FULL JOIN a USING (page_id)""")
def conditional_fetch(spark, sf):
    """Cached answers stand where the source says that nothing changed."""
    p = load(spark, sf, "pages").select(F.col("page_id").alias("source"))
    text = lambda s: F.concat(F.lit(s), F.col("source").cast("string"))
    cache = p.where("source % 2 = 0").select("source", text("old").alias("payload"), text("e").alias("etag"))
    answers = p.where("source % 3 = 0").select("source", F.when(F.col("source") % 4 == 0, 304).otherwise(200).alias("status"), text("new").alias("payload"), text("f").alias("etag"))
    return connectors.conditional(cache, answers)


@query("""SELECT page_id, (status IS NULL OR status IN (429, 503) OR status >= 500) AND attempt < 3 AS again, greatest(2.0, least(2.0 ** (attempt - 1), 30.0))::DOUBLE AS wait
FROM (SELECT page_id, [200, 404, 429, 500, 503, NULL][(page_id % 6 + 1)::INT] AS status, page_id % 4 + 1 AS attempt FROM pages)""")
def retry_rules(spark, sf):
    p = F.col("page_id")
    status, attempt = F.get(F.array(*[F.lit(x) for x in (200, 404, 429, 500, 503, None)]), (p % 6).cast("int")), p % 4 + 1
    return load(spark, sf, "pages").select("page_id", connectors.retried(status, attempt).alias("again"), connectors.wait_seconds(attempt).alias("wait"))


@query()
def source_polls(spark, sf):
    """Circuit breaker and adaptive interval over the event table: users are sources, errors are failed polls."""
    rows = streams.table_stream(spark, f"{sf}/events.parquet").select((F.col("user_id") % 40).alias("source"), F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("ok"), F.col("event_type").isin("purchase", "signup").alias("found"))
    return streams.drain(streams.polls(rows, "source", "ts", "ok", "found"), _folder(spark, "polls"))


@query()
def adaptive_thresholds(spark, sf):
    """Thresholds after every tenth score of a user."""
    rows = streams.table_stream(spark, f"{sf}/events.parquet").select((F.col("user_id") % 20).alias("user"), F.col("event_id"), (F.col("value") % 1.0).alias("score"))
    return streams.drain(streams.adaptive_threshold(rows, "user", "event_id", "score"), _folder(spark, "thresholds"))


@query("""SELECT user_id AS session, event_type AS entry, value, (ts + INTERVAL 24 HOURS)::VARCHAR[1:19] AS expires
FROM (SELECT user_id, event_type, value, ts::TIMESTAMP AS ts, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events)
WHERE r = 1""".replace("(ts + INTERVAL 24 HOURS)::VARCHAR[1:19]", "strftime(ts + INTERVAL 24 HOURS, '%Y-%m-%d %H:%M:%S')"))
def session_entries(spark, sf):
    """Each session's entries, the last value of each (ties go to the greater event), with when they run out."""
    keyed.keep_state_in_rocksdb(spark)
    rows = streams.table_stream(spark, f"{sf}/events.parquet")
    folder = _folder(spark, "entries")
    out = streams.drain(keyed.session_entries(rows, "user_id", "event_type", "value", "event_id", "ts", late="100000 hours"), folder)
    last = out.groupBy("session", "entry").agg(F.max_by(F.struct("value", "expires"), F.struct("expires", "id")).alias("x"))
    return last.select("session", "entry", "x.value", F.date_format("x.expires", "yyyy-MM-dd HH:mm:ss").alias("expires"))


@query("SELECT page_id % 7 AS topic, count(DISTINCT url) AS n_urls, count(DISTINCT url) - 1 AS last FROM pages GROUP BY 1")
def topic_url_state(spark, sf):
    """URLs by topic, each a row of state; the stream runs twice over pages that are delivered twice."""
    keyed.keep_state_in_rocksdb(spark)
    folder = _folder(spark, "topics")
    pages = load(spark, sf, "pages").select((F.col("page_id") % 7).alias("topic"), "url", "page_id")
    for part in (pages.where("page_id % 3 > 0"), pages):
        part.select("topic", "url").write.mode("append").parquet(f"{folder}/in")
        rows = spark.readStream.schema("topic long, url string").parquet(f"{folder}/in")
        out = streams.drain(keyed.topic_urls(rows, "topic", "url"), folder)
    return out.groupBy("topic").agg(F.count("url").alias("n_urls"), F.max("position").alias("last"))


@query("""WITH m AS (SELECT event_type AS subject, event_id AS id, ts::TIMESTAMP AS moment, max(ts::TIMESTAMP) OVER (PARTITION BY event_type) AS newest,
  row_number() OVER (PARTITION BY event_type ORDER BY ts::TIMESTAMP DESC, event_id DESC) AS r FROM events)
SELECT subject, id FROM m WHERE r <= 100 AND moment >= newest - INTERVAL 12 HOURS""")
def bus_retention(spark, sf):
    """What a bus still holds of each subject: the newest hundred messages, none older than twelve hours before the newest."""
    keyed.keep_state_in_rocksdb(spark)
    rows = streams.table_stream(spark, f"{sf}/events.parquet")
    changes = streams.drain(keyed.retained(rows, "event_type", "event_id", "ts", 100, 12), _folder(spark, "retention"))
    held = changes.groupBy("subject", "id").agg(F.count_if(F.col("change") == "received").alias("came"), F.count_if(F.col("change") != "received").alias("went"))
    return held.where("came > went").select("subject", "id")


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def bus_messages(spark, sf):
    """Events published by type and read back by a subscriber of one."""
    folder = _folder(spark, "bus")
    rows = streams.table_stream(spark, f"{sf}/events.parquet").select("event_id", "user_id", "value", "event_type")
    streams.publish(rows, "event_type", f"{folder}/bus", f"{folder}/sent").awaitTermination()
    return streams.drain(streams.subscribe(spark, f"{folder}/bus", "purchase", "event_id long, user_id long, value double"), f"{folder}/read")


@query("SELECT count(*) AS n, round(sum(value), 4) AS total FROM events")
def flushed_costs(spark, sf):
    """A stream of costs flushed to a table in batches, and what the table then holds."""
    folder = _folder(spark, "costs")
    streams.append_batches(streams.table_stream(spark, f"{sf}/events.parquet"), f"{folder}/table", f"{folder}/state").awaitTermination()
    return spark.read.parquet(f"{folder}/table").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


_LINES = """l AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '{broken' WHEN doc_id % 10 = 1 THEN '{"custom_id": "' || doc_id || '", "response": {"status_code": 500, "body": {"error": "busy"}}}'
  ELSE '{"custom_id": "' || doc_id || '", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "said ' || doc_id || '"}}], "usage": {"prompt_tokens": ' || doc_id % 900 || ', "completion_tokens": ' || doc_id % 300 || '}}}}' END AS line FROM documents)"""


@query(f"""WITH {_LINES}, j AS (SELECT CASE WHEN json_valid(line) THEN line::JSON END AS j FROM l), r AS (SELECT j->>'$.custom_id' AS id, (j->>'$.response.status_code')::INT AS status, j FROM j WHERE j IS NOT NULL)
SELECT id, CASE WHEN status = 200 THEN j->>'$.response.body.choices[0].message.content' ELSE '' END AS content, CASE WHEN status <> 200 THEN coalesce(j->>'$.response.body.error', 'unknown error') END AS error,
  round(CASE WHEN status = 200 THEN (j->>'$.response.body.usage.prompt_tokens')::INT / 1e6 * 0.15 + (j->>'$.response.body.usage.completion_tokens')::INT / 1e6 * 0.60 ELSE 0 END, 9) AS cost FROM r""")
def batch_results(spark, sf):
    """Lines of a batch's answers: broken lines are left out, failed requests keep their error."""
    d = F.col("doc_id").cast("string")
    good = F.concat(F.lit('{"custom_id": "'), d, F.lit('", "response": {"status_code": 200, "body": {"choices": [{"message": {"content": "said '), d, F.lit('"}}], "usage": {"prompt_tokens": '), (F.col("doc_id") % 900).cast("string"), F.lit(', "completion_tokens": '), (F.col("doc_id") % 300).cast("string"), F.lit("}}}}"))
    failed = F.concat(F.lit('{"custom_id": "'), d, F.lit('", "response": {"status_code": 500, "body": {"error": "busy"}}}'))
    line = F.when(F.col("doc_id") % 10 == 0, "{broken").when(F.col("doc_id") % 10 == 1, failed).otherwise(good)
    return _results(load(spark, sf, "documents").select(line.alias("line")))


def _results(lines):
    schema = "custom_id string, response struct<status_code: int, body: struct<error: string, model: string, choices: array<struct<message: struct<content: string>>>, usage: struct<prompt_tokens: long, completion_tokens: long>>>"
    read = lines.select(F.from_json("line", schema).alias("r")).where("r.custom_id is not null")
    ok, body = F.col("r.response.status_code") == 200, F.col("r.response.body")
    cost = rules.batch_cost(F.coalesce(body["usage"]["prompt_tokens"], F.lit(0)), F.coalesce(body["usage"]["completion_tokens"], F.lit(0)), 0.15, 0.60)
    content = F.coalesce(F.get(body["choices"], F.lit(0))["message"]["content"], F.lit(""))
    return read.select(F.col("r.custom_id").alias("id"), F.when(ok, content).otherwise("").alias("content"), F.when(~ok, F.coalesce(body["error"], F.lit("unknown error"))).alias("error"), F.round(F.when(ok, cost).otherwise(0.0), 9).alias("cost"))


@query(r"""WITH d AS (SELECT o_orderkey, CASE (o_orderkey % 4)::INT WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 2 THEN strftime(o_orderdate, '%Y%m%d') ELSE 'soon' END AS raw FROM orders)
SELECT coalesce(try_strptime(raw, ['%Y-%m-%d', '%d/%m/%Y', '%Y%m%d'])::DATE, DATE '2024-01-01')::VARCHAR AS day, count(*) AS n FROM d GROUP BY 1""")
def date_fallback(spark, sf):
    """Dates in several formats; what is none falls back to a fixed day."""
    day = lambda f: F.date_format("o_orderdate", f)
    raw = F.get(F.array(day("yyyy-MM-dd"), day("dd/MM/yyyy"), day("yyyyMMdd"), F.lit("soon")), (F.col("o_orderkey") % 4).cast("int"))
    parsed = F.coalesce(rules.parsed_date(raw, ("yyyy-MM-dd", "dd/MM/yyyy", "yyyyMMdd")).cast("date"), F.lit("2024-01-01").cast("date"))
    return load(spark, sf, "orders").groupBy(parsed.cast("string").alias("day")).agg(F.count("*").alias("n"))
