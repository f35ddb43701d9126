"""Queries of memory, evaluation, review and run state; the tables stand in for the reference's own."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import rules, scores, text
from millrace.operators import dataset, evaluation, memory, mutations, retrieval, state
from millrace.plans.core import query
from millrace.plans.dataset_queries import conversations, samples
from millrace.plans.dataset_queries import _SAMPLE
from millrace.plans.retrieval_queries import VEC, _vector, vector_queries
from millrace.sources.tables import load

# Memory: every vector is a fact, its content the document of the same id.
_FACTS = "facts AS (SELECT vec_id AS fact, vec_id * 60 AS created_at, text AS content FROM embeddings JOIN documents ON doc_id = vec_id)"
_NEG = "list_has_any(regexp_split_to_array(lower(content), '\\s+'), [" + ", ".join(f"'{w}'" for w in memory.NEGATIONS) + "])"


def _facts(spark, sf):
    docs = load(spark, sf, "documents").select(F.col("doc_id").alias("fact"), F.col("text").alias("content"))
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("fact"), (F.col("vec_id") * 60).alias("created_at"), F.col("embedding").alias("vector")).join(docs, "fact")


@query(f"WITH {VEC} SELECT query, vec_id AS fact, similarity FROM vt WHERE similarity >= 0.2")
def memory_search(spark, sf):
    """The 20 nearest facts at 0.2 or more, for every vector whose id is divisible by 20."""
    return memory.search(load(spark, sf, "embeddings").select(F.col("vec_id").alias("fact"), F.col("embedding").alias("vector")), vector_queries(spark, sf), 20, 0.2)


@query(f"""WITH {VEC}, a AS (SELECT query, vec_id AS fact, similarity, 1000000 - vec_id * 60 AS age FROM vt), b AS (SELECT *, max(age) OVER (PARTITION BY query) AS oldest FROM a),
c AS (SELECT query, fact, round(0.8 * similarity + 0.2 * (1 - age / oldest), 6) AS relevance FROM b)
SELECT query, fact, relevance FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY relevance DESC, fact) AS k FROM c) WHERE k <= 10""")
def memory_recall(spark, sf):
    """Candidates rescaled by age, the ten best."""
    facts = load(spark, sf, "embeddings").select(F.col("vec_id").alias("fact"), (F.col("vec_id") * 60).alias("created_at"))
    return memory.recalled(_vector(spark, sf).withColumnRenamed("vec_id", "fact"), facts, F.lit(1_000_000), 10)


@query(f"WITH {VEC}, {_FACTS}, n AS (SELECT fact, {_NEG} AS neg FROM facts) SELECT query, vec_id AS fact, similarity FROM vt JOIN n a ON a.fact = vec_id JOIN n b ON b.fact = query WHERE query <> vec_id AND a.neg <> b.neg AND similarity >= 0.2")
def memory_contradictions(spark, sf):
    """Near facts of which one negates and the other does not."""
    found = _vector(spark, sf).withColumnRenamed("vec_id", "fact").where("similarity >= 0.2")
    return memory.contradictions(found, _facts(spark, sf))


@query("""WITH b AS (SELECT ('0x' || md5('c' || c_custkey)[1:8])::BIGINT AS point_id, c_acctbal AS payload FROM customer), n AS (SELECT ('0x' || md5('c' || o_custkey)[1:8])::BIGINT AS point_id, arg_max(o_totalprice, o_orderkey) AS payload FROM orders GROUP BY 1)
SELECT * FROM n UNION ALL SELECT * FROM b WHERE point_id NOT IN (SELECT point_id FROM n)""")
def vector_upsert(spark, sf):
    """Points by the number of their id's md5: a customer's last order replaces the balance."""
    point = lambda c: memory.point_id(F.concat(F.lit("c"), F.col(c).cast("string"))).alias("point_id")
    base = load(spark, sf, "customer").select(point("c_custkey"), F.col("c_acctbal").alias("payload"))
    return memory.upsert_points(base, load(spark, sf, "orders").select(point("o_custkey"), F.col("o_totalprice").alias("payload"), "o_orderkey"), "o_orderkey")


@query("""WITH s AS (SELECT conv_id, array_to_string(list(text ORDER BY turn), ' | ') AS s FROM conversations WHERE role = 'user' GROUP BY conv_id)
SELECT conv_id, CASE WHEN length(s) > 200 THEN s[1:200] || '...' ELSE s END AS summary FROM s""")
def session_summaries(spark, sf):
    return memory.summaries(load(spark, sf, "conversations").where("role = 'user'"), "conv_id", "turn", "text", 200)


@query("SELECT user_id, count(*) AS n FROM events WHERE ts + INTERVAL 24 HOURS > TIMESTAMP '2024-01-20 12:00:00' AND ts <= TIMESTAMP '2024-01-20 12:00:00' GROUP BY user_id")
def live_sessions(spark, sf):
    """Entries of session memory at a fixed time that are younger than a day."""
    now = F.lit("2024-01-20 12:00:00").cast("timestamp")
    entries = load(spark, sf, "events").withColumn("stored_at", F.col("ts").cast("timestamp"))
    return memory.live(entries.where(F.col("stored_at") <= now), now, F.expr("INTERVAL 24 HOURS")).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT doc_id, sha256(text || source)[1:16] AS fact_id FROM documents")
def fact_ids(spark, sf):
    return load(spark, sf, "documents").select("doc_id", memory.fact_id(F.col("text"), F.col("source")).alias("fact_id"))


# Evaluation: every fifth conversation is held out; its first question and answer are judged.
_ANSWERS = """r AS (SELECT conv_id AS id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'assistant') AS answer, (conv_id * 37 % 101) / 100 AS judge_score FROM conversations GROUP BY conv_id),
h AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY id) - 1 AS idx FROM r) WHERE idx % 5 = 0),
j AS (SELECT id, question, answer, round(CASE WHEN length(trim(coalesce(answer, ''))) < 20 THEN 0.0 ELSE judge_score END, 3) AS s FROM h WHERE trim(coalesce(question, '')) <> '')"""
_REPORT = "SELECT count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 4) AS median, list_sort(list(s))[(count(*) // 4 + 1)::INT] AS p25, list_sort(list(s))[(count(*) * 3 // 4 + 1)::INT] AS p75, round(100 * count(*) FILTER (s >= 0.88) / count(*), 1) AS pass_rate, round(100 * count(*) FILTER (s < 0.70) / count(*), 1) AS fail_rate"


def _answers(spark, sf):
    first = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    rows = load(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(first("user").alias("question"), first("assistant").alias("answer"))
    return dataset.split(rows, "id", 5, 0.1).where("holdout").withColumn("judge_score", F.col("id") * 37 % 101 / 100)


@query(f"WITH {_ANSWERS} {_REPORT}, round(100 * count(*) FILTER (contains(answer, 'the')) / count(*), 1) AS refusal_rate, round(avg(length(answer)), 0) AS mean_length FROM j")
def eval_report(spark, sf):
    """Report of the held-out conversations; the word 'the' stands in for a refusal."""
    return evaluation.evaluation_report(_answers(spark, sf), "the")


@query(f"WITH {_ANSWERS} SELECT id, question[1:200] AS question, answer[1:300] AS answer, s AS score FROM j WHERE s < 0.7 OR s > 0.9 ORDER BY id LIMIT 5")
def eval_examples(spark, sf):
    return evaluation.examples(_answers(spark, sf))


_TALKS = "m AS (SELECT conv_id, count(*) FILTER (role = 'user') AS users, arg_min(text, turn) FILTER (role = 'assistant') AS first, round((conv_id * 37 % 101) / 100, 3) AS s, ['cfo', 'prawnik', NULL][(conv_id % 3 + 1)::INT] AS perspective FROM conversations GROUP BY conv_id)"


@query(f"""WITH {_TALKS}, q AS ({_REPORT} FROM m)
SELECT 'dataset' AS section, unnest(['n_records', 'multi_turn_count', 'multi_turn_pct', 'avg_response_len']) AS name, unnest([count(*)::DOUBLE, count(*) FILTER (users > 1), round(100 * count(*) FILTER (users > 1) / count(*), 1), round(avg(length(first)), 0)]) AS value FROM m
UNION ALL SELECT 'quality', unnest(['n', 'mean', 'median', 'p25', 'p75', 'pass_rate', 'fail_rate']), unnest([n::DOUBLE, mean, median, p25, p75, pass_rate, fail_rate]) FROM q
UNION ALL SELECT 'perspective', coalesce(perspective, 'unknown'), count(*)::DOUBLE FROM m GROUP BY ALL""")
def training_card(spark, sf):
    rows = conversations(spark, sf).withColumn("score", F.round(F.col("conv_id") * 37 % 101 / 100, 3))
    return evaluation.training_card(rows.withColumn("perspective", F.get(F.array(F.lit("cfo"), F.lit("prawnik"), F.lit(None)), (F.col("conv_id") % 3).cast("int"))), "score", "perspective")


_ASCII = r"regexp_replace(translate(text, 'łęŁĘ', 'leLE'), '[^\x00-\x7F§–—…„“”’‘«»¿¡°€]', 'x', 'g')"
_DENSE = " + ".join(f"{w} * len(regexp_extract_all(a, '{p.translate(str.maketrans('łę', 'le'))}'))" for w, p in text.DENSE)


@query(f"""WITH f AS (SELECT doc_id, text, {_ASCII} AS a, row_number() OVER (ORDER BY doc_id) AS k FROM documents ORDER BY doc_id LIMIT 50),
w AS (SELECT list_filter(regexp_extract_all(lower(array_to_string(list(text[1:10000] ORDER BY doc_id) FILTER (k <= 30), ' ')), '[\\p{{L}}\\p{{N}}_]+'), lambda x: regexp_full_match(x, '[{text.RICH_LETTERS}]{{3,}}')) AS ws FROM f),
v AS (SELECT len(list_distinct(ws)) / len(ws) AS rich, (SELECT avg(least(({_DENSE}) / (greatest(length(text), 1) / 100.0) / 10.0, 1.0)) FROM f) AS dense FROM w),
s AS (SELECT avg(length(text)) FILTER (length(text) > 0) AS len, avg((doc_id % 3 = 0)::INT) AS heads, count(*) AS n FROM documents)
SELECT n, round(len, 1) AS length, round(rich, 3) AS richness, round(dense, 3) AS density, round(heads, 2) AS headings,
  round(greatest(0.72, least(0.82 + CASE WHEN len < 250 THEN -0.04 WHEN len > 900 THEN 0.02 ELSE 0 END + CASE WHEN rich > 0.65 THEN 0.02 WHEN rich < 0.35 THEN -0.02 ELSE 0 END + CASE WHEN dense > 0.6 THEN 0.02 WHEN dense < 0.2 THEN -0.03 ELSE 0 END, 0.92)), 2)::DOUBLE AS threshold,
  CASE WHEN len < 300 THEN 2 ELSE 3 END AS max_turns, CASE WHEN dense < 0.15 THEN 0.07 ELSE 0.10 END::DOUBLE AS adversarial FROM s, v""")
def calibration(spark, sf):
    """Thresholds that follow from the chunks; the reference samples the first 30 and 50 for richness and density."""
    return evaluation.calibration(load(spark, sf, "documents"), "doc_id", "text", F.col("doc_id") % 3 == 0)


_UNIT = "u AS (SELECT label, vec_id, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings)"


@query(f"WITH {_UNIT}, m AS (SELECT label, pos, avg(x) AS m FROM u GROUP BY label, pos) SELECT label, (pos - 1)::BIGINT AS pos, round(m / sqrt(sum(m * m) OVER (PARTITION BY label)), 5) AS value FROM m")
def unit_centroids(spark, sf):
    return evaluation.centroids(load(spark, sf, "embeddings"), "label", "embedding").select("label", "pos", F.round("value", 5).alias("value"))


@query("""WITH e AS (SELECT label, vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT a.label, (SELECT count(*) FROM e c WHERE c.label = a.label) AS n, round(avg(1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))), 5) AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label""")
def pairwise_distance(spark, sf):
    """Mean distance of a label's vectors from the sum of its unit vectors; the SQL forms all pairs."""
    return evaluation.mean_distance(load(spark, sf, "embeddings"), "label", "embedding").withColumn("distance", F.round("distance", 5))


@query("SELECT page_id % 40 AS topic, round(avg(coalesce([1.0, 0.8, 0.6, NULL][(page_id // 40 % 4 + 1)::INT], 0.3)), 6)::DOUBLE AS authority FROM pages GROUP BY 1")
def source_authority(spark, sf):
    tier = F.get(F.array(*[F.lit(x) for x in (1.0, 0.8, 0.6, None)]), (F.floor(F.col("page_id") / 40) % 4).cast("int"))
    return evaluation.source_authority(load(spark, sf, "pages").withColumn("topic", F.col("page_id") % 40), "topic", tier)


@query("""WITH p AS (SELECT page_id % 40 AS topic, url, (page_id // 40 * 7) % 4 AS rank, '2024-0' || (page_id % 9 + 1) || '-0' || (page_id % 7 + 1) AS published FROM pages)
SELECT topic, ['S', 'A', 'B', 'C'][(min(rank) + 1)::INT] AS best_tier, arg_max(url, published || '/' || url) AS latest FROM p GROUP BY topic""")
def best_sources(spark, sf):
    """Best tier of a topic's sources, and the latest of them by the text of its date (ties by URL)."""
    p = F.col("page_id")
    day = F.concat(F.lit("2024-0"), (p % 9 + 1).cast("string"), F.lit("-0"), (p % 7 + 1).cast("string"))
    rows = load(spark, sf, "pages").select((p % 40).alias("topic"), "url", (F.floor(p / 40) * 7 % 4).alias("rank"), day.alias("published"))
    best = F.get(F.array(*map(F.lit, "SABC")), F.min("rank").cast("int"))
    return rows.groupBy("topic").agg(best.alias("best_tier"), F.max_by("url", F.struct("published", "url")).alias("latest"))


_TARGETS = "t AS (SELECT doc_id, unnest(CASE (doc_id % 4)::INT WHEN 0 THEN ['all'] WHEN 1 THEN ['gpt', 'llama'] WHEN 2 THEN ['llama'] ELSE ['phi', 'gpt', 'llama'] END) AS model, doc_id * 7919 % 1000 AS score FROM documents)"


@query(f"WITH {_TARGETS}, r AS (SELECT *, count(*) OVER (PARTITION BY model) AS n, row_number() OVER (PARTITION BY model ORDER BY score DESC, doc_id) AS k FROM t) SELECT model, n, k::INT AS k, doc_id FROM r WHERE k <= 3")
def topics_by_model(spark, sf):
    """Topics by model target (none means all): count and the three best."""
    targets = F.get(F.array(F.array().cast("array<string>"), F.array(F.lit("gpt"), F.lit("llama")), F.array(F.lit("llama")), F.array(F.lit("phi"), F.lit("gpt"), F.lit("llama"))), (F.col("doc_id") % 4).cast("int"))
    rows = load(spark, sf, "documents").select("doc_id", (F.col("doc_id") * 7919 % 1000).alias("score"), targets.alias("targets"))
    rows = rows.select("doc_id", "score", F.explode(F.when(F.size("targets") == 0, F.array(F.lit("all"))).otherwise(F.col("targets"))).alias("model"))
    counts = rows.groupBy("model").agg(F.count("*").alias("n"))
    best = rows.withColumn("k", F.row_number().over(W.partitionBy("model").orderBy(F.desc("score"), "doc_id"))).where("k <= 3")
    return best.join(counts, "model").select("model", "n", "k", "doc_id")


@query("SELECT o_custkey AS workflow, count(*) AS chunks, count(*) FILTER (o_orderstatus = 'F') AS written, round(coalesce(avg(o_totalprice) FILTER (o_totalprice > 200000), 0), 4) AS avg_score FROM orders GROUP BY 1")
def workflow_rollup(spark, sf):
    """Counts of a workflow, and the mean of the scores that count (here: prices above a mark)."""
    price = F.when(F.col("o_totalprice") > 200000, F.col("o_totalprice"))
    return load(spark, sf, "orders").groupBy(F.col("o_custkey").alias("workflow")).agg(F.count("*").alias("chunks"), F.count_if(F.col("o_orderstatus") == "F").alias("written"), F.round(F.coalesce(F.avg(price), F.lit(0.0)), 4).alias("avg_score"))


@query("SELECT domain, last_seen::VARCHAR AS last_seen FROM (SELECT o_custkey % 500 AS domain, max(o_orderdate)::DATE AS last_seen FROM orders GROUP BY 1) ORDER BY last_seen DESC, domain LIMIT 40")
def recent_domains(spark, sf):
    seen = load(spark, sf, "orders").groupBy((F.col("o_custkey") % 500).alias("domain")).agg(F.max("o_orderdate").cast("date").alias("last_seen"))
    return seen.orderBy(F.desc("last_seen"), "domain").limit(40).select("domain", F.col("last_seen").cast("string").alias("last_seen"))


@query("SELECT conv_id, array_to_string(list(left(text, 20) ORDER BY turn)[1:3], '/') AS preview FROM conversations GROUP BY conv_id")
def previews(spark, sf):
    """The first three messages, each cut to twenty characters."""
    heads = F.transform(F.slice("messages", 1, 3), lambda m: F.substring(m["content"], 1, 20))
    return conversations(spark, sf).select("conv_id", F.array_join(heads, "/").alias("preview"))


# Review and run state.
@query(f"WITH {_SAMPLE}, d AS (SELECT doc_id, score, perspective, CASE WHEN doc_id % 6 = 0 THEN 'audytor' END AS new_p, CASE WHEN doc_id % 4 = 0 THEN 1.0 END AS new_s FROM s) SELECT doc_id, coalesce(new_p, perspective) AS perspective, round(coalesce(new_s, score), 6)::DOUBLE AS score FROM d")
def job_update(spark, sf):
    """New values replace old ones where there are any."""
    base = samples(spark, sf).select("doc_id", "perspective", "score")
    d = F.col("doc_id")
    changes = base.where(d % 2 == 0).select("doc_id", F.when(d % 6 == 0, "audytor").alias("perspective"), F.when(d % 4 == 0, 1.0).alias("score"))
    return mutations.update_by_key(base, changes, ["doc_id"], ["perspective", "score"]).select("doc_id", "perspective", F.round("score", 6).alias("score"))


@query("""WITH n AS (SELECT o_custkey AS c_custkey, max(o_totalprice) AS c_acctbal FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey, c_acctbal FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n)""")
def upsert_rows(spark, sf):
    """Rows of the new table replace those with the same key."""
    new = load(spark, sf, "orders").where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_totalprice").alias("c_acctbal"))
    return mutations.upsert_last(load(spark, sf, "customer").select("c_custkey", "c_acctbal"), new, ["c_custkey"])


@query(f"""WITH {_SAMPLE}, a AS (SELECT doc_id, CASE WHEN score >= 0.88 THEN 'green' WHEN score >= 0.70 THEN 'grey' ELSE 'red' END AS zone, CASE WHEN doc_id % 5 = 0 THEN 'x' END AS human, CASE WHEN doc_id % 3 = 0 THEN true END AS approved FROM s)
SELECT doc_id, CASE WHEN human IS NOT NULL THEN approved WHEN zone = 'green' THEN true WHEN zone = 'red' THEN false ELSE approved END AS approved FROM a""")
def auto_review(spark, sf):
    """The automatic review leaves alone what a human has reviewed."""
    d = F.col("doc_id")
    zone = scores.zone(F.round("score", 6))
    return samples(spark, sf).select("doc_id", state.auto_reviewed(zone, F.when(d % 5 == 0, "x"), F.when(d % 3 == 0, True)).alias("approved"))


@query(f"""WITH {_SAMPLE}, d AS (SELECT doc_id, perspective, CASE WHEN doc_id % 7 = 1 THEN 'approve' WHEN doc_id % 7 = 2 THEN 'reject' WHEN doc_id % 7 = 3 THEN 'edit' END AS action FROM s)
SELECT doc_id, CASE WHEN action = 'edit' THEN 'edited' ELSE perspective END AS answer, CASE WHEN action IN ('approve', 'edit') THEN true WHEN action = 'reject' THEN false END AS approved, action IS NOT NULL AS human_reviewed FROM d""")
def human_review(spark, sf):
    base = samples(spark, sf).select("doc_id", F.col("perspective").alias("answer"), F.lit(None).cast("boolean").alias("approved"))
    d = F.col("doc_id") % 7
    decisions = base.where(d.isin(1, 2, 3)).select("doc_id", F.when(d == 1, "approve").when(d == 2, "reject").otherwise("edit").alias("action"), F.when(d == 3, "edited").alias("edit"))
    return state.decided(base, decisions, "doc_id")


@query("SELECT event_id, greatest(1, least(5, (event_id % 9)::INT - 1)) AS rating, (props || props)[1:500] AS comment FROM events ORDER BY ts DESC, event_id DESC LIMIT 1000")
def bounded_feedback(spark, sf):
    """The last 1,000 feedbacks, ratings within bounds."""
    rating, comment = state.feedback((F.col("event_id") % 9).cast("int") - 1, F.concat("props", "props"))
    rows = state.last_rows(load(spark, sf, "events"), None, ["ts", "event_id"], state.FEEDBACKS)
    return rows.select("event_id", rating.alias("rating"), comment.alias("comment"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 5")
def last_lines(spark, sf):
    """Each run's last five lines."""
    return state.last_rows(load(spark, sf, "events"), "user_id", ["ts", "event_id"], 5).select("user_id", "event_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'done' WHEN o_orderkey % 4 = 1 THEN 'running' ELSE o_orderstatus END AS status,
  CASE WHEN o_orderkey % 4 = 0 AND o_orderkey % 8 <> 0 THEN 999 WHEN o_orderkey % 8 = 0 THEN 5 END AS ended_at FROM orders""")
def run_updates(spark, sf):
    """A terminal status sets the end of a run once."""
    k = F.col("o_orderkey")
    status, ended = state.run_update(F.col("o_orderstatus"), F.when(k % 4 == 0, "done").when(k % 4 == 1, "running"), F.when(k % 8 == 0, 5), F.lit(999))
    return load(spark, sf, "orders").select("o_orderkey", status.alias("status"), ended.alias("ended_at"))


@query("""SELECT o_orderkey::VARCHAR AS run_id, CASE WHEN o_orderkey % 3 = 0 THEN 'done' ELSE 'starting' END AS status, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey::INT ELSE 0 END AS chunks_done, 0 AS dpo_pairs,
  CASE WHEN o_orderkey % 5 = 0 THEN 1.5 ELSE 77.0 END::DOUBLE AS started_at FROM orders""")
def run_snapshots(spark, sf):
    """Snapshots written as JSON and read back: what is missing has its default."""
    k = F.col("o_orderkey")
    snapshot = F.to_json(F.struct(k.cast("string").alias("run_id"), F.when(k % 3 == 0, "done").alias("status"), F.when(k % 2 == 0, F.col("o_custkey")).alias("chunks_done"), F.when(k % 5 == 0, 1.5).alias("started_at")))
    return load(spark, sf, "orders").select(state.decoded(snapshot, 77.0).alias("r")).select("r.run_id", "r.status", "r.chunks_done", "r.dpo_pairs", "r.started_at")


@query("""SELECT c_name, row_number() OVER (ORDER BY c_acctbal DESC, c_name)::INT AS place FROM (SELECT c_name, c_acctbal FROM customer WHERE starts_with(c_name, 'Customer#00') ORDER BY c_name LIMIT 25)""")
def prefix_list(spark, sf):
    """The first 25 keys with the prefix, then sorted by time (here: balance), the latest first."""
    return state.listed(load(spark, sf, "customer"), "c_name", "Customer#00", 25, "c_acctbal").select("c_name", "place")


@query("SELECT o_orderkey, greatest(0, epoch(o_orderdate)::BIGINT - epoch(TIMESTAMP '1995-06-01 00:00:00')::BIGINT) AS seconds FROM orders")
def schedule_status(spark, sf):
    """Seconds to a source's next run at a fixed time, 0 where it is due."""
    at = F.col("o_orderdate").cast("timestamp")
    return load(spark, sf, "orders").select("o_orderkey", state.remaining(at, F.lit("1995-06-01 00:00:00").cast("timestamp")).alias("seconds"))


@query(f"WITH {VEC} SELECT query, doc_id, lang, similarity FROM vt JOIN documents ON doc_id = vec_id")
def fused_rows(spark, sf):
    """The rows of found ids."""
    return _vector(spark, sf).withColumnRenamed("vec_id", "doc_id").join(load(spark, sf, "documents"), "doc_id").select("query", "doc_id", "lang", "similarity")


@query("SELECT doc_id, (CASE WHEN doc_id % 5 = 4 THEN 3 WHEN doc_id % 3 > 0 THEN 12 ELSE 8 END // CASE WHEN doc_id % 4 = 0 THEN 2 ELSE 1 END)::INT AS top_k, round(w / (w + b), 6) AS vector_weight FROM (SELECT doc_id, 0.6 + CASE WHEN doc_id % 4 IN (2, 3) THEN 0.2 ELSE 0 END AS w, 0.4 + CASE WHEN doc_id % 4 IN (0, 1) THEN 0.2 ELSE 0 END AS b FROM documents)")
def retrieval_plan(spark, sf):
    """How many chunks a question asks for, and with which weights, by its type and history."""
    d = F.col("doc_id")
    kinds = ("scope", "compliance", "comparative", "process")
    weight = F.get(F.array(*[F.lit(retrieval.weights(k)[0]) for k in kinds]), (d % 4).cast("int"))
    size = scores.retrieval_size(d % 3, F.when(d % 5 == 4, 3000).otherwise(10), F.when(d % 4 == 0, 100).otherwise(1000))
    return load(spark, sf, "documents").select("doc_id", size.cast("int").alias("top_k"), F.round(weight, 6).alias("vector_weight"))
