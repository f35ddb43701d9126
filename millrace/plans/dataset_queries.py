"""Dataset products: conversations, preference pairs, splits, cards, gates and the generation state machine."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import scores, text
from millrace.operators import dataset
from millrace.plans.core import query
from millrace.sources.tables import load

#: The phrase by which the reference's gate knows a refusal.
REFUSAL = "Brak danych w dyrektywie"
_CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS m FROM conversations GROUP BY conv_id)"


def conversations(spark, sf):
    return dataset.messages(load(spark, sf, "conversations"), "conv_id", "turn", "role", "text")


@query(f"WITH {_CONV} SELECT conv_id, len(m)::BIGINT AS n_messages, len(m) > 0 AND len(list_filter(m, lambda x: x.role NOT IN ('system', 'user', 'assistant') OR trim(coalesce(x.content, '')) = '')) = 0 AS valid FROM conv")
def validate_conversations(spark, sf):
    return conversations(spark, sf).select("conv_id", F.size("messages").cast("long").alias("n_messages"), dataset.is_valid(F.col("messages")).alias("valid"))


@query("SELECT conv_id, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, coalesce(sum(length(text)), 0)::BIGINT AS n_chars, count(*) FILTER (role = 'user') > 1 AS multi_turn FROM conversations GROUP BY conv_id")
def conversation_stats(spark, sf):
    count = lambda role: F.count_if(F.col("role") == role)
    return load(spark, sf, "conversations").groupBy("conv_id").agg(count("user").alias("user_turns"), count("assistant").alias("assistant_turns"), F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n_chars"), (count("user") > 1).alias("multi_turn"))


_PAIR = """c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS asked, arg_min(text, turn) FILTER (role = 'assistant') AS said FROM conversations GROUP BY conv_id),
p AS (SELECT a.conv_id AS id, a.asked AS prompt, a.said AS chosen, b.said AS rejected FROM c a JOIN c b ON b.conv_id = a.conv_id + 1),
k AS (SELECT * FROM p WHERE trim(chosen) <> '' AND trim(rejected) <> '' AND trim(chosen) <> trim(rejected))"""


def pairs(spark, sf):
    """A conversation's first question and answer, and the next one's first answer as the rejected one: whole texts."""
    own = lambda role: F.min_by(F.when(F.col("role") == role, F.col("text")), F.when(F.col("role") == role, F.col("turn")))
    first = load(spark, sf, "conversations").groupBy("conv_id").agg(own("user").alias("prompt"), own("assistant").alias("chosen"))
    other = first.select((F.col("conv_id") - 1).alias("conv_id"), F.col("chosen").alias("rejected"))
    return first.join(other, "conv_id").select(F.col("conv_id").alias("id"), "prompt", "chosen", "rejected")


@query(f"WITH {_PAIR} SELECT id, prompt, chosen, rejected FROM k")
def preference_pairs(spark, sf):
    return dataset.preference_pairs(pairs(spark, sf))


@query(f"WITH {_PAIR} SELECT id, prompt, chosen AS completion, true AS label FROM k UNION ALL SELECT id, prompt, rejected, false FROM k")
def kto_rows(spark, sf):
    return dataset.kto(dataset.preference_pairs(pairs(spark, sf)))


@query("SELECT doc_id, n::BIGINT AS idx, n % 5 = 0 AS holdout, n < floor(t * 0.9) AS train FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n, count(*) OVER () AS t FROM documents)")
def holdout_split(spark, sf):
    return dataset.split(load(spark, sf, "documents"), "doc_id", modulo=5, validation=0.1).select("doc_id", "idx", "holdout", "train")


_SAMPLE = "s AS (SELECT l.doc_id, (CASE WHEN quality = 1 THEN 0.6 ELSE 0.3 END) + (l.doc_id % 40) * 0.01 AS score, ['cfo', 'prawnik', 'audytor'][(l.doc_id % 3 + 1)::INT] AS perspective, ['easy', 'medium', 'hard', NULL][(l.doc_id % 4 + 1)::INT] AS difficulty, toxic, text FROM labels l JOIN documents d USING (doc_id))"


def samples(spark, sf):
    pick = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (F.col("doc_id") % n).cast("int"))
    rows = load(spark, sf, "labels").join(load(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    return rows.select("doc_id", F.round(F.when(F.col("quality") == 1, F.lit(0.6)).otherwise(0.3) + (F.col("doc_id") % 40) * 0.01, 6).alias("score"), pick(3, "cfo", "prawnik", "audytor").alias("perspective"), pick(4, "easy", "medium", "hard", None).alias("difficulty"), "toxic", "text")


@query(f"WITH {_SAMPLE} SELECT coalesce(perspective, 'unknown') AS perspective, coalesce(difficulty, 'unknown') AS difficulty, count(*) AS n, round(avg(score), 6) AS avg_score, count(*) FILTER (toxic = 1) AS n_adversarial FROM s GROUP BY 1, 2")
def dataset_stats(spark, sf):
    return samples(spark, sf).groupBy(F.coalesce("perspective", F.lit("unknown")).alias("perspective"), F.coalesce("difficulty", F.lit("unknown")).alias("difficulty")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"), F.count_if(F.col("toxic") == 1).alias("n_adversarial"))


def _dist_sql(q):
    return f"l[(least(floor(len(l) * {q}), len(l) - 1) + 1)::INT]"


@query(f"WITH {_SAMPLE}, g AS (SELECT perspective, list_sort(list(length(text))) AS l FROM s GROUP BY 1) SELECT perspective, len(l) AS n, l[1] AS least, {_dist_sql(0.5)} AS median, {_dist_sql(0.75)} AS p75, {_dist_sql(0.9)} AS p90, l[-1] AS most FROM g")
def length_distribution(spark, sf):
    return dataset.distribution(samples(spark, sf).select("perspective", F.length("text").alias("v")), ["perspective"], "v")


_GATE = f"""WITH {_SAMPLE}, {_PAIR}, cs AS (SELECT conv_id, count(*) FILTER (role = 'user') > 1 AS multi_turn, count(*) FILTER (role = 'assistant' AND contains(text, '{REFUSAL}')) > 0 AS refusal FROM conversations GROUP BY conv_id),
a AS (SELECT count(*) AS n, avg(score) AS q, (SELECT max(x) / sum(x) FROM (SELECT count(*) AS x FROM s GROUP BY perspective)) AS share, (SELECT count(*) FROM k) AS pairs, (SELECT coalesce(avg(multi_turn::INT), 0) FROM cs) AS mt, (SELECT coalesce(avg(refusal::INT), 0) FROM cs) AS rf FROM s)
SELECT 'min_samples' AS name, n::DOUBLE AS value, n >= 500 AS passed, true AS blocking FROM a UNION ALL (SELECT x.* FROM (SELECT unnest([{{'name': 'min_dpo_pairs', 'value': pairs::DOUBLE, 'passed': pairs >= 50, 'blocking': true}},
{{'name': 'avg_score', 'value': round(coalesce(q, 0.82), 6), 'passed': coalesce(q >= 0.82, true), 'blocking': true}}, {{'name': 'max_share', 'value': round(share, 6), 'passed': share <= 0.60, 'blocking': true}},
{{'name': 'multi_turn_pct', 'value': round(mt, 6), 'passed': mt >= 0.15, 'blocking': true}}, {{'name': 'has_scores', 'value': (q IS NOT NULL)::INT::DOUBLE, 'passed': q IS NOT NULL, 'blocking': false}},
{{'name': 'refusal_pct', 'value': round(rf, 6), 'passed': rf <= 0.20, 'blocking': false}}, {{'name': 'advised_samples', 'value': n::DOUBLE, 'passed': n >= 1000, 'blocking': false}}]) AS x FROM a WHERE n > 0))"""


@query(_GATE)
def quality_gate_checks(spark, sf):
    """The reference's five blocking checks and its warnings."""
    own = F.col("role") == "assistant"
    refused = F.count_if(own & F.contains("text", F.lit(REFUSAL))) > 0
    talks = load(spark, sf, "conversations").groupBy("conv_id").agg((F.count_if(F.col("role") == "user") > 1).alias("multi_turn"), refused.alias("refusal"))
    return dataset.full_gate(samples(spark, sf), "score", "perspective", dataset.preference_pairs(pairs(spark, sf)), talks)


@query(_GATE)
def quality_gate(spark, sf):
    return quality_gate_checks(spark, sf)


@query(f"WITH {_SAMPLE} SELECT CASE WHEN score >= 0.88 THEN 'green' WHEN score >= 0.70 THEN 'grey' ELSE 'red' END AS zone, count(*) AS n, round(avg(score), 6) AS mean FROM s GROUP BY 1")
def review_summary(spark, sf):
    return samples(spark, sf).groupBy(scores.zone(F.col("score")).alias("zone")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean"))


@query(f"WITH {_SAMPLE} SELECT doc_id, round(score, 6)::DOUBLE AS score FROM s WHERE score >= 0.70 AND score < 0.88 ORDER BY round(abs(score - 0.79), 9), doc_id LIMIT 20")
def review_queue(spark, sf):
    return samples(spark, sf).where("score >= 0.70 and score < 0.88").orderBy(F.round(F.abs(F.col("score") - 0.79), 9), "doc_id").limit(20).select("doc_id", F.round("score", 6).alias("score"))


@query(f"WITH {_SAMPLE}, p AS (SELECT perspective, avg(score) AS m, count(*) AS n FROM s GROUP BY 1) SELECT perspective, n, round(m, 6) AS mean, round((SELECT avg(m) FROM p), 6) AS mean_of_means FROM p")
def weakness_report(spark, sf):
    p = samples(spark, sf).groupBy("perspective").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    return p.select("perspective", "n", F.round("m", 6).alias("mean"), F.round(F.avg("m").over(W.partitionBy()), 6).alias("mean_of_means"))


@query(f"WITH {_SAMPLE} SELECT doc_id, CASE WHEN score >= 0.82 THEN 'append' WHEN doc_id % 3 > 0 THEN 'write' WHEN doc_id % 7 < 3 THEN 'retry' ELSE 'unresolvable' END AS next FROM s")
def route_after_judge(spark, sf):
    return samples(spark, sf).select("doc_id", scores.route_after_judge(F.col("score"), F.col("doc_id") % 3, F.col("doc_id") % 7).alias("next"))


@query("SELECT doc_id, round(CASE WHEN toxic = 1 THEN greatest(0.0, least(s - 0.3, 0.7)) ELSE least(greatest(s, 0.0), 1.0) END, 6) AS overall FROM (SELECT doc_id, toxic, 0.40 * (doc_id % 11) / 10 + 0.25 * (doc_id % 7) / 6 + 0.20 * quality + 0.15 * (doc_id % 3) / 2 AS s FROM labels)")
def judge_score(spark, sf):
    d = F.col("doc_id")
    return load(spark, sf, "labels").select("doc_id", F.round(scores.judge(d % 11 / 10, d % 7 / 6, F.col("quality"), d % 3 / 2, F.col("toxic") == 1), 6).alias("overall"))


@query("SELECT conv_id, turn, contains(lower(text), 'brak danych') AS refusal FROM conversations WHERE role = 'assistant'")
def refusals(spark, sf):
    return load(spark, sf, "conversations").where("role = 'assistant'").select("conv_id", "turn", F.contains(F.lower("text"), F.lit("brak danych")).alias("refusal"))


@query("SELECT '{\"custom_id\":\"' || doc_id || '\",\"method\":\"POST\",\"n\":' || length(text) || '}' AS line FROM documents")
def batch_requests(spark, sf):
    return load(spark, sf, "documents").select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("custom_id"), F.lit("POST").alias("method"), F.length("text").alias("n"))).alias("line"))


@query("SELECT doc_id, p.perspective FROM documents, (SELECT unnest(['cfo', 'prawnik', 'audytor']) AS perspective) p")
def perspective_fanout(spark, sf):
    """Each document with each of the fixed perspectives."""
    return load(spark, sf, "documents").select("doc_id", F.explode(F.array(*map(F.lit, ("cfo", "prawnik", "audytor")))).alias("perspective"))


@query(f"SELECT doc_id, {' OR '.join(f'''contains(lower(text), '{r}')''' for r in text.REFUSALS)} AS refusal FROM documents")
def refusal_variants(spark, sf):
    return load(spark, sf, "documents").select("doc_id", text.is_refusal(F.col("text")).alias("refusal"))
