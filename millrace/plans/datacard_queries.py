"""The datacard of the conversations, with metadata and system messages by their numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import datacard, generation
from millrace.plans.core import query
from millrace.sources.tables import load

_SYSTEM = ("You are a CFO.", "Jesteś asystentem radcy prawnego.", "Rola: biegłego rewidenta", "Synteza wielu aktów", "Someone")
_REFUSAL = "Brak danych w dyrektywie."
_RECORDS = f"""t AS (SELECT conv_id, turn, role, text || CASE WHEN role = 'assistant' AND conv_id % 6 = 0 THEN ' {_REFUSAL}'
    WHEN role = 'assistant' AND conv_id % 4 = 1 THEN ' <reasoning>x</reasoning>' ELSE '' END AS text FROM conversations),
r AS (SELECT conv_id, count(*) FILTER (role = 'user') AS turns, first(length(text) ORDER BY turn) FILTER (role = 'user') AS question,
    last(text ORDER BY turn) FILTER (role = 'assistant') AS last_a, coalesce(bool_or(contains(text, '{_REFUSAL}')) FILTER (role = 'assistant'), FALSE) AS refusal FROM t GROUP BY conv_id),
e AS (SELECT turns, question, length(last_a) AS answer, refusal, coalesce(contains(last_a, '<reasoning>'), FALSE) AS reasoning,
    ['cfo', 'prawnik', 'audytor', 'cross_doc', 'unknown'][(conv_id % 5 + 1)::INT] AS perspective, ['factual', '', 'scope'][(conv_id % 3 + 1)::INT] AS question_type,
    CASE WHEN conv_id % 2 = 0 THEN 'hard' END AS difficulty, conv_id % 100 / 100.0 AS judge_score, conv_id % 7 = 0 AS cross_doc, conv_id % 9 = 0 AS adversarial,
    conv_id % 4 = 0 AS watermarked, turns > 1 AS multi_turn FROM r),
n AS (SELECT count(*) AS total FROM e),
v AS (SELECT unnest([{{'name': 'total_records', 'value': count(*)::DOUBLE}}, {{'name': 'watermarked_count', 'value': count(*) FILTER (watermarked)::DOUBLE}},
    {{'name': 'single_turn_count', 'value': count(*) FILTER (NOT multi_turn)::DOUBLE}},
    {", ".join(f"{{'name': '{c}_count', 'value': count(*) FILTER ({c})::DOUBLE}}, {{'name': '{c}_pct', 'value': round(100.0 * count(*) FILTER ({c}) / count(*), 1)::DOUBLE}}" for c in datacard.SHARED)}]) AS x FROM e),
g AS (SELECT section, name, count(*) AS k FROM (SELECT 'perspective' AS section, perspective AS name FROM e UNION ALL SELECT 'question_type', question_type FROM e
    UNION ALL SELECT 'difficulty', difficulty FROM e) WHERE name <> '' GROUP BY ALL),
m AS (SELECT section, list_sort(list(v)) AS l FROM (SELECT 'turns' AS section, turns::DOUBLE AS v FROM e UNION ALL SELECT 'judge_score', judge_score::DOUBLE FROM e
    UNION ALL SELECT 'question', question::DOUBLE FROM e UNION ALL SELECT 'answer', answer::DOUBLE FROM e) WHERE v IS NOT NULL GROUP BY section)"""


@query(f"""WITH {_RECORDS}
SELECT 'volume' AS section, x.name AS name, x.value AS value FROM v UNION ALL SELECT section, name, k FROM g
UNION ALL SELECT section, name || '_pct', round(100.0 * k / total, 1) FROM g, n
UNION ALL SELECT section, unnest(['count', 'min', 'mean', 'median', 'p75', 'p90', 'max']), unnest([len(l), round(l[1], 1), round(list_avg(l), 1),
  round((l[((len(l) - 1) // 2 + 1)::INT] + l[(len(l) // 2 + 1)::INT]) / 2, 1), round(l[floor(len(l) * 0.75)::INT + 1], 1), round(l[floor(len(l) * 0.9)::INT + 1], 1), round(l[-1], 1)]) FROM m""")
def training_datacard(spark, sf):
    """The card of all conversations: volumes, shares, distributions of types and of lengths."""
    c = F.col("conv_id")
    tail = F.when((F.col("role") == "assistant") & (c % 6 == 0), f" {_REFUSAL}").when((F.col("role") == "assistant") & (c % 4 == 1), " <reasoning>x</reasoning>").otherwise("")
    turns = load(spark, sf, "conversations").withColumn("text", F.concat("text", tail))
    # the messages of one conversation: bounded by the conversation
    talks = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    pick = lambda words: F.get(F.array(*map(F.lit, words)), (c % len(words)).cast("int"))
    system = F.struct(F.lit("system").alias("role"), pick(_SYSTEM).alias("content"))
    said = F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content")))
    records = talks.select(
        F.concat(F.array(system), said).alias("messages"), (c % 100 / 100).alias("quality_score"), pick(("factual", "", "scope")).alias("question_type"),
        F.when(c % 2 == 0, "hard").alias("difficulty"), F.when(c % 7 == 0, "cross_doc").otherwise("cfo").alias("perspective"), (c % 9 == 0).alias("adversarial"),
        F.when(c % 4 == 0, "abc").alias("watermark_hash"),
    )
    return datacard.datacard(records, _REFUSAL)


@query(r"""WITH w AS (SELECT doc_id, '```json' || chr(10) || '{"n": ' || doc_id || '}' || chr(10) || '```' AS raw,
  '<Issues>' || chr(10) || '- first of ' || doc_id || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '- second' || chr(10) ELSE '' END || '</issues> - no' AS said FROM documents)
SELECT doc_id, '{"n": ' || doc_id || '}' AS plain, array_to_string(CASE WHEN doc_id % 2 = 0 THEN ['first of ' || doc_id, 'second'] ELSE ['first of ' || doc_id] END, '|') AS issues FROM w""")
def answers_unwrapped(spark, sf):
    """JSON without its code fences, and the bullets of a critique's list of issues."""
    d = F.col("doc_id").cast("string")
    raw = F.concat(F.lit('```json\n{"n": '), d, F.lit("}\n```"))
    said = F.concat(F.lit("<Issues>\n- first of "), d, F.lit("\n"), F.when(F.col("doc_id") % 2 == 0, "- second\n").otherwise(""), F.lit("</issues> - no"))
    return load(spark, sf, "documents").select("doc_id", text.strip_fences(raw).alias("plain"), F.array_join(generation.bullets(said, "issues"), "|").alias("issues"))
