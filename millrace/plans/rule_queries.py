"""Queries of the rules for domains, dates, topics, training, logs and watermarks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import rules, watermarks
from millrace.plans.core import query
from millrace.sources.tables import load

_quoted = lambda s: "'" + s.replace("'", "''") + "'"
_listed = lambda words: "[" + ", ".join(map(_quoted, words)) + "]"
_pick = lambda column, words: F.get(F.array(*map(F.lit, words)), (F.col(column) % len(words)).cast("int"))

_HITS = ", ".join("(" + " + ".join(f"contains(s, {_quoted(k)})::INT" for k in words) + ")" for words in rules.DOMAINS.values())


@query(f"""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS s FROM documents),
b AS (SELECT doc_id, [{_HITS}] AS h, greatest(len(regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+')), 1) AS n FROM a),
c AS (SELECT doc_id, list_max(h) / n AS score, {_listed(rules.DOMAINS)}[list_position(h, list_max(h))] AS name FROM b)
SELECT doc_id, CASE WHEN score < 0.003 THEN 'general_legal' ELSE name END AS domain, round(score, 6) AS score,
  round(CASE WHEN score < 0.003 THEN score ELSE round(least(score / (0.003 * 5), 1.0), 2) END, 6) AS confidence FROM c""")
def document_domains(spark, sf):
    found = load(spark, sf, "documents").select("doc_id", rules.domain(F.col("text")).alias("d"))
    return found.select("doc_id", "d.domain", F.round("d.score", 6).alias("score"), F.round("d.confidence", 6).alias("confidence"))


@query(r"""WITH t AS (SELECT o_orderkey, 'Annex. ' || CASE (o_orderkey % 5)::INT WHEN 0 THEN 'Applicable from: ' || strftime(o_orderdate, '%d.%m.%Y') WHEN 1 THEN 'effective ' || strftime(o_orderdate, '%Y-%m-%d')
  WHEN 2 THEN 'valid from 31/02/2024 or od dnia 1.3.2024' WHEN 3 THEN 'od dnia ' || strftime(o_orderdate, '%d/%m/%Y') || ' effective 2020-01-01' ELSE 'dated ' || strftime(o_orderdate, '%d.%m.%Y') END AS text FROM orders)
SELECT o_orderkey, CASE WHEN raw <> '' THEN try_strptime(raw, ['%d.%m.%Y', '%d/%m/%Y', '%d-%m-%Y', '%Y-%m-%d', '%Y.%m.%d'])::DATE::VARCHAR END AS valid_from
FROM (SELECT o_orderkey, regexp_extract(text, '(?i)(?:wchodzi w życie|applicable from|valid from|effective|od dnia)\s*:?\s*(\d{1,2}[./-]\d{1,2}[./-]\d{4}|\d{4}[./-]\d{2}[./-]\d{2})', 1) AS raw FROM t)""")
def valid_from_dates(spark, sf):
    day = lambda f: F.date_format("o_orderdate", f)
    said = F.array(F.concat(F.lit("Applicable from: "), day("dd.MM.yyyy")), F.concat(F.lit("effective "), day("yyyy-MM-dd")), F.lit("valid from 31/02/2024 or od dnia 1.3.2024"), F.concat(F.lit("od dnia "), day("dd/MM/yyyy"), F.lit(" effective 2020-01-01")), F.concat(F.lit("dated "), day("dd.MM.yyyy")))
    text = F.concat(F.lit("Annex. "), F.get(said, (F.col("o_orderkey") % 5).cast("int")))
    return load(spark, sf, "orders").select("o_orderkey", rules.valid_from(text).cast("string").alias("valid_from"))


@query(r"""SELECT doc_id, CASE WHEN a <> '' THEN a::INT WHEN b <> '' THEN b::INT END AS year FROM (
  SELECT doc_id, regexp_extract(CASE WHEN doc_id % 3 = 0 THEN 'act-' || (1980 + doc_id % 60) || '.pdf' ELSE 'act.pdf' END, '\b(20\d{2})\b', 1) AS a,
    regexp_extract((CASE WHEN doc_id % 4 = 0 THEN 'of 20' || (10 + doc_id % 20) || ', ' ELSE '' END || text)[1:500], '\b(20\d{2})\b', 1) AS b FROM documents)""")
def directive_years(spark, sf):
    d = F.col("doc_id")
    name = F.when(d % 3 == 0, F.concat(F.lit("act-"), (1980 + d % 60).cast("string"), F.lit(".pdf"))).otherwise("act.pdf")
    text = F.concat(F.when(d % 4 == 0, F.concat(F.lit("of 20"), (10 + d % 20).cast("string"), F.lit(", "))).otherwise(""), F.col("text"))
    return load(spark, sf, "documents").select("doc_id", rules.directive_year(name, text).alias("year"))


_KINDS = ("eurlex", "arxiv", "imf", "reddit", "ted", "curia", "pubmed", "github")
_CATEGORIES = (*rules.TOPIC_GATES, "general")
_GATES = " ".join(f"WHEN '{c}' THEN [CASE WHEN n < {n} THEN 'min_{n}_sources' END, CASE WHEN high < {h} THEN 'min_{h}_high_tier_sources' END, CASE WHEN NOT list_has_any(kinds, {_listed(k)}) THEN '{m}' END]" for c, (n, h, m, k) in rules.TOPIC_GATES.items())


@query(f"""WITH p AS (SELECT page_id % 60 AS topic, {_listed(_KINDS)}[(page_id // 60 % {len(_KINDS)} + 1)::INT] AS kind, ['S', 'A', 'B', 'C'][(page_id * 7 // 60 % 4 + 1)::INT] AS tier FROM pages WHERE page_id % 60 <> 7 OR page_id < 60),
t AS (SELECT topic, {_listed(_CATEGORIES)}[(topic % {len(_CATEGORIES)} + 1)::INT] AS category, (topic % 10) / 10 AS quality, count(*) AS n, count(*) FILTER (tier IN ('S', 'A')) AS high, list(DISTINCT kind) AS kinds FROM p GROUP BY topic),
r AS (SELECT topic, category, list_filter(list_concat([CASE WHEN quality < 0.45 THEN 'quality_score<0.45' END],
  CASE category {_GATES} ELSE [CASE WHEN n < 3 THEN 'min_3_sources' END, CASE WHEN high < 1 THEN 'min_1_high_tier_source' END] END), lambda x: x IS NOT NULL) AS reasons FROM t)
SELECT topic, category, coalesce(array_to_string(reasons, ','), '') AS reasons, len(reasons) = 0 AS passed FROM r""")
def topic_gates(spark, sf):
    """Gates of stand-in topics: pages are their sources."""
    p = F.col("page_id")
    kind, tier = F.get(F.array(*map(F.lit, _KINDS)), (F.floor(p / 60) % len(_KINDS)).cast("int")), F.get(F.array(*map(F.lit, "SABC")), (F.floor(p * 7 / 60) % 4).cast("int"))
    sources = load(spark, sf, "pages").where((p % 60 != 7) | (p < 60)).select((p % 60).alias("topic"), kind.alias("kind"), tier.alias("tier"))
    topics = sources.groupBy("topic").agg(F.count("*").alias("n"), F.count_if(F.col("tier").isin("S", "A")).alias("high"), F.collect_set("kind").alias("kinds"))
    topics = topics.withColumn("category", _pick("topic", _CATEGORIES))
    reasons = rules.topic_gate(F.col("category"), F.col("n"), F.col("high"), F.col("kinds"), F.col("topic") % 10 / 10)
    return topics.select("topic", "category", reasons.alias("r")).select("topic", "category", F.array_join("r", ",").alias("reasons"), (F.size("r") == 0).alias("passed"))


@query("SELECT doc_id, round(0.6 * (doc_id % 9) / 8 + 0.4 * (doc_id % 11) / 10, 6) AS temporal_gap, round(least(greatest(((doc_id % 7) / 5 + (doc_id % 5) / 4) / 2, 0.0), 1.0), 6) AS uncertainty, round(least(greatest((doc_id % 13) / 20 / 0.35, 0.0), 1.0), 6) AS divergence FROM documents")
def gap_components(spark, sf):
    d = F.col("doc_id")
    uncertainty, divergence = rules.probe_scores((d % 7 / 5, d % 5 / 4), d % 13 / 20)
    return load(spark, sf, "documents").select("doc_id", F.round(rules.temporal_gap(d % 9, d % 11 / 10), 6).alias("temporal_gap"), F.round(uncertainty, 6).alias("uncertainty"), F.round(divergence, 6).alias("divergence"))


_DIMENSIONS = {"hallucination": 10, "grounding": 9, "completeness": 8, "language": 7, "citation": 6}
_WEAK = ", ".join(f"CASE WHEN (doc_id % {_DIMENSIONS[d]}) / {_DIMENSIONS[d]} < 0.7 THEN '{n}' END" for d, n in rules.WEAKNESSES.items())


@query(f"SELECT doc_id, coalesce(array_to_string(list_filter([{_WEAK}], lambda x: x IS NOT NULL), ','), '') AS weaknesses FROM labels")
def weakness_names(spark, sf):
    dims = {d: F.col("doc_id") % n / n for d, n in _DIMENSIONS.items()}
    return load(spark, sf, "labels").select("doc_id", F.array_join(rules.weaknesses(dims), ",").alias("weaknesses"))


_WEIGHTS = {"financial": 0.4, "risk": 0.7, "critical": 1.3}
_HINTED = ("you are the CFO.", "w imieniu Radcy Prawnego", "biegłego rewidenta opinia", "z wielu aktów", "no one")


@query(f"""WITH t AS (SELECT conv_id, turn, {_listed(_HINTED)}[(conv_id % 5 + 1)::INT] || ' ' || text AS s FROM conversations WHERE role = 'system'),
p AS (SELECT conv_id, turn, CASE {" ".join(f"WHEN contains(lower(s), {_quoted(h)}) THEN '{n}'" for n, h in rules.PERSPECTIVE_HINTS)} ELSE 'unknown' END AS perspective FROM t)
SELECT conv_id, turn, perspective, CASE perspective WHEN 'cfo' THEN 0.4 WHEN 'audytor' THEN 0.7 WHEN 'prawnik' THEN 1.3 ELSE 1.0 END::DOUBLE AS weight FROM p""")
def prompt_perspectives(spark, sf):
    """Perspective of a system prompt, and its coverage weight: the lower it is, the earlier the perspective comes."""
    s = F.concat(_pick("conv_id", _HINTED), F.lit(" "), F.col("text"))
    found = load(spark, sf, "conversations").where("role = 'system'").select("conv_id", "turn", rules.perspective(s).alias("perspective"))
    return found.withColumn("weight", rules.perspective_weight(F.col("perspective"), _WEIGHTS))


_PLANNED = ("regulator", "cfo", "audytor", "prawnik", "inwestor")


@query(f"""WITH w AS (SELECT unnest({_listed(_PLANNED)}) AS perspective, unnest(range(5)) AS given)
SELECT perspective, (row_number() OVER (ORDER BY CASE perspective WHEN 'cfo' THEN 0.4 WHEN 'audytor' THEN 0.7 WHEN 'prawnik' THEN 1.3 ELSE 1.0 END, given) - 1)::BIGINT AS place FROM w""")
def perspective_order(spark, sf):
    """The planned perspectives (five rows) by coverage weight, ties as given."""
    from pyspark.sql import Window as W

    given = spark.createDataFrame(list(zip(_PLANNED, range(len(_PLANNED)), strict=True)), "perspective string, given int")
    weight = rules.perspective_weight(F.col("perspective"), _WEIGHTS)
    return given.select("perspective", (F.row_number().over(W.orderBy(weight, "given")) - 1).cast("long").alias("place"))


_WEAK_SETS = (("depth", "citations"), ("conciseness",), (), ("Factual_Accuracy",), ("verbosity", "completeness"))


@query("""WITH a AS (SELECT doc_id, (doc_id % 20) / 100 AS h, (doc_id % 51) / 50 AS q, doc_id % 3 AS c, 0.60 + (doc_id % 36) / 100 AS t, 0.05 + (doc_id % 31) / 100 AS r, 1 + doc_id % 8 AS m,
  [['depth', 'citations'], ['conciseness'], [], ['factual_accuracy'], ['verbosity', 'completeness']][(doc_id % 5 + 1)::INT] AS w FROM documents),
b AS (SELECT *, CASE WHEN h > 0.10 THEN 0.3 * least(t + 0.04, 0.95) + 0.7 * t WHEN h > 0.05 THEN 0.3 * least(t + 0.02, 0.95) + 0.7 * t WHEN h < 0.01 AND q > 0.88 THEN 0.3 * greatest(t - 0.01, 0.60) + 0.7 * t ELSE t END AS t1 FROM a),
c2 AS (SELECT *, CASE WHEN list_has_any(w, ['accuracy', 'factual', 'factual_accuracy', 'citations']) THEN 0.3 * least(t1 + 0.02, 0.95) + 0.7 * t1 ELSE t1 END AS t2,
  CASE WHEN c = 0 THEN r WHEN q < 0.70 THEN 0.3 * least(r + 0.05, 0.35) + 0.7 * r WHEN q > 0.90 AND r > 0.12 THEN 0.3 * greatest(r - 0.02, 0.05) + 0.7 * r ELSE r END AS r2,
  CASE WHEN list_has_any(w, ['brevity', 'verbosity', 'conciseness']) THEN greatest(m - 1, 1) WHEN list_has_any(w, ['depth', 'completeness', 'comprehensiveness']) THEN least(m + 1, 8) ELSE m END AS m2 FROM b)
SELECT doc_id, round(greatest(0.60, least(t2, 0.95)), 3) AS threshold, round(greatest(0.05, least(r2, 0.35)), 3) AS adversarial, greatest(1, least(m2, 8))::INT AS turns FROM c2""")
def feedback_adjustments(spark, sf):
    """The calibration after a stand-in cycle report for each document id."""
    d = F.col("doc_id")
    weak = F.get(F.array(*[F.array(*map(F.lit, w)).cast("array<string>") for w in _WEAK_SETS]), (d % 5).cast("int"))
    a = rules.adjusted(d % 20 / 100, d % 51 / 50, d % 3, weak, 0.60 + d % 36 / 100, 0.05 + d % 31 / 100, 1 + d % 8)
    return load(spark, sf, "documents").select("doc_id", a.alias("a")).select("doc_id", F.round("a.threshold", 3).alias("threshold"), F.round("a.adversarial", 3).alias("adversarial"), "a.turns")


@query("SELECT conv_id, round(sum(CASE WHEN role = 'assistant' THEN 0 ELSE ceil(length(text) / 4) END) / 1e6 * 0.15 + sum(CASE WHEN role = 'assistant' THEN ceil(length(text) / 4) ELSE 0 END) / 1e6 * 0.60, 9) AS cost FROM conversations GROUP BY conv_id")
def batch_costs(spark, sf):
    tokens = lambda own: F.sum(F.when(own, F.ceil(F.length("text") / 4)).otherwise(0))
    answer = F.col("role") == "assistant"
    return load(spark, sf, "conversations").groupBy("conv_id").agg(F.round(rules.batch_cost(tokens(~answer), tokens(answer), 0.15, 0.60), 9).alias("cost"))


@query("""WITH a AS (SELECT c_custkey, c_custkey * 37 % 12000 AS n, ['llama-70b', 'Llama-3.1-8B', 'phi-4-mini'][(c_custkey % 3 + 1)::INT] AS model FROM customer), b AS (SELECT *, greatest(n // 16, 1) AS s FROM a)
SELECT c_custkey, CASE WHEN n < 500 THEN 5 WHEN n < 1000 THEN 4 WHEN n < 3000 THEN 3 WHEN n < 8000 THEN 2 ELSE 1 END AS epochs,
  (CASE WHEN lower(model) LIKE '%70b%' THEN 5e-5 WHEN lower(model) LIKE '%8b%' THEN 1e-4 ELSE 2e-4 END * CASE WHEN n > 5000 THEN 0.5 ELSE 1.0 END)::DOUBLE AS rate,
  least(floor(s * 0.1), 200)::BIGINT AS warmup, greatest(s // 2, 10)::BIGINT AS save, greatest(s // 4, 5)::BIGINT AS eval FROM b""")
def training_plans(spark, sf):
    plan = rules.training_plan(F.col("c_custkey") * 37 % 12000, _pick("c_custkey", ("llama-70b", "Llama-3.1-8B", "phi-4-mini")), 2, 8)
    return load(spark, sf, "customer").select("c_custkey", plan.alias("p")).select("c_custkey", "p.epochs", "p.rate", *[F.col(f"p.{c}").cast("long").alias(c) for c in ("warmup", "save", "eval")])


@query("""SELECT c_custkey, CASE WHEN m <= 0 THEN 'API fine-tune (no GPU)' WHEN m - 2 >= 48 THEN 'Llama-3.1-70B' WHEN m - 2 >= 12 THEN 'Llama-3.1-8B' WHEN m - 2 >= 7 THEN 'Llama-3.2-3B' ELSE 'Phi-4-Mini (3.8B)' END AS model
FROM (SELECT c_custkey, c_custkey % 64 AS m FROM customer)""")
def model_choice(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", rules.model_for(F.col("c_custkey") % 64).alias("model"))


_LINES = r"""l AS (SELECT o_orderkey, CASE (o_orderkey % 6)::INT WHEN 0 THEN 'Progress: ' || o_custkey || ' chunks | 3 ready | 1 unresolvable | ' || (o_custkey * 2) || ' records | 7 DPO' WHEN 1 THEN 'Found ' || o_custkey || ' pending chunks'
  WHEN 2 THEN '✓ Record ' || o_custkey || ' written' WHEN 3 THEN 'Run Complete' WHEN 4 THEN '[ERROR] ' || o_custkey ELSE 'Progress: none' END AS line FROM orders)"""


@query(rf"""WITH {_LINES}, p AS (SELECT o_orderkey, line, regexp_extract(line, '{rules.PROGRESS}', ['a', 'b', 'c', 'd', 'e']) AS g, regexp_extract(line, 'Found (\d+) pending chunks', 1) AS f, regexp_extract(line, '✓ Record (\d+) written', 1) AS r FROM l)
SELECT o_orderkey, nullif(g.a, '')::INT AS done, coalesce(nullif(g.d, '')::INT, nullif(r, '')::INT + 1) AS records, nullif(g.e, '')::INT AS pairs, nullif(f, '')::INT AS total,
  CASE WHEN f <> '' THEN 'running' WHEN contains(line, 'Run Complete') THEN 'done' END AS status FROM p""")
def log_lines(spark, sf):
    who = F.col("o_custkey").cast("string")
    lines = F.array(
        F.concat(F.lit("Progress: "), who, F.lit(" chunks | 3 ready | 1 unresolvable | "), (F.col("o_custkey") * 2).cast("string"), F.lit(" records | 7 DPO")), F.concat(F.lit("Found "), who, F.lit(" pending chunks")),
        F.concat(F.lit("✓ Record "), who, F.lit(" written")), F.lit("Run Complete"), F.concat(F.lit("[ERROR] "), who), F.lit("Progress: none"),
    )
    return load(spark, sf, "orders").select("o_orderkey", rules.log_line(F.get(lines, (F.col("o_orderkey") % 6).cast("int"))).alias("x")).select("o_orderkey", "x.*")


_MARKED = ("Ta Dyrektywa oraz wymogi: ", "the Directive and its obowiązki, directive; ", "raportowanie i ujawnienia wymogi ", "")
_TEXT = f"SELECT doc_id, {_listed(_MARKED)}[(doc_id // 2 % 4 + 1)::INT] || text AS t FROM documents"
_SPACED = "regexp_replace(t, '(?i)\\b(dyrektywa|directive|rozporządzenie|regulation)\\b', '\\1  ')"
_SWAP = " ".join(f"WHEN contains(t, '{a}') THEN t[1:instr(t, '{a}') - 1] || '{b}' || t[instr(t, '{a}') + {len(a)}:]" for a, b in watermarks.SYNONYMS.items())


def _marked(spark, sf):
    return load(spark, sf, "documents").select("doc_id", F.concat(F.get(F.array(*map(F.lit, _MARKED)), (F.floor(F.col("doc_id") / 2) % 4).cast("int")), F.col("text")).alias("t"))


@query(f"WITH d AS ({_TEXT}) SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN {_SPACED} ELSE CASE {_SWAP} ELSE {_SPACED} END END) AS marked FROM d")
def watermark_inject(spark, sf):
    return _marked(spark, sf).select("doc_id", F.md5(watermarks.inject(F.col("t"), F.col("doc_id"))).alias("marked"))


_SHOWN = " OR ".join(["regexp_matches(t, '(?i)\\b(dyrektywa|directive|rozporządzenie|regulation)  ')", *(f"contains(t, '{b}')" for b in watermarks.SYNONYMS.values())])


@query(f"""WITH d AS ({_TEXT}), m AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN t ELSE CASE WHEN doc_id % 2 = 0 THEN {_SPACED} ELSE CASE {_SWAP} ELSE {_SPACED} END END END AS t FROM d)
SELECT doc_id, sha256('acme|b1|' || doc_id || '|key') AS hash, {_SHOWN} AS verified FROM m WHERE doc_id % 10 = 9""")
def watermark_registry(spark, sf):
    """Every tenth record should bear a mark; a third of the texts has none."""
    texts = _marked(spark, sf)
    texts = texts.withColumn("t", F.when(F.col("doc_id") % 3 == 0, F.col("t")).otherwise(watermarks.inject(F.col("t"), F.col("doc_id"))))
    return watermarks.registry(texts, "doc_id", "t", "acme", "b1", 10, "key")


_KEYED = " OR ".join(f"contains(t, '{w}')" for ws in watermarks.KEYED.values() for w in ws)


@query(f"""WITH d AS ({_TEXT}), m AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN t || chr(8203) ELSE t END AS t FROM d), f AS (SELECT doc_id, contains(t, chr(8203)) AS z, {_KEYED} AS s FROM m)
SELECT doc_id, CASE WHEN z AND s THEN 'both' WHEN z THEN 'zwc' WHEN s THEN 'synonym' ELSE 'none' END AS technique, CASE WHEN z AND s THEN 0.95 WHEN z THEN 0.80 WHEN s THEN 0.60 ELSE 0.0 END::DOUBLE AS confidence FROM f""")
def watermark_detect(spark, sf):
    texts = _marked(spark, sf).withColumn("t", F.when(F.col("doc_id") % 5 == 0, F.concat("t", F.lit("​"))).otherwise(F.col("t")))
    return texts.select("doc_id", watermarks.detect(F.col("t")).alias("d")).select("doc_id", "d.*")


@query()
def watermark_keyed(spark, sf):
    """Keyed marks in every document, and whether they verify; held against the rule in a test."""
    return watermarks.embed(_marked(spark, sf), "doc_id", "t", "acme", "b1", "key")


@query("""SELECT client, batch, (client = 'acme' AND batch = 'b1') AS found FROM (VALUES ('acme', 'b1'), ('acme', 'b2'), ('other', 'b1')) t(client, batch)
WHERE (SELECT count(*) FROM documents WHERE doc_id % 10 = 3 AND len(regexp_extract_all(text, '\\s+')) >= 8) > 0""")
def watermark_votes(spark, sf):
    """Whose keyed marks a tenth of the documents bears, after every text has lost its second half and a word."""
    marked = watermarks.embed(_marked(spark, sf), "doc_id", "t", "acme", "b1", "key").where("doc_id % 10 = 3")
    edited = marked.select("doc_id", F.expr("regexp_replace(substring(marked, 1, length(marked) div 2), '[a-z]+ ', '')").alias("t"))
    found = watermarks.votes(edited, "doc_id", "t", [("acme", "b1"), ("acme", "b2"), ("other", "b1")], "key")
    return found.select("client", "batch", "found")


@query("SELECT tier, trust::DOUBLE AS trust, count(*) AS n FROM (SELECT ['S', 'A', 'B', 'C'][(page_id % 4 + 1)::INT] AS tier, [1.0, 0.8, 0.6, 0.3][(page_id % 4 + 1)::INT] AS trust FROM pages) GROUP BY ALL")
def tier_trust(spark, sf):
    tier = _pick("page_id", ("S", "A", "B", "C"))
    return load(spark, sf, "pages").select(tier.alias("tier")).withColumn("trust", rules.trust(F.col("tier"))).groupBy("tier", "trust").agg(F.count("*").alias("n"))


_WEAK = ("regulatory accuracy", "risk", "critical_thinking", "forward", "financial risk", "brevity", "esg_data quality", "practical")
_WEAK_SQL = f"SELECT doc_id, list_filter({_listed(_WEAK)}, lambda w, i: (doc_id // (i + 1)) % 3 = 0) AS weak FROM labels"


@query(f"""WITH w AS ({_WEAK_SQL}), p AS (SELECT unnest({_listed(rules.WEIGHED)}) AS perspective)
SELECT doc_id, perspective, round(least(1.0 + 0.3 * len(list_filter(weak, lambda w: contains(w, perspective) OR contains(perspective, w))), 2.0), 6)::DOUBLE AS weight
FROM w, p""")
def perspective_weights(spark, sf):
    """Weights of all perspectives after each report's weaknesses."""
    named = F.array(*map(F.lit, _WEAK))
    weak = F.filter(named, lambda w, i: F.floor(F.col("doc_id") / (i + 2)) % 3 == 0)
    return load(spark, sf, "labels").select("doc_id", F.explode(rules.perspective_weights(weak)).alias("perspective", "weight"))
