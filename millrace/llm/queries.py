"""Queries of the operators in this subpackage, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    decontaminate,
    importance,
    lloyd,
    minhash,
    quality_rules,
    secrets,
    sentencepiece_scan,
    sharding,
    spelling,
    spherical_caps,
    suffix_dedup,
    token_counts,
    token_files,
)
from millrace.llm.common import table

UNIGRAM_VOCABULARY, TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def wanted_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("wanted"))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary_path(UNIGRAM_VOCABULARY))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 8)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.classify(table(spark, sf_dir, "documents"), wanted_labels(spark, sf_dir))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaking_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.substring_dedup(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(table(spark, sf_dir, "documents"), vocabulary_path(UNIGRAM_VOCABULARY), with_ids=False)


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(table(spark, sf_dir, "documents"), secrets.train(secrets.samples(spark)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read_token_files(token_files.write_token_files(table(spark, sf_dir, "documents"), vocabulary_path(TOKENIZER)))


def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op11_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spherical_caps.near_vectors(table(spark, sf_dir, "embeddings"))


def op12_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lloyd.lloyd(table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))


_ALL = (
    op1_token_counts,
    op2_sharding,
    op3_quality_rules,
    op4_quality_classifier,
    op5_decontamination,
    op6_suffix_dedup,
    op7_sentencepiece,
    op8_secret_scan,
    op9_token_files,
    op10_minhash,
    op11_embedding_dedup,
    op12_lloyd,
    op13_spelling_variants,
)
QUERIES = {f.__name__: f for f in _ALL}

_WORD = r"[^\x20\x09-\x0D]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws FROM d),
p AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
g AS (SELECT doc_id, i, x, lead(x) OVER o AS x1, lead(x, 2) OVER o AS x2 FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x, x1, x2) AS n FROM g WHERE x2 IS NOT NULL),
c AS (SELECT doc_id, count(DISTINCT j) AS k FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '{quality_rules.SYMBOLS}', '', 'g')))::BIGINT AS n_symbols,
    (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::BIGINT AS n_capitals,
    len(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}'))))::BIGINT AS n_distinct_lines,
    coalesce(k, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in quality_rules.STOP_WORDS)})))::BIGINT AS n_stop_words,
    len(list_distinct(ws))::BIGINT AS n_distinct_words
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
q AS (
  SELECT *, n_lines - n_distinct_lines AS n_dup_lines, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN word_chars / greatest(n_words, 1) < 2.0 OR word_chars / greatest(n_words, 1) > 14.0 THEN 'word_length' END AS r1,
    CASE WHEN n_symbols / greatest(n_words, 1) > 0.3 THEN 'symbols' END AS r2,
    CASE WHEN n_stop_words / greatest(n_words, 1) < 0.01 THEN 'stop_words' END AS r3,
    CASE WHEN (n_lines - n_distinct_lines) / greatest(n_lines, 1) > 0.5 THEN 'duplicate_lines' END AS r4,
    CASE WHEN n_capitals / greatest(word_chars, 1) > 0.6 THEN 'capitals' END AS r5,
    CASE WHEN n_distinct_words / greatest(n_words, 1) < 0.05 THEN 'one_word' END AS r6
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(r1, r2, r3, r4, r5, r6) IS NULL AS kept, concat_ws(',', r1, r2, r3, r4, r5, r6) AS broken
FROM q"""


OP11_SQL = f"""
WITH RECURSIVE
v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0
    AND len(list_filter(embedding, lambda y: y <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE list_cosine_similarity(a.x, b.x) >= {spherical_caps.THRESHOLD}),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id,
  vec_id = coalesce(component_id, vec_id) AS kept
FROM embeddings LEFT JOIN least ON least.a = vec_id LEFT JOIN n ON n.a = vec_id
"""


def _lloyd_sql(k: int = lloyd.CLUSTERS, dim: int = lloyd.DIM, rounds: int = lloyd.ROUNDS) -> str:
    """One pair of tables for each round: distances and nearest centroids, then new centroids, in long form."""
    steps = [
        f"""WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda y: floor({lloyd.SCALE} * y::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
flat AS MATERIALIZED (SELECT vec_id, unnest(x) AS x, generate_subscripts(x, 1) AS i FROM kept),
first AS (
  SELECT row_number() OVER (ORDER BY sha256('{lloyd.SEED}:' || vec_id)) - 1 AS c, x FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('{lloyd.SEED}:' || vec_id)) <= {k}),
c0 AS MATERIALIZED (SELECT c, unnest(x) AS m, generate_subscripts(x, 1) AS i FROM first)"""
    ]
    for r in range(rounds + 1):
        steps.append(f"""d{r} AS (SELECT vec_id, c, sum((x - m) * (x - m))::BIGINT AS d FROM flat JOIN c{r} USING (i) GROUP BY ALL),
a{r} AS MATERIALIZED (SELECT vec_id, min(struct_pack(d := d, c := c)) AS best FROM d{r} GROUP BY vec_id)""")
        if r < rounds:
            steps.append(f"""s{r} AS (SELECT best.c AS c, i, sum(x)::BIGINT AS s, count(*) AS n FROM flat JOIN a{r} USING (vec_id) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (
  SELECT c{r}.c, c{r}.i, coalesce((s - ((s % n) + n) % n) // n, m) AS m FROM c{r} LEFT JOIN s{r} ON s{r}.c = c{r}.c AND s{r}.i = c{r}.i)""")
    return ",\n".join(steps) + f""",
h AS (SELECT c, sha256(string_agg(m::VARCHAR, ',' ORDER BY i)) AS centroid_sha256 FROM c{rounds} GROUP BY c)
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.c))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, centroid_sha256
FROM a{rounds} JOIN h ON h.c = best.c"""


def _crc_table() -> list[int]:
    """The 256 remainders of CRC-32, by its rule (reflected polynomial)."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return out


OP13_SQL = rf"""
WITH RECURSIVE
runs AS (
  SELECT coalesce(doc_id::VARCHAR, 'null') AS doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents),
each AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL),
crc AS (SELECT {_crc_table()}::UBIGINT[] AS t),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END)) AS b FROM each),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(4294967295::UBIGINT, b::UBIGINT[]),
    lambda c, y: xor(c >> 8, t[(xor(c, y) & 255)::INTEGER + 1])), 4294967295::UBIGINT) AS h FROM bytes, crc),
words AS MATERIALIZED (
  SELECT CASE WHEN h % {spelling.TYPO_EVERY} = 0 THEN substr(run, 1, (h % length(run))::INTEGER) || substr(run, (h % length(run))::INTEGER + 2)
    ELSE run END AS word, sum(n)::BIGINT AS n FROM hashed GROUP BY 1
  HAVING length(word) >= {spelling.SHORTEST} AND sum(n) >= {spelling.LEAST}),
cuts AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
inserted AS (SELECT DISTINCT words.word AS a, cuts.word AS b FROM words JOIN cuts ON words.word = rest),
near AS (
  SELECT a.word AS a, b.word AS b FROM cuts AS a JOIN cuts AS b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION ALL SELECT a, b FROM inserted UNION ALL SELECT b, a FROM inserted),
best AS (SELECT a, count(*) AS n_near, min(struct_pack(m := -n, w := b)) AS m FROM near JOIN words ON b = word GROUP BY a),
forms AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -m.m >= {spelling.RATIO} * n THEN m.w END AS form,
    CASE WHEN -m.m >= {spelling.RATIO} * n THEN -m.m END::BIGINT AS form_n FROM words LEFT JOIN best ON a = word),
walk AS (
  SELECT word, word AS root FROM forms
  UNION SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.root WHERE form IS NOT NULL)
SELECT f.word, f.form, root, f.n, f.n_near, f.form_n
FROM walk JOIN forms AS f ON f.word = walk.word JOIN forms AS e ON e.word = root AND e.form IS NULL"""


ORACLE_SQL = {
    "op3_quality_rules": OP3_SQL,
    "op11_embedding_dedup": OP11_SQL,
    "op12_lloyd": _lloyd_sql(),
    "op13_spelling_variants": OP13_SQL,
}
