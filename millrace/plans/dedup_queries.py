"""Queries of exact and near-duplicate detection over questions, benchmark items and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import urls
from millrace.functions.text import let
from millrace.operators import dedup, similarity
from millrace.plans.core import query
from millrace.session import written
from millrace.sources.tables import load

_W = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')"


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies, sha256(text) AS file_hash FROM documents GROUP BY sha256(text)")
def exact_dedup(spark, sf):
    return load(spark, sf, "documents").groupBy(F.sha2("text", 256).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


_SIM = f"""w AS (SELECT item_id, {_W} AS ws FROM benchmark), f AS (SELECT item_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS f FROM w),
h AS (SELECT item_id, md5(f) AS m FROM f), b AS (SELECT item_id, i, sum(CASE WHEN (('0x' || m[(1 + 8 * (i // 32))::INT:(8 + 8 * (i // 32))::INT])::BIGINT >> (31 - i % 32)::INT) & 1 = 1 THEN 1 ELSE -1 END) AS v FROM h, range(64) t(i) GROUP BY item_id, i),
sim AS (SELECT item_id, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS simhash FROM b GROUP BY item_id)"""


@query(f"WITH {_SIM} SELECT item_id, simhash FROM sim")
def simhash_items(spark, sf):
    return dedup.simhash(load(spark, sf, "benchmark"), "item_id", "text")


_PLANTED = "(SELECT item_id * 2 AS item_id, text FROM benchmark UNION ALL SELECT item_id * 2 + 1, text || ' once more' FROM benchmark)"


@query(f"""WITH {_SIM.replace('FROM benchmark', f'FROM {_PLANTED}')}, c AS (SELECT simhash, min(item_id) AS r FROM sim GROUP BY simhash)
SELECT * FROM (SELECT x.r AS a, y.r AS b, hamming(x.simhash, y.simhash)::INT AS distance FROM c x JOIN c y ON x.r < y.r) WHERE distance <= 7
UNION ALL SELECT r, item_id, 0 FROM sim JOIN c USING (simhash) WHERE r < item_id""")
def simhash_neighbours(spark, sf):
    """Near pairs among all items and a copy of each with two words more."""
    items = load(spark, sf, "benchmark").select(F.explode(F.array(F.struct((F.col("item_id") * 2).alias("item_id"), "text"), F.struct((F.col("item_id") * 2 + 1).alias("item_id"), F.concat("text", F.lit(" once more")).alias("text")))).alias("x")).select("x.*")
    return dedup.simhash_pairs(dedup.simhash(items, "item_id", "text"), "item_id", 7)


_MIN = f"""w AS (SELECT item_id, {_W} AS ws FROM benchmark), s AS (SELECT item_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS g FROM w)"""


@query(f"WITH {_MIN} SELECT item_id, array_to_string(list_transform(range(128), lambda p: list_min(list_transform(g, lambda x: md5(p || '|' || x)))[1:8]), ',') AS signature FROM s")
def minhash_signatures(spark, sf):
    sig = load(spark, sf, "benchmark").select("item_id", dedup.minhash(F.col("text")).alias("s"))
    return sig.select("item_id", F.array_join(F.transform("s", lambda x: F.substring(x, 1, 8)), ",").alias("signature"))


@query("""WITH u AS (SELECT DISTINCT conv_id, turn, trim(text) AS t FROM conversations WHERE role = 'user') SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY conv_id, turn) AS k FROM u) WHERE k = 1""")
def first_question_wins(spark, sf):
    u = load(spark, sf, "conversations").where("role = 'user'")
    return u.groupBy(F.trim("text").alias("t")).agg(F.min(F.struct("conv_id", "turn")).alias("x")).select("x.conv_id", "x.turn")


@query(f"""WITH w AS (SELECT conv_id, turn, list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS g FROM (SELECT conv_id, turn, {_W} AS ws FROM conversations WHERE role = 'user'))
SELECT a.conv_id, a.turn, max(round(len(list_intersect(a.g, b.g)) / greatest(len(list_distinct(list_concat(a.g, b.g))), 1), 6)) AS nearest FROM w a JOIN w b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY ALL""")
def question_loops(spark, sf):
    """Greatest bigram Jaccard with an earlier question of the conversation."""
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    grams = F.array_distinct(let(w, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))))
    u = load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", grams.alias("g"))
    b = u.select("conv_id", F.col("turn").alias("t"), F.col("g").alias("h"))
    near = F.size(F.array_intersect("g", "h")) / F.greatest(F.size(F.array_union("g", "h")), F.lit(1))
    return u.join(b, "conv_id").where("t < turn").groupBy("conv_id", "turn").agg(F.max(F.round(near, 6)).alias("nearest"))


@query()
def near_duplicate_questions(spark, sf):
    """All user questions, in order of conversation and turn, with the greedy filter's decision."""
    u = load(spark, sf, "conversations").where("role = 'user'").select(F.struct("conv_id", "turn", "text").alias("id"), "text").distinct()
    found = dedup.near_duplicates(u, "id", "text", lambda d: written(d, "near-questions"))
    return found.select("id.conv_id", "id.turn", "kept")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, trim(text) AS t FROM documents UNION ALL SELECT item_id + 1000000, trim(text) FROM benchmark) WHERE sha256(t) NOT IN (SELECT sha256(trim(text)) FROM benchmark WHERE item_id % 2 = 0) GROUP BY sha256(t)")
def preloaded_ids(spark, sf):
    """Documents and items, once each, without what a set that is known already (every second item) has."""
    key = F.sha2(F.trim("text"), 256).alias("key")
    items = load(spark, sf, "benchmark")
    known = items.where("item_id % 2 = 0").select(key)
    rows = load(spark, sf, "documents").select("doc_id", key).unionByName(items.select((F.col("item_id") + 1_000_000).alias("doc_id"), key))
    return rows.join(known, "key", "left_anti").groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("key")


def _jaccard_sql(sets: str, threshold: float) -> str:
    """All pairs of unlike sets at least so similar, and each row of an equal set with the first, from a table s(id, g) of sorted sets."""
    return f"""WITH s AS ({sets}), c AS (SELECT g, min(id) AS r FROM s WHERE len(g) > 0 GROUP BY g),
f AS (SELECT r, unnest(g) AS x FROM c), o AS (SELECT a.r AS a, b.r AS b, count(*) AS n FROM f AS a JOIN f AS b ON a.x = b.x AND a.r < b.r GROUP BY ALL),
p AS (SELECT a, b, n / (len(x.g) + len(y.g) - n) AS similarity FROM o JOIN c AS x ON x.r = a JOIN c AS y ON y.r = b)
SELECT a, b, round(similarity, 6) AS similarity FROM p WHERE similarity >= {threshold}
UNION ALL SELECT r, id, 1.0 FROM s JOIN c USING (g) WHERE r < id"""


_BIGRAMS = f"""SELECT conv_id * 10000000 + turn AS id, list_sort(list_distinct(list_transform(range(1, len(ws)), lambda i: conv_id || '|' || ws[i] || '_' || ws[i + 1]))) AS g
FROM (SELECT conv_id, turn, {_W} AS ws FROM (
    SELECT conv_id, turn, min(text) AS text FROM conversations WHERE role = 'user' GROUP BY ALL
    UNION ALL SELECT conv_id, turn + 1000000, min(text) || CASE WHEN turn % 2 = 0 THEN ' why not' ELSE '' END FROM conversations WHERE role = 'user' GROUP BY conv_id, turn))"""


@query(_jaccard_sql(_BIGRAMS, 0.6))
def question_repeats(spark, sf):
    """Questions of one conversation that share most of their word pairs, each pair once, copies with the first; every question is asked a
    second time, every other one with two words more."""
    u = load(spark, sf, "conversations").where("role = 'user'").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    tail = F.when(F.col("turn") % 2 == 0, " why not").otherwise("")
    u = u.unionByName(u.select("conv_id", (F.col("turn") + 1_000_000).alias("turn"), F.concat("text", tail).alias("text")))
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    pair = lambda w: lambda x, i: F.concat(F.col("conv_id").cast("string"), F.lit("|"), x, F.lit("_"), F.get(w, i + 1))
    grams = let(w, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), pair(w)))
    rows = u.select((F.col("conv_id") * 10_000_000 + F.col("turn")).alias("id"), grams.alias("g"))
    found = similarity.jaccard_pairs(rows, "id", "g", 0.6, lambda d: written(d, "repeats"))
    return found.withColumn("similarity", F.round("similarity", 6))


_TRIGRAMS = f"""SELECT item_id AS id, list_sort(list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]))) AS g
FROM (SELECT item_id, {_W} AS ws FROM {_PLANTED} UNION ALL SELECT 1000000 + conv_id * 10000000 + turn, {_W} FROM (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY ALL))"""


@query(_jaccard_sql(_TRIGRAMS, 0.75))
def similar_texts(spark, sf):
    """All pairs of items, altered items and turns of conversations with a Jaccard similarity of word triples of at least 0.75."""
    items = load(spark, sf, "benchmark")
    twice = items.select((F.col("item_id") * 2).alias("id"), "text").unionByName(items.select((F.col("item_id") * 2 + 1).alias("id"), F.concat("text", F.lit(" once more")).alias("text")))
    turns = load(spark, sf, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    rows = twice.unionByName(turns.select((F.col("conv_id") * 10_000_000 + F.col("turn") + 1_000_000).alias("id"), "text"))
    w = F.filter(F.split(F.lower("text"), r"\s+"), lambda x: x != "")
    triple = lambda w: lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1), F.lit(" "), F.get(w, i + 2))
    rows = rows.select("id", let(w, lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))), triple(w))).alias("g"))
    found = similarity.jaccard_pairs(rows, "id", "g", 0.75, lambda d: written(d, "similar"))
    return found.withColumn("similarity", F.round("similarity", 6))


@query()
def staged_sources(spark, sf):
    """Three stages over pages (URL, title of the page, the vector of the same number): which of them drops each; held by a test."""
    pages = load(spark, sf, "pages").select(F.col("page_id").alias("id"), "url", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"))
    both = pages.join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), "id", "left")
    return dedup.staged_with_meaning(both, "id", urls.fingerprint(F.col("url")), "title", "v", lambda d: written(d, "stages"))
