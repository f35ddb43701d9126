"""Queries of retrieval, vectors and the entity graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import graph, postings, retrieval
from millrace.plans.core import query
from millrace.sources.tables import load

#: Vector queries are all rows whose id is divisible by 20; each takes the next of the stated texts.
_EVERY = 20
VEC = f"""q AS (SELECT vec_id AS query, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % {_EVERY} = 0),
v AS (SELECT query, vec_id,
    round(list_dot_product(embedding::DOUBLE[], qv) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(qv, qv))), 6) AS similarity
  FROM embeddings, q),
vt AS (SELECT query, vec_id, similarity FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, vec_id) AS k FROM v) WHERE k <= 20)"""
#: Stated text queries: one for each vector query.
_TEXTS = ["the and", "of the", "in with", "de la", "der die", "for that", "is to", "que en"]
FTS = f"""qt AS (SELECT unnest(range({len(_TEXTS)})) AS query, unnest({_TEXTS}) AS t),
qw AS (SELECT query, unnest(list_distinct(regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}_]+'))) AS term FROM qt),
qn AS (SELECT query, count(*) AS need FROM qw GROUP BY 1),
ix AS (
  SELECT doc_id, term, count(*) AS tf
  FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM documents)
  WHERE term IN (SELECT term FROM qw) GROUP BY ALL),
ft AS (
  SELECT query, doc_id, round(sum(1 + ln(tf)), 6) AS rank FROM ix JOIN qw USING (term) JOIN qn USING (query)
  GROUP BY query, doc_id, need HAVING count(*) = need)"""
_INDEXES: dict[tuple[str, str], postings.Postings] = {}


def text_index(spark, sf) -> postings.Postings:
    """The inverted index of the documents, built once a session: they are read and cut into terms once."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _INDEXES:
        _INDEXES[place] = postings.Postings.build(load(spark, sf, "documents"), "doc_id", "text")
    return _INDEXES[place]


def vector_queries(spark, sf):
    return load(spark, sf, "embeddings").where(F.col("vec_id") % _EVERY == 0).select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector"))


def _vector(spark, sf):
    return retrieval.vector_top_k(load(spark, sf, "embeddings"), "vec_id", "embedding", vector_queries(spark, sf), 20)


def text_queries(spark):
    return spark.createDataFrame(list(enumerate(_TEXTS)), "query long, text string")


@query(f"WITH {VEC} SELECT query, vec_id, similarity FROM vt")
def vector_top_k(spark, sf):
    return _vector(spark, sf)


@query(f"WITH {FTS} SELECT query, doc_id, rank FROM ft")
def full_text_rank(spark, sf):
    return text_index(spark, sf).matches(text_queries(spark)).withColumnRenamed("key", "doc_id")


_HYBRID = f"""{VEC}, {FTS},
tt AS (SELECT query, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, doc_id) AS k FROM ft) WHERE k <= 20),
qq AS (SELECT q.query, doc_id, rank FROM q JOIN tt ON tt.query = q.query // {_EVERY} % {len(_TEXTS)}),
fu AS (SELECT coalesce(a.query, b.query) AS query, coalesce(a.vec_id, b.doc_id) AS id, round(0.7 * coalesce(similarity, 0) + 0.3 * coalesce(rank, 0), 6) AS score
  FROM vt a FULL JOIN qq b ON a.query = b.query AND a.vec_id = b.doc_id)"""


def _fused(spark, sf, k):
    v = _vector(spark, sf).withColumnRenamed("vec_id", "id")
    t = text_index(spark, sf).top(text_queries(spark), 20).select(F.col("query").alias("text_no"), F.col("key").alias("id"), "rank")
    asked = vector_queries(spark, sf).select("query", (F.floor(F.col("query") / _EVERY) % len(_TEXTS)).alias("text_no"))
    return retrieval.fuse(v, asked.join(t, "text_no").drop("text_no"), "id", 0.7, 0.3, k)


@query(f"WITH {_HYBRID} SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM fu) WHERE k <= 10")
def hybrid_search(spark, sf):
    return _fused(spark, sf, 10)


@query(f"""WITH {_HYBRID}, g AS (SELECT fu.*, row_number() OVER (PARTITION BY query, id % 4 ORDER BY score DESC, id) AS g FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM fu) WHERE k <= 40) fu)
SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM g WHERE g <= 2) WHERE r <= 6""")
def diversified_search(spark, sf):
    return retrieval.diversify(_fused(spark, sf, 40).withColumn("section", F.col("id") % 4), ["section"], "id", 2, 6).drop("section")


@query(f"WITH {VEC} SELECT query, vec_id, similarity FROM vt")
def vector_neighbours(spark, sf):
    """The 20 nearest of every vector whose id is divisible by 20."""
    return _vector(spark, sf)


@query(f"WITH {_HYBRID} SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM fu) WHERE k <= 10")
def hybrid_neighbours(spark, sf):
    return _fused(spark, sf, 10)


@query(f"""WITH {_HYBRID}, g AS (
  SELECT fu.*, row_number() OVER (PARTITION BY query, id % 4 ORDER BY score DESC, id) AS g
  FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS k FROM fu) WHERE k <= 40) fu)
SELECT query, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS r FROM g WHERE g <= 2) WHERE r <= 6""")
def diversified_neighbours(spark, sf):
    return retrieval.diversify(_fused(spark, sf, 40).withColumn("section", F.col("id") % 4), ["section"], "id", 2, 6).drop("section")


@query("WITH u AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding::DOUBLE[]) AS x FROM embeddings) SELECT label, pos - 1 AS pos, round(avg(x), 5) AS mean FROM u GROUP BY label, pos")
def label_centroids(spark, sf):
    u = load(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return u.groupBy("label", F.col("pos").cast("long").alias("pos")).agg(F.round(F.avg(F.col("x").cast("double")), 5).alias("mean"))


_ENT = "m AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{6,}'))) AS name FROM documents)"


@query(f"WITH {_ENT} SELECT name, count(*) AS n_docs, min(doc_id) AS first_doc, sha1(lower(name))[1:12] AS entity_id FROM m GROUP BY name")
def entities(spark, sf):
    return graph.entities(load(spark, sf, "documents"), "doc_id", "text")


@query("""WITH s AS (SELECT conv_id, turn, list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]{4,}'))) AS e FROM conversations), p AS (SELECT unnest(list_transform(range(1, len(e)), lambda i: list_transform(range(i + 1, len(e) + 1), lambda j: {'a': e[i], 'b': e[j]}))) AS ps FROM s WHERE len(e) > 1), f AS (SELECT unnest(ps) AS p FROM p)
SELECT p.a AS source, p.b AS target, count(*) AS weight FROM f GROUP BY ALL""")
def co_occurrence(spark, sf):
    """Pairs of names in one turn, each pair once."""
    return graph.co_occurrence(load(spark, sf, "conversations"), "text", "[A-Z][a-z]{4,}")


@query("""SELECT vec_id, len(embedding)::BIGINT AS dims, round(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]), 4) AS square_norm,
  (list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0)::INT AS zero, len(embedding) = 64 AS right_size FROM embeddings""")
def vector_check(spark, sf):
    """Dimension and norm of every vector: a zero norm or another dimension makes its similarities 0."""
    square = F.aggregate(F.transform("embedding", lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, x: a + x)
    dims = F.size("embedding")
    return load(spark, sf, "embeddings").select("vec_id", dims.cast("long").alias("dims"), F.round(square, 4).alias("square_norm"), (square == 0).cast("int").alias("zero"), (dims == 64).alias("right_size"))


@query("""SELECT role, count(*) AS n, count(*) FILTER (len(list_intersect(regexp_split_to_array(lower(text), '\\s+'), ['not', 'no', 'never', 'nicht', 'ne', 'no'])) > 0) AS negated FROM conversations GROUP BY role""")
def negation_parity(spark, sf):
    return load(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(graph.negated(F.col("text"), ("not", "no", "never", "nicht", "ne"))).alias("negated"))




_EDGES = """n AS (SELECT 'customer ' || c_custkey AS name, 'ORG' AS kind FROM customer UNION ALL SELECT DISTINCT o_orderpriority, 'LAW' FROM orders),
m AS (SELECT 'customer ' || o_custkey AS source, o_orderpriority AS target, o_orderstatus AS relation, max(o_orderkey % 100 / 100.0)::DOUBLE AS confidence
  FROM orders GROUP BY ALL)"""


def _order_graph(spark, sf):
    """Customers (organisations) that ask for orders of a priority (five hubs), each order an edge."""
    orders = load(spark, sf, "orders")
    name = F.concat(F.lit("customer "), F.col("o_custkey").cast("string"))
    edges = orders.select(name.alias("source"), F.col("o_orderpriority").alias("target"), F.col("o_orderstatus").alias("relation"), (F.col("o_orderkey") % 100 / 100).alias("confidence"), "o_orderkey")
    people = load(spark, sf, "customer").select(F.concat(F.lit("customer "), F.col("c_custkey").cast("string")).alias("name"), F.lit("ORG").alias("kind"))
    return edges, people.unionByName(orders.select(F.col("o_orderpriority").alias("name"), F.lit("LAW").alias("kind")).distinct())


@query(f"""WITH {_EDGES}, b AS (SELECT source AS name, 'outgoing' AS direction, target AS other, relation, confidence FROM m
  UNION ALL SELECT target, 'incoming', source, relation, confidence FROM m)
SELECT n.name, kind, direction, other, relation, round(confidence, 4) AS confidence FROM n LEFT JOIN b ON n.name = b.name""")
def entity_lookups(spark, sf):
    """What the graph knows of every entity, hubs spread over many parts."""
    edges, nodes = _order_graph(spark, sf)
    return graph.lookups(nodes.select("name"), edges, nodes, hub=500).withColumn("confidence", F.round("confidence", 4))


@query(f"""WITH {_EDGES} SELECT 'entities' AS what, '' AS name, count(*) AS n FROM n UNION ALL SELECT 'relations', '', count(*) FROM m
UNION ALL SELECT 'documents', '', count(DISTINCT o_orderkey) FROM orders
UNION ALL SELECT 'entity kind', kind, count(*) FROM n GROUP BY kind UNION ALL SELECT 'relation kind', relation, count(*) FROM m GROUP BY relation""")
def graph_summary(spark, sf):
    """Numbers of entities, relations and documents, and by kind."""
    edges, nodes = _order_graph(spark, sf)
    named = nodes.select("name", "kind", F.lit(None).cast("long").alias("o_orderkey")).unionByName(
        edges.select(F.col("target").alias("name"), F.lit("LAW").alias("kind"), "o_orderkey")
    )
    return graph.summary(named, "o_orderkey", edges)
