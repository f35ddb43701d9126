"""Queries of the stored indexes: vectors by inverted file and product codes, texts by postings in blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import postings, vector_index
from millrace.plans.core import query
from millrace.plans.retrieval_queries import FTS, VEC, text_index, text_queries, vector_queries
from millrace.sources.tables import load

_K = 20
_INDEXES: dict[tuple[str, str], vector_index.VectorIndex] = {}


def _vectors(spark, sf) -> vector_index.VectorIndex:
    """The index of a table, built once a session."""
    place = (spark.sparkContext.applicationId, sf)
    if place not in _INDEXES:
        _INDEXES[place] = vector_index.VectorIndex.build(load(spark, sf, "embeddings"), "vec_id", "embedding", "embeddings")
    return _INDEXES[place]


@query()
def indexed_neighbours(spark, sf):
    """The 20 nearest of every vector whose id is divisible by 20, by the index: lists, codes, exact re-ranking."""
    return _vectors(spark, sf).search(vector_queries(spark, sf), _K).withColumnRenamed("item", "vec_id")


@query(f"WITH {VEC} SELECT query, vec_id, similarity FROM vt")
def indexed_neighbours_exact(spark, sf):
    """The same with all lists visited and no ranking by codes."""
    return _vectors(spark, sf).search(vector_queries(spark, sf), _K, exact=True).withColumnRenamed("item", "vec_id")


@query("SELECT count(*) AS queries, sum(least(20, (SELECT count(*) FROM embeddings)))::BIGINT AS wanted, TRUE AS reached FROM embeddings WHERE vec_id % 20 = 0")
def index_recall(spark, sf):
    """Recall of the index over all these queries against a scan of all rows: at least 0.9."""
    index, asked = _vectors(spark, sf), vector_queries(spark, sf)
    each = vector_index.recall(index.search(asked, _K), index.search(asked, _K, exact=True))
    return each.agg(F.count("*").alias("queries"), F.sum("wanted").alias("wanted"), (F.sum("hits") >= 0.9 * F.sum("wanted")).alias("reached"))


_TOP = "SELECT query, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank DESC, doc_id) AS k FROM ft) WHERE k <= 20"


@query(f"WITH {FTS} {_TOP}")
def indexed_text_top(spark, sf):
    """The 20 best documents of each text query; blocks whose maxima cannot reach them are skipped."""
    return text_index(spark, sf).top(text_queries(spark), _K).withColumnRenamed("key", "doc_id")


_CHANGED = "CASE WHEN doc_id % 10 = 0 THEN lang || ' and the ' || source || ' the of' WHEN doc_id % 10 = 1 THEN NULL ELSE text END"
_AFTER = FTS.replace("FROM documents)", f"FROM (SELECT doc_id, {_CHANGED} AS text FROM documents))")


def _upserted(spark, sf) -> postings.Postings:
    docs = load(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    index = postings.Postings.build(docs, "doc_id", "text")
    half = docs.where("doc_id % 10 = 0").select("doc_id", F.lit("the and the and of").alias("text"))
    index.upsert(half, "doc_id", "text")  # superseded by the next delta
    changed = F.when(F.col("doc_id") % 10 == 0, F.concat("lang", F.lit(" and the "), "source", F.lit(" the of")))
    index.upsert(docs.where("doc_id % 10 < 2").select("doc_id", changed.alias("text")), "doc_id", "text")
    return index


@query(f"WITH {_AFTER} SELECT query, doc_id, rank FROM ft")
def indexed_text_upserted(spark, sf):
    """Matches after two deltas: a fifth of the documents changed or emptied, the rest as built."""
    return _upserted(spark, sf).matches(text_queries(spark)).withColumnRenamed("key", "doc_id")


@query(f"WITH {_AFTER} {_TOP}")
def indexed_text_merged(spark, sf):
    """Top 20 after the deltas are merged into one generation."""
    return _upserted(spark, sf).merge().top(text_queries(spark), _K).withColumnRenamed("key", "doc_id")
