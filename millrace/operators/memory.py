"""Long-term memory of facts: search with recency, contradictions, upserts, session summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.operators.retrieval import vector_neighbours

# Words that negate.
NEGATIONS = ("nie", "brak", "zakaz", "wyłączony", "niezgodny", "not", "no", "without")


def negates(text: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*map(F.lit, NEGATIONS)))


def fact_id(content: Column, source: Column) -> Column:
    return F.substring(F.sha2(F.concat(content, source), 256), 1, 16)


def point_id(fact: Column) -> Column:
    """The number of the first 8 hexadecimal digits of the id's md5."""
    return F.conv(F.substring(F.md5(fact), 1, 8), 16, 10).cast("long")


def upsert_points(base: DataFrame, new: DataFrame, order: str) -> DataFrame:
    """Points by id: the last of the new ones (by ``order``) replaces what is there."""
    last = new.groupBy("point_id").agg(F.max_by(F.struct(*[c for c in base.columns if c != "point_id"]), order).alias("row")).select("point_id", "row.*").select(base.columns)
    return base.join(last.select("point_id"), "point_id", "left_anti").unionByName(last)


def search(facts: DataFrame, queries: DataFrame, k: int, threshold: float = 0.0) -> DataFrame:
    """(query, fact, similarity): the k nearest facts (fact, vector) of each query (query, vector) at or above the threshold."""
    return vector_neighbours(facts, "fact", "vector", queries, k).where(F.col("similarity") >= threshold)


def recalled(found: DataFrame, facts: DataFrame, now: Column, k: int, recency: float = 0.2) -> DataFrame:
    """(query, fact, relevance): similarity and age, scaled by the oldest of a query's candidates, weighted; the k best, ties by fact."""
    aged = found.join(facts.select("fact", (now - F.col("created_at")).alias("age")), "fact")
    oldest = F.max("age").over(W.partitionBy("query"))
    share = 1 - F.col("age") / F.when(oldest == 0, 1.0).otherwise(oldest)
    scored = aged.withColumn("relevance", F.round((1 - recency) * F.col("similarity") + recency * share, 6))
    own = W.partitionBy("query").orderBy(F.desc("relevance"), "fact")
    return scored.withColumn("k", F.row_number().over(own)).where(F.col("k") <= k).select("query", "fact", "relevance")


def contradictions(found: DataFrame, facts: DataFrame) -> DataFrame:
    """(query, fact): near facts of which one negates and the other does not; ``facts`` has fact and content."""
    said = facts.select("fact", negates(F.col("content")).alias("negates"))
    asked = said.select(F.col("fact").alias("query"), F.col("negates").alias("own"))
    return found.where("query <> fact").join(said, "fact").join(asked, "query").where("negates <> own").select("query", "fact", "similarity")


def live(entries: DataFrame, now: Column, ttl: Column) -> DataFrame:
    """Entries of session memory that have not run out."""
    return entries.where(F.col("stored_at") + ttl > now)


def summaries(entries: DataFrame, session: str, order: str, content: str, most: int = 2000) -> DataFrame:
    """A session's facts in order, joined by a bar and cut to ``most`` characters; a cut one ends in dots.

    Facts are short-term entries of one session, which its owner bounds; a fact is cut to what a summary can show.
    """
    facts = F.sort_array(F.collect_list(F.struct(order, F.substring(content, 1, most + 1).alias("content"))))
    joined = F.array_join(F.transform(facts, lambda x: x["content"]), " | ")
    out = entries.groupBy(session).agg(joined.alias("s"))
    return out.select(session, F.when(F.length("s") > most, F.concat(F.substring("s", 1, most), F.lit("..."))).otherwise(F.col("s")).alias("summary"))
