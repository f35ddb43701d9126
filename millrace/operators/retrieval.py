"""Retrieval: full-text rank, vector similarity, fused and diversified top-k, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.arrow import list_rows
from millrace.functions import text

#: Items whose similarities with a block of queries are held at once.
ITEMS = 500


def full_text(chunks: DataFrame, key: str, body: str, queries: DataFrame) -> DataFrame:
    """(query, key, rank) of chunks that hold all of a query's terms; rank: sum of 1 + ln(count) over the terms.

    The inverted index (term, key, count) is joined with the queries' terms; a common term is aggregated before it is joined.
    """
    terms = queries.select("query", F.explode(F.array_distinct(text.tokens(F.lower("text")))).alias("term"))
    wanted = terms.groupBy("query").agg(F.count("*").alias("need"))
    index = chunks.select(key, F.explode(text.tokens(F.lower(F.col(body)))).alias("term")).join(F.broadcast(terms.select("term").distinct()), "term", "left_semi")
    index = index.groupBy("term", key).agg(F.count("*").alias("tf"))
    hit = index.join(F.broadcast(terms), "term").groupBy("query", key).agg(F.count("*").alias("found"), F.sum(1 + F.log("tf")).alias("rank"))
    return hit.join(F.broadcast(wanted), "query").where("found = need").select("query", key, F.round("rank", 6).alias("rank"))


def vector_top_k(items: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """(query, key, similarity): the k most similar items of each query, ties by key."""
    return vector_neighbours(items, key, vector, queries, k)


def _by_length(vectors: list[list[float]]) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, matrix) of vectors, those of one length together."""
    lengths = np.array([len(v) for v in vectors], np.int64)
    places = [(int(n), np.flatnonzero(lengths == n)) for n in np.unique(lengths)]
    return [(n, own, np.array([vectors[i] for i in own], np.float64).reshape(len(own), n)) for n, own in places]


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms, and unit vectors in single precision: zeros for a zero norm, NaN for one that is not finite."""
    norm = np.sqrt((v * v).sum(axis=1))
    scale = np.where(np.isfinite(norm), norm, np.nan)
    return norm, (v / np.where(norm == 0, 1, scale)[:, None]).astype(np.float32)


def _leading(query: np.ndarray, item: np.ndarray, same: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best rows of each query, in order; NaN is greatest, as in a sort by Spark."""
    order = np.lexsort((item, np.where(np.isnan(same), -np.inf, -same), query))
    query, item, same = query[order], item[order], same[order]
    start = np.flatnonzero(np.concatenate(([True], query[1:] != query[:-1]))) if len(query) else np.empty(0, np.int64)
    rank = np.arange(len(query)) - np.repeat(start, np.diff(np.concatenate((start, [len(query)]))))
    return query[rank < k], item[rank < k], same[rank < k]


def _best(broadcast, k: int):
    """The k best items of a part for each query.

    Similarities in single precision, with room for their error, only say which items can still be among a query's k best; those few
    are computed in double precision and ranked.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, blocks = broadcast.value
        scaled = [(n, own, q, *_unit(q)) for n, own, q in blocks]
        least = np.full(len(ids), -np.inf)  # a query's k-th best so far
        best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
        waiting, n_waiting = [], 0
        for batch in batches:
            keys, rows = batch.column(0).to_numpy(zero_copy_only=False), list(list_rows(batch.column(1)))
            lengths = np.array([len(v) for v in rows], np.int64)
            for at in range(0, len(rows), 2 * ITEMS):
                part = np.arange(at, min(at + 2 * ITEMS, len(rows)))
                for n in np.unique(lengths[part]).tolist():
                    mine = part[lengths[part] == n]
                    v = np.array([rows[i] for i in mine], np.float64).reshape(len(mine), n)
                    norm, unit = _unit(v)
                    for m, own, q, norms, units in scaled:
                        if m != n:  # similarity 0
                            j, i = np.nonzero(np.broadcast_to(~(least[own, None] > 0), (len(own), len(mine))))
                            same = np.zeros(len(i))
                        else:
                            near, error = units @ unit.T, 1e-6 + (n + 8) * 1.2e-7
                            room = (least[own] - error).astype(np.float32)
                            able = ~(near < room[:, None])
                            if len(mine) > 4 * k and np.count_nonzero(able) > 4 * k * len(own):  # the first items: k of them set a bound
                                able = ~(near < np.fmax(room, np.partition(near, -k, axis=1)[:, -k] - 2 * error)[:, None])
                            j, i = np.nonzero(able)
                            both = norms[j] * norm[i]
                            same = np.divide((q[j] * v[i]).sum(axis=1), both, out=np.zeros(len(i)), where=both != 0)
                            same = np.copysign(np.floor(np.abs(same) * 1e6 + 0.5) / 1e6, same) + 0.0
                        waiting.append((own[j], keys[mine[i]], same))
                        n_waiting += len(i)
                if n_waiting > 100_000:
                    best, waiting, n_waiting = _leading(*map(np.concatenate, zip(best, *waiting, strict=True)), k), [], 0
                    last = np.flatnonzero(np.bincount(best[0], minlength=len(ids)) == k)
                    least[last] = best[2][np.searchsorted(best[0], last, "right") - 1]
        query, item, same = _leading(*map(np.concatenate, zip(best, *waiting, strict=True)), k)
        yield pa.RecordBatch.from_arrays([pa.array(ids[query]), pa.array(item), pa.array(same)], ["query", "item", "similarity"])

    return run


def vector_neighbours(items: DataFrame, key: str, vector: str, queries: DataFrame, k: int, block: int = 2000) -> DataFrame:
    """(query, key, similarity): the k most similar items of each query, ties by key, for any number of queries.

    Queries (query, vector) are read in blocks, which bounds what is broadcast; each block is one pass over the items, which are dealt
    out evenly, however few files hold them.  A part of the items hands on its k best of each query.  Null vectors are left out; keys
    and queries are numbers.
    """
    context, out, ids, vectors = items.sparkSession.sparkContext, None, [], []
    rows = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    rows = rows.repartition(context.defaultParallelism, "key")

    def search() -> DataFrame:
        held = context.broadcast((np.array(ids, np.int64), _by_length(vectors)))
        return rows.mapInArrow(_best(held, k), "query long, item long, similarity double")

    for q, v in queries.select("query", F.col("vector").cast("array<double>")).where("vector is not null").toLocalIterator(prefetchPartitions=False):
        ids.append(q)
        vectors.append(v)
        if len(ids) >= block:
            found = search()
            out, ids, vectors = found if out is None else out.unionByName(found), [], []
    if ids or out is None:
        found = search()
        out = found if out is None else out.unionByName(found)
    own = W.partitionBy("query").orderBy(F.desc("similarity"), "item")
    return out.withColumn("k", F.row_number().over(own)).where(F.col("k") <= k).select("query", F.col("item").alias(key), "similarity")


def _near(broadcast, threshold: float):
    """Items of a part at or above the threshold with each query: similarities of a few items with the whole block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, matrix = broadcast.value
        unit = matrix / np.maximum(np.sqrt((matrix * matrix).sum(axis=1)), 1e-300)[:, None] if len(ids) else matrix
        for batch in batches:
            keys, rows = np.array(batch.column(0).to_pylist(), np.int64), batch.column(1).to_pylist()
            for at in range(0, len(rows) if len(ids) else 0, ITEMS):
                part = np.array(rows[at : at + ITEMS], np.float64)
                norm = np.sqrt((part * part).sum(axis=1))
                same = np.round((part / np.where(norm == 0, 1, norm)[:, None]) @ unit.T, 6)
                item, query = np.nonzero(same >= threshold)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(ids)[query]), pa.array(keys[at : at + ITEMS][item]), pa.array(same[item, query])], ["query", "item", "similarity"])

    return run


def cosine_links(items: DataFrame, key: str, vector: str, queries: DataFrame, threshold: float, block: int = 2000) -> DataFrame:
    """(query, key, similarity): all items at least so similar to a query, itself left out; queries (query, vector) are a stated set.

    Queries are read in blocks, which bounds what is broadcast; each block is one pass over the items, and none is cut off.  Vectors
    have one length; null ones are left out.
    """
    context, out, ids, vectors = items.sparkSession.sparkContext, None, [], []
    rows = items.select(F.col(key).cast("long"), F.col(vector).cast("array<double>").alias("v")).where(F.col("v").isNotNull())

    def search() -> DataFrame:
        return rows.mapInArrow(_near(context.broadcast((list(ids), np.array(vectors, np.float64))), threshold), "query long, item long, similarity double")

    for q, v in queries.select("query", F.col("vector").cast("array<double>")).where("vector is not null").toLocalIterator(prefetchPartitions=False):
        ids.append(q)
        vectors.append(v)
        if len(ids) >= block:
            found = search()
            out, ids, vectors = found if out is None else out.unionByName(found), [], []
    if ids or out is None:
        found = search()
        out = found if out is None else out.unionByName(found)
    return out.where("query <> item").select("query", F.col("item").alias(key), "similarity")


def reranked(candidates: DataFrame, score: Column, k: int, key: str, most: int = 512) -> DataFrame:
    """(query, key, score): the k best of each query's candidates by an injected score of ``cut``, the first 512 characters of the body."""
    own = W.partitionBy("query").orderBy(F.desc("score"), key)
    scored = candidates.withColumn("cut", F.substring("body", 1, most)).select("query", key, F.round(score, 6).alias("score"))
    return scored.withColumn("k", F.row_number().over(own)).where(F.col("k") <= k).drop("k")


def fuse(by_vector: DataFrame, by_text: DataFrame, key: str, vector_weight: float, text_weight: float, k: int) -> DataFrame:
    """(query, key, score): full outer join of both candidate lists, weighted sum, top k with ties by key."""
    both = by_vector.join(by_text, ["query", key], "full_outer")
    score = vector_weight * F.coalesce("similarity", F.lit(0.0)) + text_weight * F.coalesce("rank", F.lit(0.0))
    own = W.partitionBy("query").orderBy(F.desc("score"), key)
    return both.select("query", key, F.round(score, 6).alias("score")).withColumn("k", F.row_number().over(own)).where(F.col("k") <= k).drop("k")


def diversify(ranked: DataFrame, group: list[str], key: str, most: int, k: int) -> DataFrame:
    """At most ``most`` rows of a group in rank order, then the first k."""
    inside = W.partitionBy("query", *group).orderBy(F.desc("score"), key)
    own = W.partitionBy("query").orderBy(F.desc("score"), key)
    return ranked.withColumn("g", F.row_number().over(inside)).where(F.col("g") <= most).withColumn("k", F.row_number().over(own)).where(F.col("k") <= k).drop("g", "k")


def weights(kind: str, vector: float = 0.6, full_text_: float = 0.4) -> tuple[float, float]:
    """Adaptive weights by question type; they sum to 1."""
    if kind in ("scope", "compliance"):
        full_text_ += 0.2
    if kind in ("comparative", "process"):
        vector += 0.2
    total = vector + full_text_
    return vector / total, full_text_ / total
