"""A stored vector index: an inverted file of centroids, product codes for the first ranking, exact re-ranking.

``VectorIndex.build`` fits centroids and code books on at most ``sample`` rows (those with the least hash of their key) and then
assigns every row to a list.  Lists are cut into segments of at most about ``SEGMENT`` rows, so a list that holds a third of all
rows is many tasks.  A search sends each query to its ``probes`` nearest lists; a task holds one segment, streams the queries past
it, ranks by codes, re-ranks the best ``depth`` exactly and hands on k rows a query.  ``probes`` and ``depth`` are set when
the index is built, as the least with which the sample's own neighbours are found at ``recall``; ``exact=True`` visits all lists and
ranks by the vectors alone.

Similarities are cosines in double precision, rounded to six digits, ties by key.  Keys are numbers; null vectors and those of
another length than ``dim`` are not indexed and ask nothing; a zero vector has the similarity 0 with all.
"""

from __future__ import annotations

import dataclasses
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.arrow import matrix
from millrace.session import shared_dir

SAMPLE, SEGMENT, CODES = 16_384, 20_000, 256


def unit(x: np.ndarray) -> np.ndarray:
    """Rows over their norms; zero rows stay zero."""
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.where(norm == 0, 1, norm)[:, None]


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


def centres(x: np.ndarray, k: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """k-means of a bounded sample; an empty centre keeps its place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        n = np.bincount(at, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """For each row the numbers of its k nearest centres, nearest first."""
    d = (c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


@dataclasses.dataclass(frozen=True)
class Model:
    """What is fitted: list centres, code books of each part of the dimensions, and how far a search goes."""

    lists: np.ndarray
    books: tuple[np.ndarray, ...]
    probes: int
    depth: int

    @property
    def dim(self) -> int:
        return self.lists.shape[1]

    def codes(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        rest, lo, out = x - self.lists[at], 0, []
        for book in self.books:
            out.append(nearest(rest[:, lo : lo + book.shape[1]], book, 1)[:, 0].astype(np.uint8))
            lo += book.shape[1]
        return np.stack(out, axis=1)

    def decoded(self, codes: np.ndarray, at: int) -> np.ndarray:
        return np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], axis=1) + self.lists[at]

    @staticmethod
    def fit(x: np.ndarray, lists: int, k: int, recall: float) -> Model:
        x = unit(x)
        c = centres(x, lists)
        at = nearest(x, c, 1)[:, 0]
        rest, parts = x - c[at], np.array_split(np.arange(x.shape[1]), max(1, x.shape[1] // 4))
        books = tuple(centres(rest[:, p], min(CODES, len(x)), rounds=5) for p in parts)
        model = Model(c, books, len(c), len(x))
        # how far a search has to go, by the exact neighbours of a few of the sample inside the sample
        asked = np.arange(min(len(x), 256))
        true = np.argsort(-(x[asked] @ x.T), axis=1, kind="stable")[:, :k]
        order = nearest(x[asked], c, len(c))
        place = np.argmax(order[:, None, :] == at[true][:, :, None], axis=2)  # which probe finds each neighbour
        probes = 1 + int(np.quantile(place, recall, method="higher"))
        guess = np.concatenate([model.decoded(model.codes(x[at == j], at[at == j]), j) for j in range(len(c)) if (at == j).any()])
        back = np.argsort(np.concatenate([np.flatnonzero(at == j) for j in range(len(c))]))
        ranks = np.argsort(np.argsort(-(x[asked] @ guess[back].T), axis=1, kind="stable"), axis=1)
        depth = 1 + int(np.quantile(np.take_along_axis(ranks, true, 1), recall, method="higher"))
        return Model(c, books, min(probes, len(c)), max(depth, k))


def _indexed(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("vector"), m.dim))
                at = np.concatenate([nearest(part, m.lists, 1)[:, 0] for part in np.array_split(x, len(x) // 2048 + 1)])
                codes = [c.tobytes() for c in m.codes(x, at)]
                columns = [batch.column("key"), pa.array(at, pa.int32()), pa.array(codes, pa.binary()), batch.column("vector")]
                yield pa.RecordBatch.from_arrays(columns, ["key", "list", "code", "vector"])

    return run


def _routed(model, probes: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("vector"), m.dim))
                lists = np.concatenate([nearest(part, m.lists, probes) for part in np.array_split(x, len(x) // 2048 + 1)])
                at = pa.array(np.repeat(np.arange(len(x)), lists.shape[1]))
                columns = [batch.column("key").take(at), pa.array(lists.ravel(), pa.int32()), batch.column("vector").take(at)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "list", "vector"])

    return run


def _ranked(model, k: int, depth: int | None) -> object:
    """Segments (their rows come first) with the queries that visit them, a few hundred queries at a time."""

    def best(q: np.ndarray, x: np.ndarray, keys: np.ndarray, guess: np.ndarray | None):
        """(row of q, key, similarity) of the k best, ties by key."""
        if guess is None or depth >= len(x):
            same, keys = rounded(q @ x.T), np.broadcast_to(keys, (len(q), len(keys)))
        else:
            first = np.argpartition(-(q.astype(np.float32) @ guess.T), depth - 1, axis=1)[:, :depth]
            same, keys = rounded(np.einsum("qd,qcd->qc", q, x[first])), keys[first]
        if same.shape[1] > k:
            row, column = np.nonzero(same >= np.partition(same, -k, axis=1)[:, -k, None])
        else:
            row, column = (a.ravel() for a in np.indices(same.shape))
        order = np.lexsort((keys[row, column], -same[row, column], row))
        row, column = row[order], column[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return row[keep], keys[row[keep], column[keep]], same[row[keep], column[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, held, place = model.value, None, None
        for rows in batches:
            spots = list(zip(rows.column("list").to_pylist(), rows.column("segment").to_pylist(), rows.column("asks").to_pylist(), strict=True))
            lo = 0
            while lo < len(spots):
                hi = lo + 1
                while hi < len(spots) and spots[hi] == spots[lo]:
                    hi += 1
                part, (at, segment, asks) = rows.slice(lo, hi - lo), spots[lo]
                lo = hi
                keys, x = part.column("key").to_numpy(), unit(matrix(part.column("vector"), m.dim))
                if not asks:
                    codes = np.frombuffer(b"".join(part.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
                    new = (keys, x, None if depth is None else m.decoded(codes, at).astype(np.float32))
                    if held is not None and place == (at, segment):  # the segment goes on in this batch
                        new = tuple(None if b is None else np.concatenate((a, b)) for a, b in zip(held, new, strict=True))
                    held, place = new, (at, segment)
                elif place == (at, segment):
                    step = max(8, min(256, 4_000_000 // ((depth or 1) * m.dim)))
                    for block in range(0, len(x), step):
                        query, item, same = best(x[block : block + step], held[1], held[0], held[2])
                        columns = [pa.array(keys[block : block + step][query]), pa.array(item), pa.array(same)]
                        yield pa.RecordBatch.from_arrays(columns, ["query", "item", "similarity"])

    return run


class VectorIndex:
    """Rows (key, list, segment, code, vector) under ``path`` and the model that placed them."""

    def __init__(self, spark: SparkSession, path: str, model: Model):
        self.spark, self.path, self.model = spark, path, model

    @staticmethod
    def build(
        items: DataFrame, key: str, vector: str, name: str = "index", dim: int | None = None, k: int = 20, recall: float = 0.97, sample: int = SAMPLE
    ) -> VectorIndex:
        """Fit on at most ``sample`` rows, index every row; ``dim`` defaults to the length that most rows have."""
        spark = items.sparkSession
        rows = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        if dim is None:
            sizes = rows.where("vector is not null").groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
            dim = sizes[0].n if sizes else 1
        whole = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x))
        rows = rows.where((F.size("vector") == dim) & F.col("key").isNotNull() & whole)
        few = rows.orderBy(F.xxhash64("key")).limit(sample).select("vector")
        x = matrix(pa.chunked_array(few.toArrow().column("vector").chunks, pa.list_(pa.float64())), dim)
        if not len(x):
            x = np.zeros((1, dim))
        model = Model.fit(x, max(1, min(1024, int(math.sqrt(rows.count())) // 2, len(x) // 16)), k, recall)
        index = VectorIndex(spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", model)
        index._append(rows, "overwrite")
        return index

    def _append(self, rows: DataFrame, mode: str) -> None:
        placed = rows.mapInArrow(_indexed(self.spark.sparkContext.broadcast(self.model)), "key long, list int, code binary, vector array<double>")
        sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / SEGMENT).cast("int").alias("segments"))
        cut = F.pmod(F.xxhash64("key"), F.coalesce("segments", F.lit(1))).cast("int")
        placed = placed.join(F.broadcast(sizes), "list").withColumn("segment", cut).select("key", "list", "segment", "code", "vector")
        placed.repartition("list", "segment").sortWithinPartitions("list", "segment").write.mode(mode).parquet(self.path)

    def add(self, items: DataFrame, key: str, vector: str) -> None:
        """More rows, placed by the fitted model; keys are expected to be new."""
        rows = items.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("vector"))
        self._append(rows.where((F.size("vector") == self.model.dim) & F.col("key").isNotNull()), "append")

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def search(self, queries: DataFrame, k: int, exact: bool = False, probes: int | None = None) -> DataFrame:
        """(query, item, similarity): the k best of each query (query, vector); exact ones if asked for."""
        model, rows = self.spark.sparkContext.broadcast(self.model), self.rows()
        asked = queries.select(F.col("query").cast("long").alias("key"), F.col("vector").cast("array<double>").alias("vector"))
        asked = asked.where((F.size("vector") == self.model.dim) & F.col("key").isNotNull())
        asked = asked.mapInArrow(_routed(model, len(self.model.lists) if exact else probes or self.model.probes), "key long, list int, vector array<double>")
        segments = rows.select("list", "segment").distinct()  # at most rows / SEGMENT + lists
        asked = asked.join(segments, "list").select("key", "list", "segment", F.lit(None).cast("binary").alias("code"), "vector", F.lit(1).alias("asks"))
        both = rows.select("key", "list", "segment", "code", "vector", F.lit(0).alias("asks")).unionByName(asked)
        both = both.repartition("list", "segment").sortWithinPartitions("list", "segment", "asks")
        found = both.mapInArrow(_ranked(model, k, None if exact else max(k, self.model.depth)), "query long, item long, similarity double")
        own = W.partitionBy("query").orderBy(F.desc("similarity"), "item")
        return found.withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r")


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """(query, wanted, hits): how many of each query's true neighbours were found; ties with the last one count as found."""
    last = true.groupBy("query").agg(F.count("*").alias("wanted"), F.min("similarity").alias("least"))
    hits = found.join(last, "query").where(F.col("similarity") >= F.col("least")).groupBy("query").agg(F.count("*").alias("hits"))
    return last.join(hits, "query", "left").select("query", "wanted", F.least("wanted", F.coalesce("hits", F.lit(0))).alias("hits"))
