"""A stored inverted index: postings in blocks of documents with block maxima, top-k that skips blocks, upserts as deltas.

``postings`` has one row for each term and block, in files ordered by term: the keys and counts of the term's documents there, and the greatest count.  A
block is a set of documents (by the hash of their key), the same for all terms, so all terms of a query meet inside a block.
A query holds terms that must all occur; a document's rank is the sum of 1 + ln(count) over them.

``top`` reads block maxima first: a block's bound is the sum of 1 + ln(maximum).  The blocks with the best bounds are ranked exactly;
their k-th best rank is what other blocks must reach, and only those that can are read.  No block is left out for any other reason,
so the result is that of a full scan.

``upsert`` writes the postings of changed documents as a delta and the keys that it replaces; a document counts in its latest delta
alone.  ``merge`` rewrites all into one generation.  Documents with a null key are not indexed; null texts hold no terms (an upsert of
one empties the document); where one batch repeats a key, its texts count together.
"""

from __future__ import annotations

import functools
import itertools
import operator
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.session import shared_dir

#: Documents of a block, about; bytes of a row group; terms that a scan names.
BLOCK, GROUP, NAMED = 2048, 8 << 20, 64
_TOKEN = regex.compile(r"[\p{L}\p{N}_]+")


_LISTS = "term string, block int, keys array<long>, tfs array<int>, most int"


def _lists(found: dict[str, tuple[list[int], list[int]]], block: int) -> pa.RecordBatch:
    ends = np.cumsum([0, *(len(keys) for keys, _ in found.values())], dtype=np.int32)
    keys, tfs = (pa.array(list(itertools.chain.from_iterable(v[i] for v in found.values())), t) for i, t in ((0, pa.int64()), (1, pa.int32())))
    lists = [pa.ListArray.from_arrays(ends, v) for v in (keys, tfs)]
    most = pa.array([max(t) for _, t in found.values()], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array([block] * len(found), pa.int32()), *lists, most], ["term", "block", "keys", "tfs", "most"])


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of one block after the other from rows (block, key, body) in order of block and key: each text is read once, and no entry
    leaves the task before its list is whole."""
    now, last, counts, found = None, None, Counter(), {}

    def close() -> None:
        for term, tf in counts.items():
            keys, tfs = found.setdefault(term, ([], []))
            keys.append(last)
            tfs.append(tf)

    for batch in batches:
        for block, key, body in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            if key != last or block != now:
                close()
                counts = Counter()
                if block != now and found:
                    yield _lists(found, now)
                    found = {}
                now, last = block, key
            counts.update(_TOKEN.findall(body) if body else ())
    close()
    if found:
        yield _lists(found, now)


def _merged(lists: pa.Table, changed: pa.Table) -> pa.Table:
    """One block's lists of all generations as one, without the entries of documents that a later delta replaces."""
    sizes = np.diff(lists.column("keys").combine_chunks().offsets.to_numpy()) if lists.num_rows else np.empty(0, np.int64)
    key, tf = (lists.column(c).combine_chunks().flatten().to_numpy() for c in ("keys", "tfs"))
    term = lists.column("term").combine_chunks().dictionary_encode()
    code, generation = (np.repeat(v, sizes) for v in (term.indices.to_numpy(), lists.column("generation").to_numpy()))
    order = np.lexsort((changed.column("generation").to_numpy(), changed.column("key").to_numpy()))
    name, latest = changed.column("key").to_numpy()[order], changed.column("generation").to_numpy()[order]
    if len(name):
        at = np.searchsorted(name, key, "right") - 1  # a key's last change
        current = (at < 0) | (name[at] != key) | (latest[at] <= generation)
        key, tf, code = key[current], tf[current], code[current]
    order = np.lexsort((key, code))
    key, tf, code = key[order], tf[order], code[order]
    starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1]))) if len(code) else np.empty(0, np.int64)
    ends = pa.array(np.concatenate((starts, [len(code)])), pa.int32())
    most = np.maximum.reduceat(tf, starts) if len(starts) else tf
    block = np.full(len(starts), lists.column("block")[0].as_py() if lists.num_rows else 0)
    columns = [term.dictionary.take(pa.array(code[starts])), pa.array(block, pa.int32()), pa.ListArray.from_arrays(ends, pa.array(key, pa.int64())), pa.ListArray.from_arrays(ends, pa.array(tf, pa.int32())), pa.array(most, pa.int32())]
    return pa.table(columns, names=["term", "block", "keys", "tfs", "most"])


class Postings:
    """Index folders of one collection: ``postings`` by generation, and ``changed``, the keys that each delta replaces."""

    def __init__(self, spark: SparkSession, path: str, blocks: int, generation: int = 0):
        self.spark, self.path, self.blocks, self.generation = spark, path, blocks, generation

    @staticmethod
    def build(docs: DataFrame, key: str, body: str, block: int = BLOCK) -> Postings:
        spark = docs.sparkSession
        index = Postings(spark, f"{shared_dir(spark)}/postings-{uuid.uuid4().hex}", max(1, -(-docs.count() // block)))
        index._write(docs, key, body)
        return index

    def _write(self, docs: DataFrame, key: str, body: str) -> None:
        rows = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key"), F.lower(body).alias("body"))
        block = F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int").alias("block")
        laid = rows.select(block, "key", "body").repartition("block").sortWithinPartitions("block", "key")
        self._store(laid.mapInArrow(_indexed, _LISTS))

    def _store(self, lists: DataFrame) -> None:
        """Files in order of term: what a search does not ask for is skipped by their statistics."""
        lists.sortWithinPartitions("term", "block").write.option("parquet.block.size", GROUP).parquet(f"{self.path}/postings/generation={self.generation}")

    def upsert(self, docs: DataFrame, key: str, body: str) -> None:
        """Texts of ``docs`` replace what the index holds of their keys."""
        self.generation += 1
        self._write(docs, key, body)
        changed = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("key")).distinct()
        changed.write.parquet(f"{self.path}/changed/generation={self.generation}")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    def _current(self, entries: DataFrame) -> DataFrame:
        """Without the entries (key, generation) of documents that a later delta replaces."""
        if not self.generation:
            return entries
        last = self.spark.read.parquet(f"{self.path}/changed").groupBy("key").agg(F.max("generation").alias("latest"))
        return entries.join(last, "key", "left").where("latest IS NULL OR latest <= generation").drop("latest")

    def merge(self) -> Postings:
        """One generation with what is current."""
        lists, merged = self.postings(), Postings(self.spark, f"{shared_dir(self.spark)}/postings-{uuid.uuid4().hex}", self.blocks)
        if self.generation:
            block = F.pmod(F.xxhash64("key"), F.lit(self.blocks)).cast("int").alias("block")
            changed = self.spark.read.parquet(f"{self.path}/changed").select(block, "key", "generation")
            lists = lists.select("term", "block", "generation", "keys", "tfs").groupBy("block").cogroup(changed.groupBy("block")).applyInArrow(_merged, _LISTS)
        merged._store(lists.drop("generation"))
        return merged

    def _terms(self, queries: DataFrame) -> DataFrame:
        """(query, term, need) with the distinct terms of each query."""
        terms = F.array_distinct(text.tokens(F.lower("text")))
        return queries.select("query", F.explode(terms).alias("term"), F.size(terms).alias("need"))

    def _asked(self, terms: DataFrame) -> DataFrame:
        """Postings of the queries' terms; few terms are named in the scan, which then skips the others' row groups."""
        few = [r.term for r in terms.select("term").distinct().limit(NAMED + 1).collect()]
        lists = self.postings()
        if 0 < len(few) <= NAMED:
            lists = lists.where(functools.reduce(operator.or_, [F.col("term") == t for t in few]))
        return lists.join(terms, "term")

    def _exact(self, lists: DataFrame) -> DataFrame:
        """(query, key, rank) from rows (query, need, term, generation, block, keys, tfs)."""
        flat = lists.select("query", "need", "generation", "block", F.explode(F.arrays_zip("keys", "tfs")).alias("e"))
        flat = self._current(flat.select("query", "need", "generation", "block", F.col("e.keys").alias("key"), F.col("e.tfs").alias("tf")))
        found = flat.groupBy("query", "block", "key").agg(F.count("*").alias("found"), F.first("need").alias("need"), F.sum(1 + F.log("tf")).alias("rank"))
        return found.where("found = need").select("query", "key", F.round("rank", 6).alias("rank"))

    def matches(self, queries: DataFrame) -> DataFrame:
        """(query, key, rank) of every document that holds all terms of a query (query, text)."""
        return self._exact(self._asked(self._terms(queries)))

    def top(self, queries: DataFrame, k: int, first: int = 4) -> DataFrame:
        """(query, key, rank): the k best, ties by key; blocks that cannot reach them are not read."""
        terms = self._terms(queries)
        asked = self._asked(terms)
        heads = asked.select("query", "need", "term", "block", "generation", "most")
        # over several generations a document's terms stand in one of them, so bounds are of a block's generation
        bounds = heads.groupBy("query", "block", "generation").agg(F.sum(1 + F.log("most")).alias("bound"), F.count("*").alias("found"), F.first("need").alias("need"))
        bounds = bounds.where("found = need").select("query", "block", "generation", "bound")
        order = W.partitionBy("query").orderBy(F.desc("bound"), "block", "generation")
        tried = bounds.withColumn("r", F.row_number().over(order)).where(F.col("r") <= first)
        spots, own = ["query", "block", "generation"], W.partitionBy("query").orderBy(F.desc("rank"), "key")

        def ranked(chosen: DataFrame) -> DataFrame:
            lists = asked.join(chosen.select(*spots), spots, "left_semi")
            return self._exact(lists)

        least = ranked(tried).withColumn("r", F.row_number().over(own)).where(F.col("r") == k).select("query", F.col("rank").alias("least"))
        # rank and bound are rounded: a bound a digit below may still tie
        able = bounds.join(least, "query", "left").where("least IS NULL OR bound >= least - 1e-5")
        return ranked(able).withColumn("r", F.row_number().over(own)).where(F.col("r") <= k).drop("r")
