"""Stored indexes against full scans: vectors and texts, with nulls, repeats, deltas, hot lists and empty tables."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F

from millrace.operators import postings, vector_index

RNG = np.random.default_rng(5)


@pytest.fixture(scope="module")
def vectors(spark):
    centres = RNG.standard_normal((12, 16))
    rows = [(i, (centres[i % 12] + 0.3 * RNG.standard_normal(16)).tolist()) for i in range(900)]
    rows += [(1000 + i, (centres[0] + 1e-3 * RNG.standard_normal(16)).tolist()) for i in range(450)]  # a hot list
    rows += [(2000, None), (2001, []), (2002, [1.0]), (2003, [0.0] * 16), (None, [1.0] * 16), (2004, rows[5][1]), (2005, rows[5][1])]
    return spark.createDataFrame([(*r, 1) for r in rows], "id long, v array<double>, list int")


def brute(rows, k):
    rows = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16]
    x = vector_index.unit(np.stack([v for _, v in rows]))
    out = {}
    for (i, _), s in zip(rows, vector_index.rounded(x @ x.T), strict=True):
        out[i] = sorted(((-v, j) for (j, _), v in zip(rows, s, strict=True)))[:k]
    return {i: [(j, -v) for v, j in best] for i, best in out.items()}


def test_vector_index(spark, vectors, monkeypatch):
    monkeypatch.setattr(vector_index, "SEGMENT", 100)
    index = vector_index.VectorIndex.build(vectors, "id", "v", k=10, recall=0.98)
    assert index.rows().count() == 900 + 450 + 3
    sizes = index.rows().groupBy("list", "segment").count().agg(F.max("count")).collect()[0][0]
    assert sizes < 250  # the hot list is many segments
    asked = vectors.select(F.col("id").alias("query"), F.col("v").alias("vector"))
    want = brute([(r.id, r.v) for r in vectors.collect()], 10)
    exact = index.search(asked, 10, exact=True)
    got = {}
    for r in exact.orderBy("query", F.desc("similarity"), "item").collect():
        got.setdefault(r.query, []).append((r.item, r.similarity))
    assert got == want
    part = vector_index.recall(index.search(asked, 10), exact).agg(F.sum("hits") / F.sum("wanted")).collect()[0][0]
    assert part >= 0.9
    index.add(spark.createDataFrame([(3000, want and [1.0] * 16)], "id long, v array<double>"), "id", "v")
    found = index.search(spark.createDataFrame([(1, [1.0] * 16)], "query long, vector array<double>"), 1, exact=True).collect()
    assert [(r.item, r.similarity) for r in found] == [(3000, 1.0)]


def test_vector_index_of_nothing(spark, vectors):
    index = vector_index.VectorIndex.build(vectors.where("id < 0"), "id", "v", dim=16)
    assert index.search(vectors.select(F.col("id").alias("query"), F.col("v").alias("vector")), 3).count() == 0


WORDS = "the of und de la der in for that wörk x_1".split()
TEXTS = [(i, " ".join(RNG.choice(WORDS, RNG.integers(1, 40))) + (" rare" if i % 50 == 0 else "")) for i in range(400)]
TEXTS += [(500, None), (501, ""), (502, "THE The the"), (None, "the of"), (7, "the the of again"), (503, "the of " * 60_000)]
QUERIES = [(0, "the"), (1, "the of"), (2, "rare THE"), (3, "nowhere the"), (4, "wörk x_1 de"), (5, "the the")]


def ranks(texts):
    index = {}
    for key, body in texts:
        if key is not None:
            index.setdefault(key, Counter()).update(regex.findall(r"[\p{L}\p{N}_]+", (body or "").lower()))
    out = {}
    for q, t in QUERIES:
        terms = set(t.lower().split())
        hits = [(key, round(sum(1 + math.log(c[w]) for w in terms), 6)) for key, c in index.items() if all(w in c for w in terms)]
        out[q] = sorted(hits, key=lambda h: (-h[1], h[0]))
    return out


def by_query(df):
    out = {q: [] for q, _ in QUERIES}
    for r in df.collect():
        out[r.query].append((r.key, r.rank))
    return {q: sorted(v, key=lambda h: (-h[1], h[0])) for q, v in out.items()}


def test_postings_and_deltas(spark):
    docs = spark.createDataFrame([(*t, 1, 2) for t in TEXTS], "id long, body string, term int, tf int")
    asked = spark.createDataFrame(QUERIES, "query long, text string")
    index = postings.Postings.build(docs, "id", "body", block=25)
    assert index.blocks == 17
    want = ranks(TEXTS)
    assert by_query(index.matches(asked)) == want
    for k in (1, 5, 1000):
        assert by_query(index.top(asked, k)) == {q: v[:k] for q, v in want.items()}
    change = [(3, "rare the"), (4, None), (600, "the of de wörk x_1"), (503, "of")]
    again = [(3, "of of of"), (601, "rare the the")]
    for rows in (change, again):
        index.upsert(spark.createDataFrame(rows, "id long, body string"), "id", "body")
    changed = dict(change) | dict(again)
    want = ranks([t for t in TEXTS if t[0] not in changed] + list(changed.items()))
    for form in (index, index.merge()):
        assert by_query(form.matches(asked)) == want
        assert by_query(form.top(asked, 4)) == {q: v[:4] for q, v in want.items()}
    empty = postings.Postings.build(docs.limit(0), "id", "body")
    assert empty.top(asked, 3).count() == empty.matches(asked).count() == 0


def test_top_reads_fewer_blocks_than_there_are(spark):
    """Blocks whose maxima cannot reach the k-th best rank are not ranked."""
    rows = [(i, "the " * (400 if i < 3 else 1 + i % 3)) for i in range(600)]
    index = postings.Postings.build(spark.createDataFrame(rows, "id long, body string"), "id", "body", block=10)
    read = []
    exact = index._exact
    index._exact = lambda lists: read.append(lists.select("block").distinct().count()) or exact(lists)
    best = index.top(spark.createDataFrame([(0, "the")], "query long, text string"), 3).collect()
    assert sorted(r.key for r in best) == [0, 1, 2] and max(read) <= 8 < index.blocks


def test_lists_leave_a_task_whole_and_scans_name_their_terms(spark):
    rows = [(b, k, t) for b, k, t in ((0, 1, "the of"), (0, 1, "the"), (0, 4, None), (0, 7, "of of"), (2, 1, "the"), (2, 2, ""))]
    batches = [pa.RecordBatch.from_pylist([dict(zip("bkt", r, strict=True)) for r in part], pa.schema([("b", pa.int32()), ("k", pa.int64()), ("t", pa.string())])) for part in (rows[:1], rows[1:4], rows[4:])]
    got = {(r["term"], r["block"]): (r["keys"], r["tfs"], r["most"]) for b in postings._indexed(iter(batches)) for r in b.to_pylist()}
    assert got == {("the", 0): ([1], [2], 2), ("of", 0): ([1, 7], [1, 2], 2), ("the", 2): ([1], [1], 1)}
    docs = spark.createDataFrame(TEXTS, "id long, body string")
    index = postings.Postings.build(docs, "id", "body", block=25)
    found = index.matches(spark.createDataFrame([(0, "rare"), (1, "wörk")], "query long, text string"))
    assert "EqualTo(term,rare)" in found._jdf.queryExecution().toString()
    many = spark.createDataFrame([(0, " ".join(f"w{i}" for i in range(postings.NAMED + 1))), (1, "rare")], "query long, text string")
    assert sorted(r.key for r in index.matches(many).collect()) == sorted(i for i, t in TEXTS if i is not None and t and "rare" in t)
