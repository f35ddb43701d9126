"""Operators that must do the whole job of the reference, on small hand-written inputs."""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.operators import chunker, dataset, dedup, firewall, retrieval
from millrace.plans.registry import QUERIES


def test_firewall_makes_all_checks_by_tier(spark):
    good, s, a, b, c = "<p>" + "word " * 60 + "</p>", "https://arxiv.org/x", "https://oecd.org/x", "https://ft.com/x", "https://blog.example.com/x"
    cut = "é" * 4095 + "x" + "é" + "captcha"  # the pattern lies after the first 8 KB, which end inside a letter
    rows = [
        (s, None, "http_500", False, 0, ""), (s, good, None, False, 8, "future_date:2024-02-09"), (c, "", "http_500", False, 8, "future_date:2024-02-09"), (s, good, None, False, 7, ""),
        (a, "", None, False, 0, ""), (a, good, "http_404", True, 0, "http_404"), (b, good, None, False, 0, ""), (b, "short", "http_timeout", False, 0, "http_timeout"), (b, "short", None, False, 0, "too_short"),
        (b, good + "Access  Denied", None, False, 0, "error_pattern:Access  Denied"), (b, "<i " + "x" * 2000 + ">" + "y" * 90, None, True, 0, "low_density:0.04"), (b, cut, None, True, 0, ""), (b, None, None, True, 0, ""),
        (b.replace("/x", "/f.PDF?a=1"), "short", None, True, 0, ""), (c, good, None, True, 0, ""), (c, "short", None, False, 0, "cross_verification_failed,too_short"), (c, "short", "http_410", False, 0, "http_410,cross_verification_failed"), (c, good, "", None, 0, "cross_verification_failed"),
    ]
    now = F.lit("2024-02-01").cast("timestamp")
    table = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, url string, html string, http string, cross_source boolean, days int, want string")
    for r in firewall.verify(table.withColumn("published", now + F.make_dt_interval("days")), now).collect():
        assert (",".join(r.reasons), r.passed) == (r.want, not r.want), r


def test_gate_fails_without_pairs_or_multi_turn_talks(spark):
    rows = spark.range(1200).select((F.col("id") % 3).alias("perspective"), F.lit(0.9).alias("score"))
    talks = lambda multi, refused: spark.range(100).select((F.col("id") < multi).alias("multi_turn"), (F.col("id") < refused).alias("refusal"))
    failed = lambda *a: {(r.name, r.blocking) for r in dataset.full_gate(a[0], "score", "perspective", spark.range(a[1]), talks(*a[2:])).collect() if not r.passed}
    assert failed(rows, 50, 15, 20) == set()
    assert failed(rows, 49, 14, 21) == {("min_dpo_pairs", True), ("multi_turn_pct", True), ("refusal_pct", False)}
    assert failed(rows.limit(999), 0, 100, 0) == {("min_dpo_pairs", True), ("advised_samples", False)}
    assert failed(rows.withColumn("score", F.lit(None).cast("double")), 50, 15, 0) == {("has_scores", False)}
    assert failed(rows.limit(0), 50, 15, 0) == {("min_samples", True)}


def test_every_query_has_its_neighbours_over_several_blocks(spark):
    vectors = np.random.default_rng(3).normal(size=(700, 8))
    vectors[5:40], vectors[60] = vectors[5], 0.0  # ties and a zero norm
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(700, [1.0]), (701, None)]
    items = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = retrieval.vector_neighbours(items, "vec_id", "embedding", items.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("vector")), 20, block=8).collect()
    v = np.array([r[1] for r in rows[:700]], np.float32).astype(float)
    norm = np.sqrt((v * v).sum(axis=1))
    want = set()
    for q in range(0, 720, 20):
        same = [round(float(v[q] @ v[i] / (norm[q] * norm[i])), 6) if q < 700 and norm[q] * norm[i] else 0.0 for i in range(700)] + [1.0 if q == 700 else 0.0]
        want |= {(q, i, same[i]) for i in sorted(range(701), key=lambda i: (-same[i], i))[:20]} if q <= 700 else set()
    assert {(r.query, r.vec_id, round(r.similarity, 6)) for r in got} == want and len(got) == len(want) == 36 * 20


def greedy(texts):
    """The filter one text at a time, as the reference states it."""
    kept, out = [], []
    for text in texts:
        w = text.lower().split()
        n = 3 if len(w) >= 3 else 2
        cut = {"_".join(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) > 1 else {text.lower()} if text.strip() else {"_empty_"}
        sig = [min(int(hashlib.md5(f"{p}|{s}".encode()).hexdigest(), 16) for s in cut) for p in range(128)]
        near = any(any(sig[b : b + 8] == k[b : b + 8] for b in range(0, 128, 8)) and sum(x == y for x, y in zip(sig, k, strict=True)) / 128 >= 0.85 for k in kept)
        if not near:
            kept.append(sig)
        out.append(not near)
    return out


def test_near_duplicates_equal_the_greedy_filter(spark):
    rng, words = np.random.default_rng(5), [f"w{i}" for i in range(60)]
    texts, base = ["", "  ", "one", "One", " one", "one two", "one  two"], list(rng.choice(words, 60))
    for i in range(24):  # a chain: each differs a little more from the first one
        base = [*base]
        base[-1 - 2 * i], texts = f"new{i}", [*texts, " ".join(base)]
    texts += texts[8:14] + [" ".join(rng.choice(words, 30))]
    want = greedy(texts)
    items = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(3)
    got = dict(dedup.near_duplicates(items, "id", "text", lambda d: d.localCheckpoint()).collect())
    assert [got[i] for i in range(len(texts))] == want and len(set(want[7:31])) == 2


def filled(words, most):
    """Chunks of a text without sentences: as many words as fit."""
    out = []
    for w in words:
        if out and len(out[-1]) + 1 + len(w) <= most:
            out[-1] += " " + w
        else:
            out.append(w)
    return out


def test_long_texts_are_cut_as_by_brute_force(spark):
    rng = np.random.default_rng(9)
    texts = [["".join(rng.choice(list("abcdeł"), rng.integers(1, 12))) for _ in range(n)] for n in (500, 900, 1500, 2400)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert docs.where("length(text) > 2200").count() == 4
    got = {}
    for r in chunker.chunk_documents(docs, "doc_id", "text", overlap=0).orderBy("doc_id", "chunk_index").collect():
        got.setdefault(r.doc_id, []).append(r.body)
    for i, t in enumerate(texts):
        want = filled(t, 2200)
        if len(want[-1]) < 250:  # a rest under the least size is no chunk
            want.pop()
        assert got[i] == want and len(want) > 1


def test_whole_tables_are_taken(spark, tmp_path):
    spark.createDataFrame([("a", 39), ("a", 40), ("a", 40), ("b", 500)], "event_type string, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(3, "c3"), (1002, "c1002")], "c_custkey long, c_name string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(1, "s3"), (2, "s6"), (334, "s1002")], "s_suppkey long, s_name string").write.parquet(f"{tmp_path}/supplier.parquet")
    assert {(r.event_type, r.users) for r in QUERIES["union_of_all_arrays"](spark, str(tmp_path)).collect()} == {("a", "39,40"), ("b", "500")}
    assert {(r.id, r.name) for r in QUERIES["insert_ignore_all"](spark, str(tmp_path)).collect()} == {(3, "c3"), (1002, "c1002"), (6, "s6")}


class _Held:
    def __init__(self, value):
        self.value = value


def test_few_items_are_ranked_and_none_is_lost(monkeypatch):
    """Past the first items only those that can still be among a query's best are ranked; ties, zero norms and other lengths count."""
    rng, ranked, leading = np.random.default_rng(11), [], retrieval._leading
    monkeypatch.setattr(retrieval, "_leading", lambda query, *a: ranked.append(len(query)) or leading(query, *a))
    v = np.round(rng.normal(size=(12_000, 8)), 1)
    v[100:160], v[9000:9100], v[7] = v[3], 2 * v[3], 0.0
    rows = [x.tolist() for x in v] + [[1.0, 2.0]] * 30
    ids, asked = np.arange(40), [rows[i] for i in range(38)] + [[2.0, 4.0], [0.5]]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(at, min(at + 5000, len(rows)))), pa.array(rows[at : at + 5000], pa.list_(pa.float64()))], ["k", "v"]) for at in range(0, len(rows), 5000)]
    got = [tuple(r.values()) for b in retrieval._best(_Held((ids, retrieval._by_length(asked))), 20)(iter(batches)) for r in b.to_pylist()]
    want = []
    for q, a in enumerate(asked):
        a = np.array(a)
        norm = lambda x: np.sqrt((x * x).sum(axis=-1))
        same = np.zeros(len(rows))
        if len(a) == 8:
            both = norm(v) * norm(a)
            same[: len(v)] = np.divide((v * a).sum(axis=1), both, out=np.zeros(len(v)), where=both != 0)
        elif len(a) == 2:
            same[len(v) :] = 1.0
        same = np.copysign(np.floor(np.abs(same) * 1e6 + 0.5) / 1e6, same) + 0.0
        want += [(q, i, same[i]) for i in np.lexsort((np.arange(len(rows)), -same))[:20].tolist()]
    got, want = sorted(got), sorted(want)
    assert [g[:2] for g in got] == [w[:2] for w in want] and max(abs(g[2] - w[2]) for g, w in zip(got, want, strict=True)) < 1.5e-6
    assert sum(ranked) < 0.4 * len(rows) * len(ids)
