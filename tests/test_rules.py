"""Rules, watermarks, the writer's refusal cap, near-duplicates and graphs against brute force or hand-written cases."""

import hmac
import hashlib
import json
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.functions import rules, text, urls, watermarks
from millrace.operators import dataset, dedup, evaluation, graph, pairing, retrieval, semantic, state, writer
from millrace.session import written


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_urls_lose_leading_ws_and_path_parameters(spark):
    cases = {
        "HTTPS://www.Example.org/a/b/?b=2&utm_source=x&a=1#top": "https://example.org/a/b?a=1&b=2", "http://wwf.org": "http://f.org/", "http://w.w.example.org/x;v=1": "http://example.org/x",
        "http://a.org/?ref=1": "http://a.org/", "http://a.org/x?a=1&": "http://a.org/x?&a=1", " Not A Url ": "not a url", "http://a.org/p?q=a?b": "http://a.org/p?q=a?b",
    }
    rows = spark.createDataFrame(list(cases.items()), "url string, want string")
    assert all(r.got == r.want for r in rows.select("want", urls.normalise(F.col("url")).alias("got")).collect())


def test_dates_and_years(spark):
    cases = [("Applicable from: 1.3.2024 on", "2024-03-01"), ("od dnia 31/12/2023", "2023-12-31"), ("valid from 30/02/2024", None), ("effective 2024-05-06", "2024-05-06"), ("dated 1.1.2020", None), (None, None)]
    rows = spark.createDataFrame(cases, "t string, want string")
    assert all((str(r.d) if r.d else None) == r.want for r in rows.select("want", rules.valid_from(F.col("t")).alias("d")).collect())
    year = lambda n, t: one(spark, rules.directive_year(F.lit(n), F.lit(t)).alias("y")).y
    assert (year("act-2019.pdf", "2021"), year("act_2019.pdf", "of 2021."), year("x", "y" * 600 + " 2021"), year("x1999", "12021")) == (2019, 2021, None, None)


def test_density_and_richness_follow_python(spark):
    import re

    cases = ["Article 5 and § 7 of ust. 3, 12.5 % on 1.2.2024 or 2024-01-02, CSRD ÉTAT", "artykuł 12 ustęp paragraph sectional section", "", "aż żółw żółw ABC", "1,000.50 EUR x99 99x 99"]
    hits = lambda t: sum(w * len(re.findall(p.removeprefix("(?i)"), t, re.I if p.startswith("(?i)") else 0)) for w, p in text.DENSE)
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.density(F.col("t")).alias("d"), text.richness(F.col("t")).alias("r"))
    for r in rows.collect():
        words = re.findall(rf"\b[{text.RICH_LETTERS}]{{3,}}\b", r.t.lower())
        assert math.isclose(r.d, min(hits(r.t) / (max(len(r.t), 1) / 100) / 10, 1.0)), r.t
        assert math.isclose(r.r, len(set(words)) / len(words) if words else 0.0), r.t


def test_adjustments_by_hand(spark):
    got = lambda h, q, n, weak, t=0.82, a=0.10, m=3: tuple(one(spark, rules.adjusted(*map(F.lit, (h, q, n)), F.array(*map(F.lit, weak)).cast("array<string>"), *map(F.lit, (t, a, m))).alias("x")).x)
    assert got(0.2, 0.9, 0, []) == (0.832, 0.1, 3)
    assert got(0.06, 0.6, 5, ["Depth"]) == (0.826, 0.115, 4)
    assert got(0.0, 0.95, 5, ["conciseness", "depth"], a=0.2) == (0.817, 0.194, 2)
    assert got(0.2, 0.5, 1, ["citations"], t=0.95, a=0.35, m=8) == (0.95, 0.35, 8)


def test_keyed_watermark_follows_the_rule(spark):
    marks = watermarks.Keyed("acme", "b1", "key")
    key = hmac.new(b"key", b"acme|b1", hashlib.sha256).digest()
    number = lambda m, n: int.from_bytes(hmac.new(key, m.encode(), hashlib.sha256).digest()[:n], "big")
    for index, said in enumerate(("these requirements, and more. " * 9, "no such word here at all", "reporting; a, b. c: d! e? f, g. h, i", "", "one")):
        want, word = said, next((w for w in watermarks.KEYED if w in said), None)
        if word:
            want = want.replace(word, watermarks.KEYED[word][number(f"{word}|{index}", 2) % 3], 1)
        places = [k + 1 for k in range(len(want) - 1) if want[k] in ".,:;!?" and want[k + 1].isspace()]
        if len(places) < 8:
            places = [k for k in range(len(want)) if want[k].isspace() and (k == 0 or not want[k - 1].isspace())]
        bits, chars = f"{number(f'zwc|{index}', 4):032b}", list(want)
        for k, bit in enumerate(bits[: len(places)]):
            chars.insert(places[k] + k, watermarks.INVISIBLE[int(bit) * 2 + k % 2])
        assert marks.embed(said, index) == "".join(chars)
        assert marks.verify(marks.embed(said, index), index) == any(w in want and marks.synonym(w, index) in want for w in watermarks.KEYED)
    rows = watermarks.embed(spark.createDataFrame([(0, None), (1, "compliance matters")], "i long, t string"), "i", "t", "acme", "b1", "key").collect()
    assert rows[0].marked is None and any(c in watermarks.INVISIBLE for c in rows[1].marked)


def test_refusal_cap_equals_the_fold(spark):
    rng = np.random.default_rng(3)
    for cap, first in ((0.5, True), (0.25, False), (0.3, True), (0.1, False)):
        flags = [first, *(rng.random(150) < 0.4).tolist()]
        rows = spark.createDataFrame([(k * 3, bool(f)) for k, f in enumerate(flags)], "id long, refusal boolean").repartition(3)
        got = [r.written for r in sorted(writer.accepted(rows, "id", "refusal", cap, size=17).collect())]
        want, n, bad = [], 0, 0
        for f in flags:
            ok = not f or n == 0 or bad / n < cap
            want.append(ok)
            n, bad = n + ok, bad + (ok and f)
        assert got == want
        fold = spark.createDataFrame([(flags,)], "f array<boolean>").select(dataset.accept_with_refusal_cap(F.col("f"), cap).alias("x")).first().x
        assert fold == want


def test_writer_files_and_states(spark, tmp_path):
    say = lambda *turns: [{"role": r, "content": c} for r, c in turns]
    rows = [
        (1, say(("system", "s"), ("user", "what is the scope of this act here"), ("assistant", "the directive says so")), "other words"), (2, say(("user", "what is the scope of this act here"), ("assistant", "again")), None),
        (3, say(("user", " "), ("assistant", "x")), None), (4, say(("user", "and who pays the costs of it all"), ("assistant", "the directive again")), "the directive again"), (5, [], None),
    ]
    table = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>, rejected string")
    near = lambda asked: dedup.near_duplicates(asked, "id", "question", lambda d: written(d, "test"))
    samples, pairs, states = writer.write_output(table, "id", near, "refused", 0.3, 1, "acme", "b1", "key")
    assert [(r.id, r.idx, r.hash is not None) for r in samples.orderBy("id").collect()] == [(1, 0, False), (4, 1, True)]
    assert samples.where("id = 4").first().messages[-1].content == "the directive   again"  # odd index without a synonym: spaced
    assert [r.id for r in pairs.collect()] == [1]
    assert {r.id: r.record_index for r in states.collect()} == {1: 0, 2: -1, 3: -1, 4: 1, 5: -1}
    writer.write_dataset(samples, str(tmp_path / "out"), spark.createDataFrame([("v", 2)], "version string, n int"), ["question_type"])
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/jsonl")).collect()]
    assert len(lines) == 2 and all(set(x) == {"messages", "metadata"} for x in lines)
    assert writer.resume_counts(spark.read.text(str(tmp_path / "out/jsonl")), "again").first() == (2, 1)
    assert spark.read.text(str(tmp_path / "out/card")).first().value == '{"version":"v","n":2}'


def test_staged_and_preloaded_filters(spark):
    rows = [(1, "http://www.a.org/x", "the long title of a page about birds and trees in the north"), (2, "http://a.org/x?ref=1", "other"), (3, "http://a.org/y", "the long title of a page about birds and trees in the north"), (4, "http://a.org/z", ""), (5, "http://a.org/q", None), (6, "http://a.org/r", "entirely different words stand here")]
    d = spark.createDataFrame(rows, "id long, url string, title string")
    got = {r.id: r.stage for r in dedup.staged(d, "id", urls.fingerprint(F.col("url")), "title", lambda x: written(x, "test")).collect()}
    assert got == {1: None, 2: "url", 3: "title", 4: None, 5: None, 6: None}
    known = spark.createDataFrame([(1, "what does the act ask of small firms in the union")], "id long, text string")
    asked = spark.createDataFrame([(1, "what does the act ask of small firms in the union"), (2, "who has to file a report by the end of may"), (3, "who has to file a report by the end of may"), (4, None)], "id long, text string")
    assert {r.id: r.kept for r in dedup.preloaded(asked, known, "id", "text", lambda x: written(x, "test")).collect()} == {1: False, 2: True, 3: False, 4: True}


def test_links_distances_and_centroids(spark):
    v = np.random.default_rng(5).normal(size=(90, 6))
    v[3], v[40] = v[7], 0.0
    d = spark.createDataFrame([(k, k % 3, x.tolist()) for k, x in enumerate(v)] + [(99, 0, None)], "id long, g int, v array<double>")
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    want = {(q, k) for q in range(0, 90, 20) for k in range(90) if k != q and round(float(unit[q] @ unit[k]), 6) >= 0.5}
    found = retrieval.cosine_links(d, "id", "v", d.where("id % 20 = 0").select(F.col("id").alias("query"), F.col("v").alias("vector")), 0.5, block=2)
    assert {(r.query, r.id) for r in found.collect()} == want
    for r in evaluation.mean_distance(d.where("v is not null"), "g", "v").collect():
        own = unit[r.g :: 3]
        n = len(own)
        assert math.isclose(r.distance, np.mean([1 - own[a] @ own[b] for a in range(n) for b in range(a + 1, n)]), abs_tol=1e-5)
    for r in evaluation.centroids(d.where("v is not null"), "g", "v").collect():
        mean = v[r.g :: 3].mean(axis=0)
        assert math.isclose(r.value, mean[r.pos] / np.linalg.norm(mean), abs_tol=1e-9)


def test_entities_and_relations_by_hand(spark):
    docs = spark.createDataFrame([(1, "The csrd amends Article 19.\nNothing. EU  Taxonomy and Scope 1 differ."), (2, None), (3, "")], "id long, t string")
    named = graph.mentions(docs, "id", "t")
    assert {(r.name, r.kind) for r in named.collect()} == {("CSRD", "LAW"), ("Article 19", "LAW"), ("EU  Taxonomy", "LAW"), ("Scope 1", "CONCEPT")}
    edges = {(r.source, r.target, r.relation) for r in graph.relations(docs, "id", "t", named).collect()}
    assert edges == {("Article 19", "CSRD", "CO_OCCURS"), ("EU  Taxonomy", "Scope 1", "CO_OCCURS")}
    windows = spark.createDataFrame([(1, "this amends CSRD and SFDR")], "id long, t string")
    assert ("CSRD", "SFDR", "AMENDS") in {(r.source, r.target, r.relation) for r in graph.relations(windows, "id", "t", graph.mentions(windows, "id", "t")).collect()}
    said = lambda n: one(spark, graph.canonical(F.lit(n), graph.ALIASES).alias("x")).x
    assert (said("mifid"), said("esg-x"), said("Solvency ii"), said("longer name")) == ("MiFID II", "ESG-X", "Solvency II", "longer name")


def test_run_state(spark):
    got = one(spark, state.decoded(F.lit('{"run_id": "a", "chunks_done": 4}'), 9.0).alias("r")).r
    assert (got.run_id, got.status, got.chunks_done, got.dpo_pairs, got.started_at, got.ended_at) == ("a", "starting", 4, 0, 9.0, None)
    assert one(spark, state.decoded(F.lit("{"), 9.0).alias("r")).r.status == "starting"
    line = lambda t: tuple(one(spark, rules.log_line(F.lit(t)).alias("r")).r)
    assert line("Progress: 5 chunks | 3 ready | 1 unresolvable | 8 records | 2 DPO") == (5, 8, 2, None, None)
    assert line("✓ Record 7 written")[1] == 8 and line("Found 3 pending chunks")[3:] == (3, "running") and line("nothing") == (None,) * 5


def test_partners_equal_brute_force(spark):
    names = ("CSRD report", "sfdr note", "Taxonomy act", "csddd", "others")
    v = np.random.default_rng(6).normal(size=(80, 5))
    rows = [(k, names[k % 5], None if k in (12, 40) else x.tolist()) for k, x in enumerate(v)]
    d = spark.createDataFrame([*rows, (99, None, None)], "id long, name string, vector array<double>").repartition(3)
    together = {("CSRD report", "sfdr note"), ("CSRD report", "Taxonomy act"), ("CSRD report", "csddd"), ("sfdr note", "Taxonomy act"), ("Taxonomy act", "csddd"), ("others", "others")}
    named = {k: name for k, name, _ in rows} | {99: "others"}
    unit = v / np.linalg.norm(v, axis=1)[:, None]

    def similarity(a, b):
        return 0.5 if {a, b} & {12, 40, 99} else unit[a] @ unit[b]

    got = {r.id: (r.partner, r.similarity) for r in pairing.partners(d, d.where("id % 4 = 0"), block=7).collect()}
    assert len(got) == 20
    for q in range(0, 80, 4):
        open_ = [k for k in named if k != q and {(named[q], named[k]), (named[k], named[q])} & together]
        best = max(open_, key=lambda k: similarity(q, k) / 0.4 + pairing.noise(q, k, 7)[0])
        assert got[q] == (best, round(float(similarity(q, best)), 6))
    drawn = pairing.noise(np.arange(100)[:, None], np.arange(100)[None, :], 3)
    assert abs(drawn.mean() - 0.5772) < 0.05 and abs(drawn.var() - np.pi**2 / 6) < 0.1  # a standard Gumbel variate
    none = pairing.partners(d.limit(0), d.limit(0))
    assert none.count() == 0


def test_names_that_go_together():
    table, bit = pairing.going_together(), {p: 1 << i for i, p in enumerate(pairing.COMPATIBLE)}
    assert table[0, 0] and not table[bit["csrd"], 0] and not table[0, bit["sfdr"]]
    assert table[bit["sfdr"], bit["csrd"]] and not table[bit["sfdr"], bit["csddd"]] and not table[bit["csrd"], bit["csrd"]]
    both = bit["csrd"] | bit["sfdr"]
    assert table[both, bit["sfdr"]] and table[bit["csddd"], both] and table[both, both] and not table[both, bit["csrd"]]


def test_semantic_filter_equals_the_rule(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(12, 8))
    v = np.concatenate([c + rng.normal(scale=0.35, size=(25, 8)) for c in centres])
    v[10], v[50], v[51] = v[3], 0.0, v[3] * 2
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(900, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>").repartition(3)
    unit = v / np.maximum(np.linalg.norm(v, axis=1), 1e-300)[:, None]
    near = {(a, b) for a in range(300) for b in range(a + 1, 300) if round(float(unit[a] @ unit[b]), 6) >= 0.88}
    found = {(r.a, r.b) for r in semantic.cosine_pairs(d, "id", "v", 0.88, lambda x: written(x, "test"), pivots=9, block=40).collect()}
    # equal vectors: the first stands for all
    assert {p for p in found if 10 not in p} == {p for p in near if 10 not in p} and (3, 10) in found and len(near) > 500
    kept = []
    for a in range(300):
        if not any((b, a) in near for b in kept):
            kept.append(a)
    got = {r.id for r in semantic.semantic_keep(d, "id", "v", lambda x: written(x, "test")).where("kept").collect()}
    assert got == {*kept, 900}


def test_unclustered_vectors_meet_once(spark):
    """Vectors without clusters visit half of the cells, travel as one row each until blocks are dealt, and give each pair once."""
    v = np.random.default_rng(4).normal(size=(600, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(range(600)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["key", "v"])
    placed = [r for b in semantic._cells(v[:9] / np.linalg.norm(v[:9], axis=1)[:, None], 1.0)(iter([batch])) for r in b.to_pylist()]
    assert len(placed) == 600 and sum(len(r["visits"]) for r in placed) <= 600 * 8 / 2 * 1.2 and all(c > r["cell"] for r in placed for c in r["visits"])
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    d = spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], "id long, v array<double>")
    for threshold, block in ((0.7, 30), (0.7, None), (-1.0, 50)):  # few pairs, and all
        want = {(a, b) for a, b in zip(*np.nonzero(np.triu(np.round(unit @ unit.T, 6) >= threshold, 1)), strict=True)}
        got = [(r.a, r.b) for r in semantic.cosine_pairs(d, "id", "v", threshold, lambda x: written(x, "test"), pivots=9, block=block).collect()]
        assert len(got) == len(set(got)) == len(want) > 1000 and set(got) == want


def test_dense_patterns_look_at_the_first_letter_and_count_the_same(spark):
    rows = ["Art. 5 art 7 ART.9 xart 5 artykuł 12 Article  3 §4 a§ 4 a§4 _§ 5 ust. 3 USTĘP 4 ustęp Paragraph sections section Section", "1,5 % 12.000 EUR 1234 3.4.2024 2024-01-02 é12 12é ³4 1 mln.", "EU CSRD ÉUR UEÉ A ABCDEFG AB_ AB1 łAB AB", "", None]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string")
    plain = [F.regexp_count("t", F.lit(text.bordered(p))).alias(f"a{i}") for i, (_, p) in enumerate(text.DENSE)]
    gated = [F.regexp_count("t", F.lit(p)).alias(f"b{i}") for i, (_, p) in enumerate(text.dense_patterns())]
    found = d.select(*plain, *gated).collect()
    assert all(tuple(r)[:4] == tuple(r)[4:] for r in found) and all(sum(r[i] or 0 for r in found) for i in range(4))
    assert all(p.startswith("(?=[") or p.startswith("(?=\\d") for _, p in text.dense_patterns())
