"""Reading marks back and main content, against brute force and planted cases."""

import numpy as np
from pyspark.sql import functions as F

from millrace.functions import watermarks
from millrace.sources import main_content

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def test_marks_are_read_back_from_edited_records(spark):
    rng = np.random.default_rng(3)
    text = lambda: " ".join(str(w) + rng.choice([".", ",", ""]) for w in rng.choice(WORDS, 90))
    rows = spark.createDataFrame([(k, text()) for k in range(400)] + [(900, None), (901, ""), (902, "one two")], "i long, t string")
    marked = watermarks.embed(rows, "i", "t", "acme", "b1", "key")
    bits = {r.i: r.b for r in marked.select("i", watermarks.hidden_bits(F.col("marked")).alias("b")).collect()}
    own = watermarks.Keyed("acme", "b1", "key")
    assert all(bits[k] == f"{own._number(f'zwc|{k}', 4):032b}" for k in range(400)) and bits[901] == "" and bits[900] is None
    tenth = marked.where("i % 10 = 7")
    edited = tenth.select("i", F.expr("concat('new start ', substring(marked, 1, 2 * length(marked) div 3))").alias("t"))
    lost = tenth.select("i", F.expr(f"regexp_replace(marked, '^([^{watermarks.INVISIBLE}]*)[{watermarks.INVISIBLE}]', '$1')").alias("t"))  # the first is gone
    candidates = [("acme", "b1"), ("acme", "b2"), ("rival", "b1")]
    for frame, secret, want in ((edited, "key", True), (edited, "wrong", False), (lost, "key", False)):
        got = {(r.client, r.batch): r for r in watermarks.votes(frame, "i", "t", candidates, secret).collect()}
        assert not any(r.found for k, r in got.items() if k != ("acme", "b1"))
        assert (("acme", "b1") in got and got["acme", "b1"].found) == want
    both = watermarks.votes(edited.unionByName(rows.where("i % 10 = 1")), "i", "t", candidates, "key").collect()
    assert [(r.client, r.batch) for r in both if r.found] == [("acme", "b1")]
    assert watermarks.votes(rows.limit(0), "i", "t", candidates, "key").count() == 0


MENU = "<nav><ul>" + "".join(f"<li><a href='/{k}'>Section number {k}</a></li>" for k in range(12)) + "</ul></nav>"
BODY = (
    "<article><h1>Heat in cities</h1><p>" + "Streets without trees stay warm through the night, and that harms health. " * 4 + "</p><p>So it is.</p>"
    "<table><tr><th>City</th><th>Degrees</th></tr><tr><td>Paris and its many suburbs</td><td>41</td></tr></table>"
    "<p>" + "Water helps as well as shade does, where there is room for either. " * 3 + "</p></article>"
)
FOOT = "<div class='site-footer'><p>Contact, imprint and a rather long sentence about cookies that nobody reads at all, ever.</p></div><script>var x = 'no text';</script>"


def test_boilerplate_goes_and_content_stays():
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body>{MENU}{BODY}{FOOT}</body></html>"
    text = main_content.main_content(page)
    lines = text.split("\n")
    assert lines[0].startswith("Streets") or lines[0] == "Heat in cities"
    assert "So it is." in lines and "Paris and its many suburbs | 41" in lines and lines[-1].startswith("Water helps")
    assert not any(w in text for w in ("Section number", "imprint", "no text"))
    assert main_content.extracted(page)[1] == "main"
    assert main_content.extracted("<p>short</p>") == ("short", "elements") and main_content.extracted("<b>x</b> y") == ("x y", "stripped")
    assert main_content.extracted(None) == ("", "stripped") and main_content.extracted("<p>a<p>b<div") [1] == "elements"


def test_best_run_equals_brute_force():
    rng = np.random.default_rng(8)
    for n in [0, 1, 2, *rng.integers(3, 30, 200)]:
        scores = rng.integers(-9, 9, n).tolist()
        sums = [(sum(scores[i:j]), i, j) for i in range(n) for j in range(i + 1, n + 1)]
        lo, hi = main_content.best_run(scores)
        assert sum(scores[lo:hi]) == max([0, *(s for s, _, _ in sums)])


def test_content_of_all_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    planted = pages.withColumn("html", F.concat(F.lit(MENU), "html", F.lit(FOOT)))
    got = main_content.with_content(planted, "page_id", "html").collect()
    assert len(got) == pages.count() and all(r.way in ("main", "elements", "stripped") for r in got)
    main = [r for r in got if r.way == "main"]
    assert len(main) > len(got) / 4 and not any("Section number" in r.content or "imprint" in r.content for r in main)
