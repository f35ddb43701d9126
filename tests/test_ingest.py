"""Chunks, question types, parsers, feeds, leases and dead letters on small hand-written inputs."""

import io
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from millrace.functions import questions
from millrace.operators import chunker, generation
from millrace.sources import parsers
from millrace.streaming import streams


def test_sections_and_packing():
    assert chunker.sections("lost\n# A\none\n## B\n\n### C\nthree") == [("A", "one"), ("C", "three")]
    assert chunker.sections("Art. 5 scope\nfirst\n§ 6\nsecond") == [("Art. 5 scope", "first"), ("§ 6", "second")]
    assert chunker.sections(" plain ") == [("", "plain")]
    long = "\n\n".join("Sentence number one is here. " * 20 for _ in range(12))
    parts = chunker.pack(long)
    assert all(len(p) <= 2200 for p in parts) and re.sub(r"\s", "", "".join(parts)) == re.sub(r"\s", "", long)
    assert chunker.pack("x" * 3000) == ["x" * 3000]
    assert all(len(p) <= 2200 for p in chunker.pack("word " * 2000))
    merged = chunker.chunks("# A\n" + "a" * 130 + "\n# B\n" + "b" * 200 + "\n# C\n" + "c" * 300, overlap=10)
    assert merged == [("A", "a" * 130 + "\n\n## B\n\n" + "b" * 200), ("C", "[..." + "b" * 10 + "]\n\n" + "c" * 300)]
    assert chunker.chunks(None) == chunker.chunks("") == chunker.chunks("short") == []


def test_chunk_documents_handles_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "y" * 400, "t"), (2, None, "t"), (None, "z" * 300, "t"), (1, "y" * 400, "t")], "doc_id long, text string, title string")
    assert sorted((r.doc_id or 0, r.chunk_index) for r in chunker.chunk_documents(docs, "doc_id", "text").collect()) == [(0, 0), (1, 0), (1, 0)]
    assert chunker.chunk_documents(docs.limit(0), "doc_id", "text").count() == 0


def test_question_types_equal_patterns(spark):
    asked = ["Kto jest objęty obowiązkiem raportowania ESG?", "Co to jest CSRD?", "Porównaj obie dyrektywy, różnica i implikacje", "Jak należy złożyć raport?", "ąkto", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string").select("i", questions.question_type(F.col("t")).alias("q"), questions.difficulty(F.col("t")).alias("d")).orderBy("i").collect()
    for r, t in zip(rows, asked, strict=True):
        low = (t or "").lower()
        assert r.q == next((k for k, ps in questions.TYPES.items() if any(re.search(p, low) for p in ps)), "factual")
        hard, easy = (sum(bool(re.search(p, low)) for p in ps) for ps in (questions.HARD, questions.EASY))
        assert r.d == ("hard" if hard >= 2 or (hard and len(t) > 140) else "easy" if easy and not hard else "medium")
    assert (rows[0].q, rows[1].q, rows[1].d, rows[4].q) == ("scope", "factual", "easy", "factual")


def book(**parts) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(name, body)
    return out.getvalue()


def test_parsers(spark, tmp_path):
    w = 'xmlns:w="w"'
    doc = book(**{"word/document.xml": f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>'})
    sheet = book(**{"xl/workbook.xml": '<workbook><sheets><sheet name="S"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>k</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c t="s"><v>0</v></c></row><row><c><v>7</v></c></row></sheetData></worksheet>'})
    deck = book(**{"ppt/slides/slide1.xml": '<s xmlns:a="a"><a:p><a:r><a:t>One</a:t></a:r></a:p><a:p><a:r><a:t>Two</a:t></a:r></a:p></s>'})
    page = b"<html><nav>menu</nav><h2>Head</h2><p>Some <b>bold</b> text</p><ul><li>item</li></ul><script>x()</script></html>"
    (tmp_path / "sub").mkdir()
    for name, raw in {"a.docx": doc, "b.xlsx": sheet, "c.pptx": deck, "d.HTML": page, "sub/e.txt": "zażółć".encode(), "f.csv": b"x,y\n1,2\n", "g.pdf": b"%PDF", "h.docx": b"broken", "i.srt": b"1\n00:00:01,000 --> 00:00:02,000\n<i>Hi</i> there\n"}.items():
        (tmp_path / name).write_bytes(raw)
    got = {r.path.rsplit("/", 1)[1]: r for r in parsers.parse(parsers.files(spark, str(tmp_path))).collect()}
    assert got["a.docx"].text == "## Title\n\nBody\n\n| a | b |" and got["c.pptx"].text == "[Slide 1] One | Two"
    assert '"columns": ["k"]' in got["b.xlsx"].text and '"row_count": 1' in got["b.xlsx"].text
    assert got["d.HTML"].text == "## Head\n\nSome bold text\n\n- item" and got["e.txt"].text == "zażółć" and got["f.csv"].text == "Columns: x, y\n1, 2"
    assert got["g.pdf"].error == "no parser for pdf" and got["h.docx"].error and got["i.srt"].text == "Hi there"
    assert parsers.files(spark, str(tmp_path), ["TXT"]).count() == 1


def test_feeds():
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T\nx</title><link rel="self" href="u0"/><link href="u1"/><updated>2024</updated><summary>s</summary></entry><entry><title>no link</title></entry></feed>'
    assert parsers.feed_items(atom) == [("u1", "T x", "2024", "s")]
    assert parsers.feed_items("<rss><channel><item><guid>g</guid><description>d</description></item></channel></rss>") == [("g", "", "", "d")]
    assert parsers.feed_items("<broken") == parsers.feed_items(None) == []


def test_json_lines_keep_corrupt_rows(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n\n{"a": \n')
    rows = parsers.json_lines(spark, str(tmp_path / "x.jsonl"), "a int").cache()
    assert (rows.count(), rows.where("corrupt is not null").count()) == (2, 1)


def test_topic_merge_over_two_batches_and_dead_letters(spark, tmp_path):
    src = str(tmp_path / "src")
    for k, rows in enumerate(([("t", "a"), ("t", "b"), ("t", "a"), ("s", "a")], [("t", "b"), ("t", "c"), ("t", None)])):
        spark.createDataFrame(rows, "topic string, url string").coalesce(1).write.mode("append").parquet(src)
        got = streams.drain(streams.merge_new_urls(streams.table_stream(spark, src), "topic", "url"), str(tmp_path / "m"))
    assert sorted((r.topic, r.url, r.position) for r in got.collect()) == [("s", "a", 0), ("t", "a", 0), ("t", "b", 1), ("t", "c", 2)]
    paths = [str(tmp_path / n) for n in ("good", "dead", "ck")]
    streams.write_with_dead_letters(streams.table_stream(spark, src), *paths, F.col("url") != "a").awaitTermination()
    assert spark.read.parquet(paths[0]).count() == 3 and spark.read.parquet(paths[1]).count() == 4


def test_leases(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("t", "subscribe", "2024-01-01 00:00:00", 86400), ("u", "unsubscribe", "2024-01-01 00:00:00", 0)], "topic string, kind string, at string, s int").withColumn("at", F.to_timestamp("at")).write.parquet(src)
    got = streams.drain(streams.leases(streams.table_stream(spark, src), "topic", "kind", "at", "s"), str(tmp_path / "l")).collect()
    assert [(r.topic, r.status) for r in got] == [("t", "verified")]


@pytest.mark.parametrize(("revised", "ok"), [("a text that is new and long", True), ("same  answer of some length", False), ("short", False), (None, False)])
def test_revision(spark, revised, ok):
    row = spark.createDataFrame([(False, "same answer of some length, with more words", 0.5, None)], "adversarial boolean, answer string, score double, rejected string")
    original = "same answer of some length"
    assert spark.range(1).select(generation.is_revision(F.lit(revised), F.lit(original)).alias("x")).first().x == ok
    got = generation.constitutional_revision(row, lambda a: F.lit("c"), lambda a, c: F.lit(revised)).first()
    assert (got.rejected is not None) == (revised is not None and len(revised) >= 20)


def test_files_are_parsed_some_at_a_time_and_one_without_content_fails_alone(spark):
    rows = spark.createDataFrame([("a", "html", b"<p>x</p>"), ("b", "html", None), ("c", None, b"y"), ("d", "own", b"z")], "path string, format string, content binary")
    parsed = parsers.parse(rows, {"own": lambda raw: str(type(raw) is bytes)})
    got = {r.path: (r.text, r.error) for r in parsed.collect()}
    assert got.pop("b")[1].startswith("TypeError") and got == {"a": ("x", None), "c": ("y", None), "d": ("True", None)}
    plan = parsed._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "MapInPandas" not in plan  # a hundred rows travel together, whatever a task holds
