"""Connectors on answers in the form of their sources, polling rules and stateful streams against one-by-one runs."""

import json
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.plans.connector_answers import ANSWERS
from millrace.plans.registry import QUERIES
from millrace.sources import connector_source, connectors
from millrace.streaming import shedding, streams

ATOM = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>On\nlight</title><link rel="alternate" href="https://arxiv.org/abs/1"/><published>2024-01-02T03:04:05Z</published></entry><entry><title>lost</title></entry></feed>'
RSS = "<rss><channel><item><title>Act</title><link>https://eba.europa.eu/a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate><description>d</description></item></channel></rss>"
NOON = "2024-01-02T03:04:05+00:00"
DAY = "2024-01-02T00:00:00+00:00"
CASES = [
    ("arxiv", ATOM, ("https://arxiv.org/abs/1", "On light", NOON, "S", True, "")),
    ("eba", RSS, ("https://eba.europa.eu/a", "Act", NOON, "A", True, "d")),
    ("biorxiv", {"collection": [{"doi": "10.1/x", "title": " T ", "abstract": "a", "date": "2024-01-02"}]}, ("https://doi.org/10.1/x", "T", DAY, "A", False, "a")),
    ("semanticscholar", {"data": [{"openAccessPdf": None, "externalIds": {"DOI": "10.2/y"}, "title": "S", "year": 2024}]}, ("https://doi.org/10.2/y", "S", "2024-01-01T00:00:00+00:00", "", False, "")),
    ("pubmed", {"result": {"uids": ["7"], "7": {"title": "P", "pubdate": "2024"}}}, ("https://pubmed.ncbi.nlm.nih.gov/7/", "P", "2024-01-01T00:00:00+00:00", "S", True, "")),
    ("europepmc", {"resultList": {"result": [{"pmid": "5", "title": "E"}]}}, ("https://europepmc.org/article/med/5", "E", "", "A", True, "")),
    ("core", {"results": [{"identifiers": [{"identifier": "oai:1"}], "title": "C", "publishedDate": "soon"}]}, ("oai:1", "C", "soon", "A", False, "")),
    ("philpapers", [{"link": "https://philpapers.org/rec/1", "title": "W", "date": "2024/01/02"}], ("https://philpapers.org/rec/1", "W", DAY, "A", True, "")),
    ("acm", {"results": [{"open_access": {}, "doi": "10.3/z", "title": "M"}]}, ("https://doi.org/10.3/z", "M", "", "", False, "")),
    ("base", {"response": {"docs": [{"dclink": ["https://b.org/1", "x"], "dctitle": "B", "dcyear": 2024}]}}, ("https://b.org/1", "B", "2024-01-01T00:00:00+00:00", "", False, "")),
    ("federalregister", {"results": [{"html_url": "https://federalregister.gov/1", "title": None, "publication_date": "2024-01-02"}]}, ("https://federalregister.gov/1", "", DAY, "S", True, "")),
    ("epo", {"ops:world-patent-data": {"ops:biblio-search": {"ops:search-result": {"ops:publication-reference": [{"document-id": {"country": {"$": "EP"}, "doc-number": {"$": "12"}, "kind": {"$": "A1"}}}]}}}}, ("https://worldwide.espacenet.com/patent/search?q=EP12A1", "Patent EP12A1", "", "A", True, "")),
    ("secedgar", {"hits": {"hits": [{"_id": "f1", "_source": {"display_names": [], "file_date": "2024-01-02"}}]}}, ("https://www.sec.gov/Archives/edgar/full-index/f1", "SEC Filing", DAY, "S", True, "")),
    ("wipo", {"resultsList": {"wipo:PCT": {"wipo:internationalApplicationNumber": "PCT1", "title": "I"}}}, ("https://patentscope.wipo.int/search/en/detail.jsf?docId=PCT1", "I", "", "S", True, "")),
    ("europeana", {"items": [{"guid": "https://europeana.eu/1", "edmIsShownAt": [], "title": ["T"], "year": ["2024"], "dcDescription": ["d"]}]}, ("https://europeana.eu/1", "T", "2024-01-01T00:00:00+00:00", "B", True, "d")),
    ("worldbank", {"documents": {"D1": {"url": "https://documents.worldbank.org/1", "display_title": "D", "docdt": "2024-01-02T03:04:05Z"}}}, ("https://documents.worldbank.org/1", "D", NOON, "A", True, "")),
    ("reddit", {"data": {"children": [{"data": {"url": "https://r.example/1", "title": "R", "created_utc": 1704164645.0, "selftext": "s" * 600}}]}}, ("https://r.example/1", "R", NOON, "C", True, "s" * 500)),
    ("mastodon", {"statuses": [{"url": "https://m.example/1", "account": {"username": "u"}, "content": "<p>hi <b>all</b></p>", "created_at": "2024-01-02T03:04:05.000Z"}]}, ("https://m.example/1", "[u] hi all", NOON, "C", True, "<p>hi <b>all</b></p>")),
    ("youtube", {"items": [{"id": {"videoId": "v1"}, "snippet": {"title": "Y", "publishedAt": "2024-01-02T03:04:05Z"}}]}, ("https://www.youtube.com/watch?v=v1", "Y", NOON, "B", True, "")),
    ("jstor", {"results": {"items": [{"stableUrl": "https://www.jstor.org/1", "title": "J", "pubYear": 2024}]}}, ("https://www.jstor.org/1", "J", "2024-01-01T00:00:00+00:00", "A", True, "")),
]


@pytest.mark.parametrize("source,answer,want", CASES)
def test_answers(source, answer, want):
    assert connectors.parse(source, answer if isinstance(answer, str) else json.dumps(answer)) == [want]


@pytest.mark.parametrize("answer", ANSWERS, ids=lambda a: a.source)
def test_answers_written_by_hand(answer):
    filled = lambda text: text.replace("{n}", "4711")
    got = connectors.parse(answer.source, filled(answer.payload))
    tier = connectors.SPECS[answer.source].tier and answer.tier  # else it follows from the URL
    assert got == [(filled(answer.url), filled(answer.title), answer.published_at, tier, answer.verified, filled(answer.snippet))]
    assert connectors.SPECS[answer.source].layer == answer.layer


def test_every_source_has_an_answer_and_broken_ones_give_nothing(spark):
    assert [a.source for a in ANSWERS] == list(connectors.SPECS) and len(ANSWERS) == 46
    assert connectors.parse("arxiv", "<x") == connectors.parse("imf", "[") == connectors.parse("imf", None) == connectors.parse("none", "{}") == []
    both = [("medrxiv", ANSWERS[2].payload), ("biorxiv", ANSWERS[2].payload), ("hdx", ANSWERS[33].payload)]
    rows = connectors.sources(spark.createDataFrame(both, "source string, payload string"))
    assert sorted(r.source for r in connectors.fan_out(rows).collect()) == ["biorxiv", "hdx"]  # the first by layer and source


def _write_pages(spark, folder, rows):
    spark.createDataFrame(rows, "source string, mark string, payload string").write.partitionBy("source").mode("append").parquet(f"{folder}/answers")


def _page(source, n):
    return source, f"{n:04d}", next(a.payload for a in ANSWERS if a.source == source).replace("{n}", str(n))


def test_connector_stream_restarts_without_loss_or_repeat(spark, tmp_path):
    folder = f"file://{tmp_path}"
    clock, limit = shedding.SharedNumber(f"{folder}/clock", 0), shedding.SharedNumber(f"{folder}/limit", 1000)
    archive = connector_source.FolderArchive(f"{folder}/answers")
    kind = connector_source.connector_format("restarted", archive, ["github", "imf", "arxiv"], clock, limit, per_partition=4, control=f"{folder}/control")
    fail = {"left": 1}

    def run(batches=None):
        def put(batch, number):
            rows = batch.collect()
            if fail["left"] and any(r.source == "imf" for r in rows):
                fail["left"] -= 1
                raise RuntimeError("the sink is down")
            got.update({number: [(r.source, r.mark) for r in rows]})

        q = connector_source.item_stream(spark, kind).writeStream.foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
        q.awaitTermination()

    got = {}
    _write_pages(spark, folder, [_page("github", n) for n in range(1, 12)] + [_page("imf", 3)])
    with pytest.raises(Exception, match="down"):
        run()
    run()  # the failed batch runs again as it was planned
    first = sorted(x for rows in got.values() for x in rows)
    assert first == sorted([("github", f"{n:04d}") for n in range(1, 12)] + [("imf", "0003")])
    _write_pages(spark, folder, [_page("github", n) for n in range(12, 20)] + [_page("arxiv", 1), _page("imf", 9)])
    run()  # nothing is due yet at this clock
    assert sorted(x for rows in got.values() for x in rows) == first
    clock.put(1000)
    limit.put(5)
    run()  # github and arxiv are due after 900 and 120 seconds, imf after 3600; five pages of a source are admitted
    clock.put(9000)
    limit.put(1000)
    run()
    every = sorted(x for rows in got.values() for x in rows)
    assert every == sorted([("github", f"{n:04d}") for n in range(1, 20)] + [("imf", "0003"), ("imf", "0009"), ("arxiv", "0001")])
    assert connector_source.items(spark, kind).count() == len(every)
    assert connector_source.items(spark, kind, since="0010").count() == 9


def test_ticks_pause_sources_that_fail():
    class Failing:
        def latest(self, source, after, most):
            raise TimeoutError

    now = [0]
    reader = connector_source._Stream(Failing(), ["imf"], lambda: now[0], lambda: 5, 10, None)
    seen = []
    for at in (0, 10, 3600, 7200, 10800, 14400, 14500, 18000):
        now[0] = at
        seen.append(reader.latestOffset()["imf"])
    assert [s["poll"][2] for s in seen] == [1, 1, 2, 3, 4, 0, 0, 1]
    assert seen[5]["poll"][3] == 14400 + connectors.PAUSE and all(s["mark"] == "" for s in seen)


def test_load_shedding_follows_its_rule(tmp_path):
    limit = shedding.SharedNumber(f"file://{tmp_path}/limit", 100)
    listener = shedding.LoadShedding(limit)
    took = [6, 6.5, 6.9, 9, 2, 2, 2, 2, 2, 2, 2, 2, 2, 5]
    want = [6, 7, 6.5, 7.5, 7, 6.5, 6, 5.5, 5, 5, 5, 5, 5, 6]
    for seconds, tick in zip(took, want, strict=True):
        listener.took(seconds)
        assert listener.tick == tick and limit() == int(100 * 5 / tick)
    assert listener.drifts == 4
    for _ in range(40):
        listener.took(100)
    assert listener.tick == shedding.MAX_TICK and limit() == 16


def test_slow_batches_narrow_the_next_trigger(spark, tmp_path):
    import time

    folder = f"file://{tmp_path}"
    limit = shedding.SharedNumber(f"{folder}/limit", 8)
    listener = shedding.LoadShedding(limit, base=0.5, most=30)
    kind = connector_source.connector_format("shed", connector_source.FolderArchive(f"{folder}/answers"), ["github"], lambda: time.time() * 1e4, limit)
    _write_pages(spark, folder, [_page("github", n) for n in range(1, 21)])
    spark.streams.addListener(listener)
    sizes = []
    try:
        q = connector_source.item_stream(spark, kind).writeStream.foreachBatch(lambda b, _: (sizes.append(b.count()), time.sleep(1.6))).option("checkpointLocation", f"{folder}/state").start()
        for _ in range(150):
            if sum(sizes) >= 20:
                break
            time.sleep(0.2)
        q.stop()
    finally:
        spark.streams.removeListener(listener)
    assert sum(sizes) == 20 and sizes[0] == 8 and min(s for s in sizes[1:] if s) < 8 and listener.drifts >= 1


def test_fetching_never_fails_a_job(spark):
    def fetch(url):
        if "raise" in url:
            raise TimeoutError("slow")
        return {"a": (200, "body"), "b": (404, "no"), "c": (503, "later")}[url]

    rows = spark.createDataFrame([("1", "a"), ("2", "b"), ("3", "c"), ("4", "raise")], "source string, url string")
    got = {r.source: (r.status, r.payload, r.error, r.attempts) for r in connectors.fetched(rows, fetch).collect()}
    assert got == {"1": (200, "body", None, 1), "2": (404, None, "status 404", 1), "3": (503, None, "status 503", 3), "4": (None, None, "TimeoutError: slow", 3)}


def test_polling_rules():
    s, seen = connectors.Poll(300), []
    for at, ok, found in [(0, True, False), (1, True, False), (2, True, False), (3, True, True), *[(4 + k, False, False) for k in range(5)], (100, True, True), (308, True, False)]:
        s, outcome = connectors.step(s, at, ok, found, 300)
        seen.append((outcome, s.interval))
    assert seen == [("empty", 300), ("empty", 300), ("empty", 600), ("found", 300), *[("failed", 300)] * 4, ("paused", 300), ("skipped", 300), ("empty", 300)]
    s = connectors.Poll(3000)
    for k in range(3):
        s, _ = connectors.step(s, k, True, False, 300)
    assert s.interval == 3600


def test_streams_follow_one_by_one_runs(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    events = sorted(spark.read.parquet(f"{sf}/events.parquet").collect(), key=lambda r: (r.ts, r.event_type != "error", r.event_type in ("purchase", "signup")))
    state, want = {}, []
    for r in events:
        ok, found = r.event_type != "error", r.event_type in ("purchase", "signup")
        at = int(r.ts.replace(tzinfo=__import__("datetime").UTC).timestamp())
        state[r.user_id % 40], outcome = connectors.step(state.get(r.user_id % 40, connectors.Poll(300)), at, ok, found, 300)
        want.append((r.user_id % 40, outcome, state[r.user_id % 40].interval))
    assert sorted((r.source, r.outcome, r.interval) for r in QUERIES["source_polls"](spark, sf).collect()) == sorted(want)

    rows = [(k, k % 2, 0.99 if k % 2 else 0.80) for k in range(400)]
    spark.createDataFrame(rows, "n long, key long, score double").coalesce(1).write.parquet(str(tmp_path / "scores"))
    stream = spark.readStream.schema("n long, key long, score double").parquet(str(tmp_path / "scores"))
    got = streams.drain(streams.adaptive_threshold(stream, "key", "n", "score"), str(tmp_path / "out")).orderBy("key", "n").collect()
    high = [r.threshold for r in got if r.key == 1]
    assert high[:3] == [0.82, 0.83, 0.84] and high[-1] == 0.84 and [r.threshold for r in got if r.key == 0][-1] == 0.77


def test_marks_and_dead_sources(spark):
    items = spark.createDataFrame([("a", "3"), ("a", "5"), ("b", "1"), ("c", None)], "source string, id string")
    seen, after = connectors.newer(items, spark.createDataFrame([("a", "3"), ("d", "9")], "source string, mark string"), "id")
    assert sorted((r.source, r.id or "") for r in seen.collect()) == [("a", "5"), ("b", "1"), ("c", "")]
    assert {r.source: r.mark for r in after.collect()} == {"a": "5", "b": "1", "c": None, "d": "9"}
    assert connectors.sources(items.select("source", F.col("id").alias("payload")).limit(0)).count() == 0
