"""State by key and entry: restarts, limits by count and age, timers, ties, and a topic with very many URLs."""

import datetime as dt
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from millrace.streaming import keyed, streams


@pytest.fixture(autouse=True)
def rocksdb(spark):
    keyed.keep_state_in_rocksdb(spark)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.unset("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled")


def put(spark, folder, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def source(spark, folder, schema):
    return spark.readStream.schema(schema).parquet(f"{folder}/in")


def test_topic_urls_survive_restarts(spark, tmp_path):
    folder, schema = str(tmp_path), "topic string, url string"
    put(spark, folder, [("a", "1"), ("a", "2"), ("a", "1"), ("b", "1"), ("a", None), (None, "9")], schema)
    run = lambda: streams.drain(keyed.topic_urls(source(spark, folder, schema), "topic", "url"), folder)
    assert {(r.topic, r.url) for r in run().collect()} == {("a", "1"), ("a", "2"), ("b", "1"), (None, "9")}
    put(spark, folder, [("a", "2"), ("a", "3"), ("b", "1"), ("b", "0")], schema)
    got = run().collect()
    assert sorted((r.topic or "", r.url) for r in got) == [("", "9"), ("a", "1"), ("a", "2"), ("a", "3"), ("b", "0"), ("b", "1")]
    assert sorted(r.position for r in got if r.topic == "a") == [0, 1, 2]


def test_a_topic_with_very_many_urls(spark, tmp_path):
    folder, n = str(tmp_path), 60_000
    spark.range(n).selectExpr("'t' AS topic", "concat('https://a.org/', id) AS url").repartition(3).write.parquet(f"{folder}/in")
    got = streams.drain(keyed.topic_urls(source(spark, folder, "topic string, url string"), "topic", "url"), folder)
    assert got.selectExpr("count(*) n", "count(distinct url) u", "max(position) m").collect()[0] == (n, n, n - 1)


def at(hours):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)


def test_retention_by_count_and_age(spark, tmp_path):
    folder, schema = str(tmp_path), "subject string, id long, ts timestamp"
    run = lambda: streams.drain(keyed.retained(source(spark, folder, schema), "subject", "id", "ts", 3, 10), folder)
    put(spark, folder, [("a", k, at(k)) for k in range(1, 6)] + [("b", 1, at(0)), ("b", 2, at(0))], schema)
    run()
    put(spark, folder, [("a", 6, at(14)), ("a", 7, at(2)), ("b", 3, at(0)), ("b", 4, at(0))], schema)
    changes = {}
    for r in run().collect():
        changes.setdefault((r.subject, r.id), set()).add(r.change)
    assert {k for k, c in changes.items() if "dropped" not in c} == {("a", 4), ("a", 5), ("a", 6), ("b", 2), ("b", 3), ("b", 4)}
    assert changes["a", 7] == changes["b", 1] == {"received", "dropped"}


def test_session_entries_and_their_timers(spark, tmp_path):
    folder, schema = str(tmp_path), "s long, e string, v double, id long, ts timestamp"
    run = lambda: streams.drain(keyed.session_entries(source(spark, folder, schema), "s", "e", "v", "id", "ts", 5), folder)
    put(spark, folder, [(1, "x", 1.0, 1, at(0)), (1, "x", 2.0, 2, at(0)), (1, "y", None, 3, at(1)), (2, "x", 5.0, 4, at(2))], schema)
    run()
    put(spark, folder, [(1, "x", 9.0, 0, at(0)), (2, "x", 6.0, 5, at(20))], schema)
    run()
    put(spark, folder, [(3, "x", 7.0, 6, at(21))], schema)
    got = sorted((r.s, r.e, r.v, r.id, r.change) for r in run().selectExpr("session s", "entry e", "coalesce(value, -1) v", "id", "change").collect())
    assert [g for g in got if g[4] == "expired"] == [(1, "x", 2.0, 2, "expired"), (1, "y", -1.0, 3, "expired")]
    assert [g for g in got if g[4] == "set"] == [(1, "x", 2.0, 2, "set"), (1, "y", -1.0, 3, "set"), (2, "x", 5.0, 4, "set"), (2, "x", 6.0, 5, "set"), (3, "x", 7.0, 6, "set")]


class _State(dict):
    """A map or value state that counts what is written."""

    writes = 0

    def keys(self):
        return iter(list(dict.keys(self)))

    def updateValue(self, k, v):  # noqa: N802  Spark's names
        self.writes += 1
        self[k] = v

    def removeKey(self, k):  # noqa: N802
        self.writes += 1
        del self[k]

    def getValue(self, k):  # noqa: N802
        return dict.get(self, k)

    containsKey = dict.__contains__  # noqa: N815


class _One:
    def __init__(self):
        self.v = None

    exists = lambda self: self.v is not None
    get = lambda self: self.v

    def update(self, v):
        self.v = v


def test_what_goes_at_once_never_enters_the_state():
    rng, p = np.random.default_rng(6), keyed._Retained(20, 6 * keyed.HOUR)
    p.held, p.newest, seen, held = _State(), _One(), [], set()
    for _ in range(3):
        frames = [pd.DataFrame({"ts": pd.to_datetime(rng.integers(0, 30 * 3600, 500), unit="s"), "id": rng.permutation(500) + 1000 * k}) for k in range(4)]
        for out in p.handleInputRows(("a",), iter(frames), None):
            for i, change in zip(out["id"], out["change"], strict=True):
                seen.append((i, change))
        every = {(int(t.timestamp() * 1000), int(i)) for f in frames for t, i in zip(f["ts"], f["id"], strict=True)} | held
        top = max(every)[0]
        held = set(sorted(e for e in every if e[0] >= top - 6 * keyed.HOUR)[-20:])
        assert set(p.held.keys()) == held
    came = Counter(i for i, c in seen if c == "received")
    went = Counter(i for i, c in seen if c == "dropped")
    assert sum(came.values()) == 6000 and sum(came.values()) - sum(went.values()) == len(held) and p.held.writes <= 3 * 2 * 20


def test_a_batch_writes_an_entry_once():
    p = keyed._Entries(keyed.HOUR)
    p.entries, p.until, timers = _State(), _One(), []
    p.handle = type("H", (), {"deleteTimer": lambda self, t: timers.remove(t), "registerTimer": lambda self, t: timers.append(t)})()
    frames = [pd.DataFrame({"ts": pd.to_datetime([k * 10, k * 10 + 1], unit="s"), "entry": ["x", "y"], "value": [float(k), None], "id": [k, k]}) for k in range(50)]
    out = pd.concat(list(p.handleInputRows((1,), iter(frames), None)))
    assert p.entries.writes == 2 and dict(p.entries) == {("x",): (490_000, 49, 49.0), ("y",): (491_000, 49, None)} and timers == [491_000 + keyed.HOUR]
    assert sorted(zip(out["entry"], out["id"], strict=True)) == [("x", 49), ("y", 49)]
    assert pd.concat(list(p.handleInputRows((1,), iter(frames[:3]), None))).empty and p.entries.writes == 2
