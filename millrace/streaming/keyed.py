"""State by key and entry (``transformWithState`` on RocksDB): every URL, message and session entry is a row of state of its own.

A key's state is never one value that grows: entries are looked up one at a time, so memory does not depend on how many a key has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000
_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """State goes to RocksDB, with change logs in the checkpoint: what these operators need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Urls(StatefulProcessor):
    """A topic's URLs with their positions; each is forgotten ``ttl_ms`` after it came, where that is given."""

    def __init__(self, ttl_ms: int | None):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.urls = handle.getMapState("urls", "url string", "position long", self.ttl_ms)
        self.count = handle.getValueState("count", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        n = self.count.get()[0] if self.count.exists() else 0
        for f in rows:
            fresh = []
            for url in f["url"].dropna().drop_duplicates():
                if not self.urls.containsKey((url,)):
                    self.urls.updateValue((url,), (n,))
                    fresh.append((key[0], url, n))
                    n += 1
            yield pd.DataFrame(fresh, columns=["topic", "url", "position"])
        self.count.update((n,))

    def close(self) -> None:
        pass


def topic_urls(rows: DataFrame, topic: str, url: str, ttl_hours: int | None = None) -> DataFrame:
    """topic, url, position: each topic's URLs that it does not hold yet; null URLs are left out.

    Positions are gapless over a topic's life.  With ``ttl_hours`` (of processing time) a URL that comes again after its time to live is
    new; such a stream never runs out of batches, so it needs a trigger that goes on, not one that stops at what is there now.
    """
    kind = rows.schema[topic].dataType.simpleString()
    keyed = rows.select(F.col(topic).alias("topic"), F.col(url).alias("url")).groupBy("topic")
    ttl = ttl_hours * HOUR if ttl_hours else None
    return keyed.transformWithStateInPandas(_Urls(ttl), f"topic {kind}, url string, position long", "Append", "ProcessingTime" if ttl else "None")


class _Retained(StatefulProcessor):
    """The newest messages of a subject by (ts, id): at most ``most``, none older than ``age_ms`` before the newest one."""

    def __init__(self, most: int, age_ms: int):
        self.most, self.age_ms = most, age_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "at long, id long", "there boolean")
        self.newest = handle.getValueState("newest", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """What is held, which the limit bounds, is read once and written once; a message that goes at once never enters the state."""
        newest = self.newest.get()[0] if self.newest.exists() else None
        stored = {(int(k[0]), int(k[1])) for k in self.held.keys()}  # noqa: SIM118  a state, not a dict
        held = stored
        for f in rows:
            at = f["ts"].astype("int64").to_numpy() // {"ns": 1_000_000, "us": 1_000, "ms": 1}[f["ts"].dt.unit]
            came = pd.DataFrame({"at": at, "id": f["id"].to_numpy()})
            newest = max([int(at.max()), *([] if newest is None else [newest])])
            best = came[at >= newest - self.age_ms].drop_duplicates().sort_values(["at", "id"]).tail(self.most)
            both = sorted(held.union(zip(best["at"].tolist(), best["id"].tolist(), strict=True)))
            kept = set([k for k in both if k[0] >= newest - self.age_ms][-self.most :])
            ids = came["id"].to_numpy()
            stays = np.isin(ids, np.array([i for _, i in kept], np.int64))  # by id first, the few that pass by both
            stays[stays] = [k in kept for k in zip(at[stays].tolist(), ids[stays].tolist(), strict=True)]
            gone = np.concatenate((ids[~stays], np.array([k[1] for k in held - kept], np.int64)))
            held = kept
            yield pd.DataFrame({"subject": key[0], "id": np.concatenate((ids, gone)), "change": ["received"] * len(ids) + ["dropped"] * len(gone)})
        for k in stored - held:
            self.held.removeKey(k)
        for k in held - stored:
            self.held.updateValue(k, (True,))
        self.newest.update((newest,))

    def close(self) -> None:
        pass


def retained(rows: DataFrame, subject: str, key: str, ts: str, most: int, age_hours: float) -> DataFrame:
    """subject, id, change of a bus with limits: 'received' for each message, 'dropped' for one that a limit removes later.

    A message that arrives when it is too old already is received and dropped at once.
    """
    kind = rows.schema[subject].dataType.simpleString()
    keyed = rows.select(F.col(subject).alias("subject"), F.col(key).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts")).groupBy("subject")
    return keyed.transformWithStateInPandas(_Retained(most, int(age_hours * HOUR)), f"subject {kind}, id long, change string", "Append", "None")


class _Entries(StatefulProcessor):
    """A session's entries, the last value of each by (ts, id); a timer forgets the session ``ttl_ms`` after its last entry."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "entry string", "at long, id long, value double")
        self.until = handle.getValueState("until", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """A batch's last values first; then the session's entries are read once, and what is new is written once."""
        until = self.until.get()[0] if self.until.exists() else None
        last = {}
        for f in rows:
            at = f["ts"].astype("int64") // {"ns": 1_000_000, "us": 1_000, "ms": 1}[f["ts"].dt.unit]
            f = f.assign(at=at).sort_values(["at", "id"]).drop_duplicates("entry", keep="last")
            for entry, t, i, value in f[["entry", "at", "id", "value"]].itertuples(index=False):
                if entry not in last or (t, i) > last[entry][:2]:
                    last[entry] = (int(t), int(i), None if pd.isna(value) else float(value))
        out = []
        for entry, (t, i, value) in last.items():
            old = self.entries.getValue((entry,)) if until is not None else None  # a session without a timer holds nothing
            if old is None or (t, i) > (old[0], old[1]):
                self.entries.updateValue((entry,), (t, i, value))
                out.append((key[0], entry, value, i, pd.Timestamp(t + self.ttl_ms, unit="ms"), "set"))
        latest = max([t + self.ttl_ms for t, _, _ in last.values()], default=until)
        if latest is not None and (until is None or latest > until):
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(latest)
            self.until.update((latest,))
        yield pd.DataFrame(out, columns=["session", "entry", "value", "id", "expires", "change"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = [(key[0], k[0], v[2], v[1], pd.Timestamp(v[0] + self.ttl_ms, unit="ms"), "expired") for k, v in self.entries.iterator()]
        self.entries.clear()
        self.until.clear()
        yield pd.DataFrame(out, columns=["session", "entry", "value", "id", "expires", "change"])

    def close(self) -> None:
        pass


def session_entries(rows: DataFrame, session: str, entry: str, value: str, key: str, ts: str, ttl_hours: int = 24, late: str = "1 hour") -> DataFrame:
    """session, entry, value, id, expires, change: 'set' for each new last value of an entry (ties in time go to the greater id), 'expired'
    for all entries of a session that the watermark has left behind."""
    kind = rows.schema[session].dataType.simpleString()
    named = rows.select(
        F.col(session).alias("session"), F.col(entry).cast("string").alias("entry"), F.col(value).cast("double").alias("value"),
        F.col(key).cast("long").alias("id"), F.col(ts).cast("timestamp").alias("ts"),
    )
    keyed = named.withWatermark("ts", late).groupBy("session")
    schema = f"session {kind}, entry string, value double, id long, expires timestamp, change string"
    return keyed.transformWithStateInPandas(_Entries(ttl_hours * HOUR), schema, "Append", "EventTime")
