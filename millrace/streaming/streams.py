"""Structured Streaming: keyed merges, bounded dedup, windowed cost, leases, and sinks that survive failed rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.sources import connectors

HOUR = 3_600_000


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A Parquet table (a folder, or one file) as a stream of its files; the limit sheds load."""
    pattern = f"{path[:-1]}[{path[-1]}]"  # as a pattern, for a plain path to one file is refused
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger).parquet(pattern)


def first_seen(rows: DataFrame, keys: list[str], ts: str, bound: str = "72 hours") -> DataFrame:
    """Rows whose keys were not seen within ``bound`` of event time; state is dropped beyond it."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, bound).dropDuplicatesWithinWatermark(keys)


def windowed_cost(rows: DataFrame, ts: str, keys: list[str], value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Sum and count by tumbling window and keys."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), *keys).agg(F.sum(value).alias("total"), F.count("*").alias("n")).select(F.col("w.start").alias("start"), *keys, "total", "n")


def merge_new_urls(rows: DataFrame, topic: str, url: str, ts: str | None = None, ttl_hours: int = 72) -> DataFrame:
    """topic, url, position: each topic's URLs that it did not hold yet.

    With ``ts`` a topic is forgotten once the watermark is ``ttl_hours`` past its last delivery; without, topics are kept.
    """

    def merge(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        known = list(state.get[0]) if state.exists else []
        seen, old, latest = set(known), len(known), 0
        for f in frames:
            if ts:
                latest = max(latest, int(f[ts].max().timestamp() * 1000))
            for u in f[url]:
                if u is not None and u not in seen:
                    seen.add(u)
                    known.append(u)
        state.update((known,))
        if ts:
            state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_hours * HOUR)
        fresh = known[old:]
        yield pd.DataFrame({"topic": [key[0]] * len(fresh), "url": fresh, "position": list(range(old, len(known)))})

    timed = rows.withWatermark(ts, "1 hour") if ts else rows
    return timed.groupBy(topic).applyInPandasWithState(merge, "topic string, url string, position long", "urls array<string>", "append", GroupStateTimeout.EventTimeTimeout if ts else GroupStateTimeout.NoTimeout)


def leases(rows: DataFrame, topic: str, kind: str, ts: str, seconds: str, late: str = "0 seconds", renew_hours: int = 1) -> DataFrame:
    """topic, status, expires: verified on subscribe, renew within ``renew_hours`` of expiry, gone on unsubscribe or denial."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            out.append((key[0], "renew", pd.Timestamp(state.get[0], unit="ms")))
            state.remove()
        else:
            for r in pd.concat(list(frames)).sort_values(ts).to_dict("records"):
                at = int(r[ts].timestamp() * 1000)
                if r[kind] == "subscribe":
                    end = at + int(r[seconds]) * 1000
                    state.update((end,))
                    state.setTimeoutTimestamp(max(end - renew_hours * HOUR, state.getCurrentWatermarkMs() + 1))
                    out.append((key[0], "verified", pd.Timestamp(end, unit="ms")))
                elif state.exists:
                    state.remove()
                    out.append((key[0], "removed", pd.NaT))
        yield pd.DataFrame(out, columns=["topic", "status", "expires"])

    return rows.withWatermark(ts, late).groupBy(topic).applyInPandasWithState(step, "topic string, status string, expires timestamp", "expires long", "append", GroupStateTimeout.EventTimeTimeout)


def write_with_dead_letters(rows: DataFrame, path: str, dead: str, checkpoint: str, ok) -> object:
    """Appends rows that satisfy ``ok`` to ``path`` and all others to ``dead``; a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        good = F.coalesce(ok, F.lit(False))
        batch.where(good).write.mode("overwrite").parquet(f"{path}/batch={number}")
        batch.where(~good).write.mode("overwrite").parquet(f"{dead}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain(rows: DataFrame, folder: str, mode: str = "append", then: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Runs a stream over what is there now and returns the table it wrote; ``complete`` keeps the last batch's result."""
    spark, out = rows.sparkSession, f"{folder}/out"
    if mode == "append":
        q = rows.writeStream.format("parquet").option("path", out).outputMode(mode)
    else:
        q = rows.writeStream.outputMode(mode).foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out))
    q.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    done = spark.read.parquet(out)
    return then(done) if then else done


def polls(rows: DataFrame, source: str, ts: str, ok: str, found: str, usual_seconds: int = 300) -> DataFrame:
    """source, at, outcome, interval of every poll (source, time, whether it went through, whether it found anything new), in order of time
    within a batch: the circuit breaker and the adaptive interval of each source, whose state is four numbers."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, out = connectors.Poll(*state.get) if state.exists else connectors.Poll(usual_seconds), []
        for r in pd.concat(list(frames)).sort_values([ts, ok, found]).to_dict("records"):
            now, outcome = connectors.step(now, int(r[ts].timestamp()), bool(r[ok]), bool(r[found]), usual_seconds)
            out.append((key[0], r[ts], outcome, now.interval))
        state.update(tuple(now))
        yield pd.DataFrame(out, columns=["source", "at", "outcome", "interval"])

    return rows.groupBy(source).applyInPandasWithState(run, f"source {rows.schema[source].dataType.simpleString()}, at timestamp, outcome string, interval long", "interval long, empty long, errors long, paused_until long", "append", GroupStateTimeout.NoTimeout)


def adaptive_threshold(rows: DataFrame, key: str, order: str, score: str, start: float = 0.82, window: int = 30, every: int = 10) -> DataFrame:
    """key, n, threshold after every ``every``-th score of a key: up by 0.01 where the mean of the last ``window`` scores lies more than
    0.15 above it, down where it lies less than 0.03 above, from half a window on, within 0.72 and 0.92."""

    def run(key_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        threshold, n, last = (state.get[0], state.get[1], list(state.get[2])) if state.exists else (start, 0, [])
        out = []
        for value in pd.concat(list(frames)).sort_values(order)[score]:
            last, n = [*last, float(value)][-window:], n + 1
            if n % every == 0:
                mean = sum(last) / len(last)
                if len(last) >= window // 2:
                    threshold = min(round(threshold + 0.01, 2), 0.92) if mean > threshold + 0.15 else max(round(threshold - 0.01, 2), 0.72) if mean < threshold + 0.03 else threshold
                out.append((key_[0], n, threshold))
        state.update((threshold, n, last))
        yield pd.DataFrame(out, columns=["key", "n", "threshold"])

    return rows.groupBy(key).applyInPandasWithState(run, f"key {rows.schema[key].dataType.simpleString()}, n long, threshold double", "threshold double, n long, last array<double>", "append", GroupStateTimeout.NoTimeout)


def session_memory(rows: DataFrame, session: str, entry: str, value: str, ts: str, ttl_hours: int = 24) -> DataFrame:
    """session, entry, value, expires of every stored entry; a session is forgotten once the watermark is past its last entry's time to live."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values(ts).drop_duplicates(entry, keep="last")
        latest = max(int(f[ts].max().timestamp() * 1000), state.get[0] if state.exists else 0)
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + ttl_hours * HOUR)
        yield pd.DataFrame({"session": key[0], "entry": f[entry], "value": f[value], "expires": f[ts] + pd.Timedelta(hours=ttl_hours)})

    kind = lambda c: rows.schema[c].dataType.simpleString()
    return rows.withWatermark(ts, "1 hour").groupBy(session).applyInPandasWithState(run, f"session {kind(session)}, entry {kind(entry)}, value {kind(value)}, expires timestamp", "latest long", "append", GroupStateTimeout.EventTimeTimeout)


def publish(rows: DataFrame, subject: str, path: str, checkpoint: str) -> object:
    """Appends a stream's rows as JSON messages, a folder for each subject."""
    message = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"), F.col(subject).cast("string").alias("subject"))
    return message.writeStream.format("text").partitionBy("subject").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(spark: SparkSession, path: str, subject: str, schema: str) -> DataFrame:
    """Messages of one subject as a stream: at least once, with a cursor in the reader's checkpoint."""
    text = spark.readStream.schema("value string, subject string").text(path)
    return text.where(F.col("subject") == subject).select(F.from_json("value", schema).alias("m")).select("m.*")


def append_batches(rows: DataFrame, path: str, checkpoint: str, files_of: int = 100_000) -> object:
    """Appends a stream to a table in batches: buffered rows are flushed with each; a batch that runs again overwrites its own folder."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("maxRecordsPerFile", files_of).parquet(f"{path}/batch={number}")

    return rows.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
