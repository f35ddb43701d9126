"""The connectors as a Python data source: one partition a source, high-water marks as offsets, one tick a trigger.

An ``archive`` answers requests: ``latest(source, after, most)`` is the mark of the newest page (at most ``most`` pages on),
``marks(source, after, upto)`` lists pages in order, ``pages(source, after, upto)`` yields (mark, payload).  ``FolderArchive`` reads
answers that Spark has written; a test or a product injects its own.

A trigger is a tick: sources that are due are asked; one that fails five times in a row is paused, one that finds nothing three
times is asked half as often, one that finds something has its usual interval again.  An offset holds, for each source, its mark and
this state.  A batch reads the pages between two offsets, so a run that starts again reads what its log says, without loss or repeat;
what was planned last is kept in ``control`` for the tick after a restart.  A source with many new pages is cut into several partitions.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from millrace.functions import urls
from millrace.sources import connectors

SCHEMA = "source string, layer string, mark string, position int, url string, title string, published_at string, tier string, verified boolean, snippet string"


class Archive(Protocol):
    def latest(self, source: str, after: str, most: int) -> str: ...

    def marks(self, source: str, after: str, upto: str) -> list[str]: ...

    def pages(self, source: str, after: str, upto: str) -> Iterator[tuple[str, str]]: ...


class FolderArchive:
    """Answers (mark, payload) in Parquet files under ``path``/source=…, as Spark's writer leaves them."""

    def __init__(self, path: str):
        self.path = path

    def _rows(self, source: str, after: str, upto: str | None, columns: list[str]) -> Iterator[pa.RecordBatch]:
        store, folder = fs.FileSystem.from_uri(f"{self.path}/source={source}")
        if store.get_file_info(folder).type == fs.FileType.NotFound:
            return iter(())
        wanted = pc.field("mark") > after if upto is None else (pc.field("mark") > after) & (pc.field("mark") <= upto)
        return ds.dataset(folder, filesystem=store, format="parquet").to_batches(columns=columns, filter=wanted)

    def marks(self, source: str, after: str, upto: str | None) -> list[str]:
        return sorted({m for b in self._rows(source, after, upto, ["mark"]) for m in b.column("mark").to_pylist()})

    def latest(self, source: str, after: str, most: int) -> str:
        found = self.marks(source, after, None)[:most]
        return found[-1] if found else after

    def pages(self, source: str, after: str, upto: str) -> Iterator[tuple[str, str]]:
        for batch in self._rows(source, after, upto, ["mark", "payload"]):
            yield from zip(batch.column("mark").to_pylist(), batch.column("payload").to_pylist(), strict=True)


class Pages(InputPartition):
    def __init__(self, source: str, after: str, upto: str):
        self.source, self.after, self.upto = source, after, upto


def _items(archive: Archive, part: Pages) -> Iterator[tuple]:
    layer = connectors.SPECS[part.source].layer
    for mark, payload in archive.pages(part.source, part.after, part.upto):
        for k, (url, title, at, tier, verified, snippet) in enumerate(connectors.parse(part.source, payload)):
            yield part.source, layer, mark, k, url, title, at, tier, verified, snippet


def _cut(archive: Archive, source: str, after: str, upto: str, per_partition: int) -> list[Pages]:
    marks = archive.marks(source, after, upto)
    ends = marks[per_partition - 1 :: per_partition]
    ends = ends if ends and ends[-1] == marks[-1] else [*ends, *marks[-1:]]
    return [Pages(source, lo, hi) for lo, hi in zip([after, *ends[:-1]], ends, strict=True)] if marks else []


class _Batch(DataSourceReader):
    def __init__(self, archive: Archive, sources: list[str], since: str, per_partition: int):
        self.archive, self.sources, self.since, self.per_partition = archive, sources, since, per_partition

    def partitions(self) -> list[Pages]:
        ends = {s: self.archive.latest(s, self.since, 1 << 62) for s in self.sources}
        return [p for s, end in ends.items() for p in _cut(self.archive, s, self.since, end, self.per_partition)] or [Pages(self.sources[0], "", "")]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _items(self.archive, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, archive: Archive, sources: list[str], clock: Callable[[], float], admit: Callable[[], int], per_partition: int, control: str | None):
        self.archive, self.sources, self.clock, self.admit = archive, sources, clock, admit
        self.per_partition, self.control, self.planned = per_partition, control, None

    def initialOffset(self) -> dict:  # noqa: N802  Spark's names
        return {s: {"mark": "", "next": 0, "poll": list(connectors.Poll(connectors.SPECS[s].poll))} for s in self.sources}

    def _last(self) -> dict:
        if self.planned is None and self.control:
            store, path = fs.FileSystem.from_uri(f"{self.control}/planned.json")
            if store.get_file_info(path).type == fs.FileType.File:
                with store.open_input_stream(path) as f:
                    self.planned = json.loads(f.read())
        return {**self.initialOffset(), **(self.planned or {})}

    def latestOffset(self) -> dict:  # noqa: N802
        now, out, most = int(self.clock()), {}, self.admit()
        for source, old in self._last().items():
            out[source] = old
            if old["next"] > now:
                continue
            try:
                mark, ok = self.archive.latest(source, old["mark"], most), True
            except Exception:  # noqa: BLE001  whatever an injected archive raises counts as a failed poll
                mark, ok = old["mark"], False
            poll, outcome = connectors.step(connectors.Poll(*old["poll"]), now, ok, mark > old["mark"], connectors.SPECS[source].poll)
            if outcome != "skipped":
                out[source] = {"mark": mark, "next": now + poll.interval, "poll": list(poll)}
        self.planned = out
        return out

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        if self.planned is None:
            self.planned = end
        if self.control:
            store, path = fs.FileSystem.from_uri(f"{self.control}/planned.json")
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(path) as f:
                f.write(json.dumps(end).encode())
        moved = [(s, start.get(s, {"mark": ""})["mark"], new["mark"]) for s, new in end.items()]
        return [p for s, lo, hi in moved if hi > lo for p in _cut(self.archive, s, lo, hi, self.per_partition)]

    def read(self, partition: Pages) -> Iterator[tuple]:
        return _items(self.archive, partition)


def connector_format(
    name: str,
    archive: Archive,
    sources: list[str] | None = None,
    clock: Callable[[], float] = time.time,
    admit: Callable[[], int] = lambda: 1 << 62,
    per_partition: int = 100,
    control: str | None = None,
) -> type[DataSource]:
    """A format to register under ``name``: pages of ``archive``; a tick admits at most ``admit()`` new pages of a source."""
    names = sources or list(connectors.SPECS)

    class Connectors(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return _Batch(archive, names, self.options.get("since", ""), per_partition)

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return _Stream(archive, names, clock, admit, per_partition, control)

    return Connectors


def _tiered(rows: DataFrame) -> DataFrame:
    """Where a source leaves the tier open, it follows from the URL."""
    return rows.withColumn("tier", F.when(F.col("tier") == "", urls.tier(F.col("url"))).otherwise(F.col("tier")))


def items(spark: SparkSession, kind: type[DataSource], since: str = "") -> DataFrame:
    """All items of the pages after ``since``."""
    spark.dataSource.register(kind)
    return _tiered(spark.read.format(kind.name()).option("since", since).load())


def item_stream(spark: SparkSession, kind: type[DataSource]) -> DataFrame:
    """Items as a stream."""
    spark.dataSource.register(kind)
    return _tiered(spark.readStream.format(kind.name()).load())
