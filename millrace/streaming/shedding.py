"""Load shedding: the tick between triggers and what a trigger admits follow from how long batches take."""

from __future__ import annotations

import math

from pyarrow import fs
from pyspark.sql.streaming.listener import StreamingQueryListener

# The shortest and the longest tick, and by how much it falls and rises (seconds).
BASE_TICK, MAX_TICK, FASTER, SLOWER = 5.0, 30.0, 0.5, 1.0


def next_tick(tick: float, elapsed: float, base: float = BASE_TICK, most: float = MAX_TICK) -> float:
    """A batch within its tick shortens the next one; one that takes as long or longer lengthens it."""
    return max(base, tick - FASTER) if elapsed < tick else min(most, tick + SLOWER)


def admitted(full: int, tick: float, base: float = BASE_TICK) -> int:
    """Pages (or files) that a trigger admits: the full number at the base tick, less in proportion as ticks grow, one at least."""
    return max(1, math.floor(full * base / tick))


class SharedNumber:
    """A number in a shared file that the driver writes and a source's planner reads: what a trigger admits, or a clock."""

    def __init__(self, path: str, default: int):
        self.path, self.default = path, default

    def __call__(self) -> int:
        store, path = fs.FileSystem.from_uri(self.path)
        if store.get_file_info(path).type != fs.FileType.File:
            return self.default
        with store.open_input_stream(path) as f:
            return int(f.read() or self.default)

    def put(self, number: int) -> None:
        store, path = fs.FileSystem.from_uri(self.path)
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as f:
            f.write(str(number).encode())


class LoadShedding(StreamingQueryListener):
    """Feeds the limit of the next trigger from each batch's duration; ``drifts`` counts batches that took longer than their tick."""

    def __init__(self, limit: SharedNumber, base: float = BASE_TICK, most: float = MAX_TICK):
        self.limit, self.base, self.most, self.tick, self.drifts, self.seen = limit, base, most, base, 0, []

    def took(self, elapsed: float) -> None:
        self.drifts += elapsed >= self.tick
        self.tick = next_tick(self.tick, elapsed, self.base, self.most)
        self.seen.append((elapsed, self.tick))
        self.limit.put(admitted(self.limit.default, self.tick, self.base))

    def onQueryStarted(self, event) -> None:  # noqa: N802  Spark's names
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.took(event.progress.batchDuration / 1000)

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass
