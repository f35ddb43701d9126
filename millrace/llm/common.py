"""Shared plumbing: intermediate tables in the cluster's shared folder, Arrow row iteration and word hashing."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir; in local mode a temporary one where it is unset."""
    try:
        path = spark.conf.get("spark.checkpoint.dir")
    except Exception:  # an unset key raises in the session's configuration
        path = None
    if not path:
        path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for name, spark in _tables.items():
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: S110  the session is already gone
            pass
    for path, spark in _written.items():
        try:
            _delete(spark, path)
        except Exception:  # noqa: S110  the session is already gone; the cluster's own retention applies
            pass


def materialize(df: DataFrame, name: str, key: str | Sequence[str] | None = None, **options) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: the lineage ends there and survives lost executors.

    With ``key`` (by which ``df`` is partitioned already) the files are buckets of it: joins on it move the other side only.
    """
    spark = df.sparkSession
    tag = f"millrace-{name}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{tag}"
    _written[path] = spark
    options = {"compression": "zstd", **options}
    if key:
        saved, keys = tag.replace("-", "_"), [key] if isinstance(key, str) else key
        df.write.options(**options).option("path", path).format("parquet").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).saveAsTable(saved)
        _tables[saved] = spark
    else:
        df.write.options(**options).parquet(path)
    del df
    release(spark)
    out = spark.table(saved) if key else spark.read.parquet(path)
    out._millrace_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of materialized frames that nothing will read any more."""
    for frame in frames:
        path = frame._millrace_path
        spark = _written.pop(path, None)
        if spark:
            _delete(spark, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more; it does so when its objects are collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def text_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def worker_memory(key, make: Callable, most: int = 2):
    """One object for each key and Python worker, kept between tasks: what a task has learned serves the next one.

    Only the last ``most`` objects stay, so a worker that goes from stage to stage does not gather their memories.
    """
    memory = sys.modules.setdefault("_millrace_worker_memory", types.ModuleType("_millrace_worker_memory")).__dict__.setdefault("kept", {})
    found = memory.pop(key) if key in memory else make()
    memory[key] = found
    for old in list(memory)[:-most]:
        del memory[old]
    return found


class WordHash(dict):
    """64-bit hashes of words, remembered up to ``limit`` words; use ``map(h.__getitem__, words)``."""

    def __init__(self, seed: int = 0, limit: int = 150_000):
        super().__init__()
        self.seed, self.limit = seed, limit

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, self.seed)
        if len(self) < self.limit:
            self[word] = h
        return h

    @staticmethod
    def shared() -> WordHash:
        return worker_memory("words", WordHash)

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Odd multipliers, one for each place in a shingle.
_PLACES = mix64(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def gram_hashes(words: np.ndarray, places: Iterable[int]) -> np.ndarray:
    """Hash, at every start, of the words at these offsets from it (order matters)."""
    places = list(places)
    n = len(words) - places[-1]
    if n <= 0:
        return np.empty(0, np.uint64)
    acc = np.zeros(n, np.uint64)
    for p in places:
        acc += mix64(words[p : p + n] + _PLACES[p % 64]) * _PLACES[(p + 7) % 64]
    return mix64(acc)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns, so that extra ones and names that clash with an operator's own never matter."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def list_rows(column: pa.Array) -> Iterator[np.ndarray | None]:
    """Each list of an Arrow list column as a NumPy view of its values, None for null lists; null elements of floats are NaN."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, valid = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    values = column.values.to_numpy(zero_copy_only=False)
    for k, there in enumerate(valid):
        yield values[offsets[k] : offsets[k + 1]] if there else None


def whole_groups(batches: Iterable[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Tables that hold whole groups of rows with equal ``keys``, from batches sorted by them; the last group waits for more rows."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if rest is None else [*rest.to_batches(), batch])
        last = [rows.column(k)[rows.num_rows - 1] for k in keys]
        same = np.ones(rows.num_rows, bool)
        for k, value in zip(keys, last, strict=True):
            same &= pc.equal(rows.column(k), value).to_numpy(zero_copy_only=False).astype(bool)
        start = rows.num_rows - int(same.sum())
        if start:
            yield rows.slice(0, start)
        rest = rows.slice(start)
    if rest is not None:
        yield rest
