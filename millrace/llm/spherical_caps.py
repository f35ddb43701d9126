"""Near-duplicate embeddings by spherical-cap filters with structured random product codes.

A filter is a direction; a vector belongs to the filters whose directions it exceeds most.  Directions are product codes:
after a random rotation the space is cut into blocks, each block has its own random unit directions, and a filter is one
direction of each block.  So ``codes ** blocks`` filters cost ``codes * blocks`` products, and the filters that a vector
exceeds are listed block by block, never enumerated.  A vector's own threshold is the score of its ``best``-th filter, in
each of ``rotations`` independent codes: with one threshold for all, 1 to 20 % of the vectors exceed no filter at all.
Codes grow with the number of vectors, so filters hold few unlike vectors at any size.

Vectors that share a filter, and their label and length, are compared in double precision.  A pair counts in the first filter
that both share.  Links are counted in the task, only a spanning forest of each block leaves it, and filters with many vectors
are dealt out as pairs of blocks: no filter is capped, none is held by one task, none emits its pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components, rows without a label and rows without
a vec_id link with nothing (n_links 0, component_id their own vec_id, kept); equal vectors of one label are one node, linked
with each other; rows that repeat a vec_id count as vectors of their own; vectors of other lengths are never compared; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import discard, list_rows, materialize, mix64, require_columns, whole_groups, worker_memory
from millrace.llm.minhash import components

THRESHOLD, ROTATIONS, BEST, BLOCK = 0.98, 4, 8, 1000
_SMALL = 32


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of double components over their norms; a power of two first keeps squares finite."""
    x = x.astype(np.float64)
    _, e = np.frexp(np.abs(x).max(axis=1))
    x = np.ldexp(x, -e[:, None])
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


class ProductCode:
    """``codes ** blocks`` directions in ``dim`` dimensions after one random rotation."""

    def __init__(self, dim: int, filters: int, rotation: int):
        self.blocks = max(1, min(dim // 8, next(m for m in range(1, 64) if filters <= 512**m)))
        self.codes = min(4096, int(np.ceil(filters ** (1 / self.blocks))))
        rng = np.random.default_rng([dim, self.codes, rotation])
        turn, _ = np.linalg.qr(rng.standard_normal((dim, dim)))
        cuts = np.linspace(0, dim, self.blocks + 1).astype(int)
        self.parts = []
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            c = rng.standard_normal((self.codes, hi - lo))
            c /= np.sqrt((c * c).sum(axis=1))[:, None]
            self.parts.append((c @ turn[lo:hi]).astype(np.float32))

    def exceeded(self, x: np.ndarray, best: int) -> np.ndarray:
        """For each row of ``x`` the numbers of the ``best`` filters with the greatest scores (a score is a sum over blocks)."""
        number, score = np.zeros((len(x), 1), np.uint64), np.zeros((len(x), 1), np.float32)
        for part in self.parts:
            at, v = _most(x @ part.T, best)
            score = (score[:, :, None] + v[:, None, :]).reshape(len(x), -1)
            number = (number[:, :, None] * np.uint64(self.codes) + at[:, None, :].astype(np.uint64)).reshape(len(x), -1)
            at, score = _most(score, best)
            number = np.take_along_axis(number, at, 1)
        return number


def _most(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, scores.shape[1])
    at = np.argpartition(scores, scores.shape[1] - k, axis=1)[:, -k:]
    return at, np.take_along_axis(scores, at, 1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A 128-bit key of label and components for vectors that may be linked, else null."""
    for batch in batches:
        label, keys = batch.column("label").cast(pa.string()).to_pylist(), [None] * batch.num_rows
        named = batch.column("vec_id").is_valid().to_pylist()
        for i, x in enumerate(list_rows(batch.column("embedding"))):
            if label[i] is not None and named[i] and x is not None and len(x) and np.isfinite(x).all() and x.any():
                keys[i] = xxhash.xxh3_128_digest((x + 0.0).tobytes() + label[i].encode())
        yield batch.append_column("node_key", pa.array(keys, pa.binary()))


def _filters(filters: int, rotations: int, best: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, out = list(list_rows(batch.column("embedding"))), [None] * batch.num_rows
            label = np.array([xxhash.xxh3_64_intdigest(v) for v in batch.column("label").cast(pa.string()).to_pylist()], np.uint64)
            sizes = np.array([len(x) for x in rows], np.int64)
            for dim in np.unique(sizes):
                make = lambda d=int(dim): [ProductCode(d, filters, r) for r in range(rotations)]
                codes, at = worker_memory(("caps", int(dim), filters, rotations), make), np.flatnonzero(sizes == dim)
                for part in np.array_split(at, len(at) // 1024 + 1):
                    x = unit(np.stack([rows[i] for i in part])).astype(np.float32)
                    found = [c.exceeded(x, best) + mix64(np.array([dim * 64 + r], np.uint64)) for r, c in enumerate(codes)]
                    found = mix64(mix64(np.concatenate(found, axis=1)) ^ label[part][:, None])
                    for i, own in zip(part, found, strict=True):
                        out[i] = np.unique(own).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(out, pa.list_(pa.int64()))], ["node", "filters"])

    return run


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Edges (root, member) that join what the symmetric matrix joins."""
    edges, left = [], linked.any(axis=1)
    while left.any():
        root = int(np.argmax(left))
        left[root] = False
        new = linked[root] & left
        while new.any():
            at = np.flatnonzero(new)
            edges += [(root, int(k)) for k in at]
            left[at] = False
            new = linked[at].any(axis=0) & left
    return edges


def _earlier(lists: list[np.ndarray], here: int) -> np.ndarray:
    """Whether two rows share a filter below ``here``."""
    below = [f[: np.searchsorted(f, here)] for f in lists]
    values, where = np.unique(np.concatenate(below), return_inverse=True)
    row = np.repeat(np.arange(len(lists)), [len(b) for b in below])
    common = np.bincount(where, minlength=len(values)) > 1
    column, keep = np.cumsum(common) - 1, common[where]
    has = np.zeros((len(lists), int(common.sum())), np.float32)
    has[row[keep], column[where[keep]]] = 1
    return has @ has.T > 0


def _first_common(a: np.ndarray, b: np.ndarray) -> int:
    return int(np.intersect1d(a, b, assume_unique=True)[0])


def _links(threshold: float):
    """Rows (a, b, n): n links of node a where b is null, else an edge of a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_groups(batches, ["filter", "x", "y"]):
            keys = [rows.column(c).to_numpy() for c in ("filter", "x", "y", "own")]
            node, copies = rows.column("node").to_numpy(), rows.column("copies").to_numpy()
            vectors, lists = list(list_rows(rows.column("embedding"))), list(list_rows(rows.column("filters")))
            change = np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1
            a, b, n = [], [], []
            for lo, hi in zip([0, *change], [*change, len(node)], strict=True):
                if hi - lo < 2:
                    continue
                here, own, x = keys[0][lo], keys[3][lo:hi], unit(np.stack(vectors[lo:hi]))
                linked = x @ x.T >= threshold
                np.fill_diagonal(linked, False)
                if keys[1][lo] != keys[2][lo]:  # two blocks: only pairs across
                    linked &= own[:, None] != own[None, :]
                if not linked.any():
                    continue
                if hi - lo > _SMALL:
                    linked &= ~_earlier(lists[lo:hi], here)
                else:
                    for i, j in zip(*np.nonzero(np.triu(linked)), strict=True):
                        if _first_common(lists[lo + i], lists[lo + j]) != here:
                            linked[i, j] = linked[j, i] = False
                counts = linked @ copies[lo:hi]
                for i in np.flatnonzero(counts):
                    a.append(node[lo + i]), b.append(None), n.append(counts[i])
                for i, j in _spanning(linked):
                    a.append(node[lo + i]), b.append(node[lo + j]), n.append(0)
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (a, b, n)], ["a", "b", "n"])

    return run


def near_vectors(
    vectors: DataFrame, threshold: float = THRESHOLD, rotations: int = ROTATIONS, best: int = BEST, block: int = BLOCK
) -> DataFrame:
    """vec_id, n_links, component_id and kept for each row of ``vectors`` (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    vectors = require_columns(vectors, "vec_id", "embedding", "label").withColumn("vec_id", F.col("vec_id").cast("long"))
    kind = vectors.schema["embedding"].dataType.simpleString()
    label = vectors.schema["label"].dataType.simpleString()
    keyed = vectors.mapInArrow(_keys, f"vec_id long, embedding {kind}, label {label}, node_key binary")
    real = keyed.where("node_key is not null").groupBy("node_key")
    nodes = real.agg(F.min("vec_id").alias("first_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("label").alias("label"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    filters = 1 << (16 * nodes.count() + 1024).bit_length()
    listed = materialize(nodes.mapInArrow(_filters(filters, rotations, best), "node long, filters array<long>"), "filters")
    members = listed.select("node", F.explode("filters").alias("filter"))
    shared = members.groupBy("filter").agg(F.count("*").alias("n")).where("n > 1")
    members = materialize(members.join(shared, "filter"), "members")
    own = members.groupBy("node").agg(F.sort_array(F.collect_list("filter")).alias("filters"))
    held = nodes.select("node", "copies", "embedding").join(own, "node")
    blocks = F.ceil(F.col("n") / block).cast("int")
    placed = members.withColumn("own", F.pmod(F.xxhash64("node"), blocks).cast("int"))
    placed = placed.select("filter", "node", "own", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    placed = placed.select("filter", "node", "own", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    placed = placed.join(held, "node").repartition("filter", "x", "y").sortWithinPartitions("filter", "x", "y")
    found = materialize(placed.mapInArrow(_links(threshold), "a long, b long, n long"), "links")

    near = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("near"))
    part = components(found.where("b is not null").select("a", "b"))
    first = part.join(nodes.select("node", "first_id"), "node").groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = nodes.select("node_key", "node", "copies", "first_id").join(near, "node", "left").join(part.join(first, "component"), "node", "left")
    links = (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("links")
    named = named.select("node_key", links, F.coalesce("component_id", "first_id").alias("of_node"))
    component = F.coalesce("of_node", "vec_id")
    out = keyed.select("vec_id", "node_key").join(named, "node_key", "left")
    out = out.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), component.alias("component_id"))
    discard(listed, members)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
