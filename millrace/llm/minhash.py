"""MinHash near-duplicate components with min-max signatures.

Each document's set holds its distinct word shingles.  Every permutation gives two signature values, the least and the
greatest image, so that 64 evaluations yield 128 values.  Both are unbiased for the Jaccard similarity.  The values are
banded; documents that share a band become candidates; candidates are compared on their full sets; confirmed links give
connected components.

Skew: documents with equal sets are one node from the start.  In a bucket all nodes are compared with the one that shares most buckets with others;
in buckets that still hold several components, the nodes outside the largest are then compared with all nodes of other
components, block by block inside tasks.  So no bucket is capped, none is held by one task and none emits its pairs, yet every
two nodes that share a bucket are in one component or have been compared.

Defined cases: null or blank texts have an empty set, link with nothing and are kept; a null doc_id is passed through with
a null component and kept; rows that repeat a doc_id are one document, which is linked with all that any of its texts
is linked with (``deduplicate`` keeps its least text, null first); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import WordHash, gram_hashes, materialize, mix64, require_columns, text_bytes

SHINGLE, PERMUTATIONS, ROWS, THRESHOLD = 5, 64, 4, 75

_SKETCH = "doc_id long, n_shingles long, node_key binary, bands array<long>"


def shingle_set(text: bytes | None, hashes: WordHash, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles; A-Z are lowered; fewer words than a shingle count as one sequence."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.array(words)
    return np.unique(gram_hashes(h, range(min(shingle, len(words)))))


def band_keys(shingles: np.ndarray, permutations: int = PERMUTATIONS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key for each band of ``rows`` values; half of a band's values are minima, half are maxima."""
    a = (mix64(np.arange(101, 101 + permutations, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    b = (mix64(np.arange(901, 901 + permutations, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(permutations, 0xFFFFFFFF, np.uint32), np.zeros(permutations, np.uint32)
    for s in range(0, len(x), 2048):
        v = a[:, None] * x[None, s : s + 2048]
        v += b[:, None]
        v ^= v >> np.uint32(15)
        low, high = np.minimum(low, v.min(axis=1)), np.maximum(high, v.max(axis=1))
    half = rows // 2
    low, high = low.reshape(-1, half), np.roll(high, -permutations // 4).reshape(-1, half)
    values = np.concatenate((low, high), axis=1).astype(np.uint64)
    keys = np.arange(1, len(values) + 1, dtype=np.uint64)
    for j in range(values.shape[1]):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, j])
    return keys


def _sketches(shingle: int, permutations: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash.shared()
        for batch in batches:
            ids, counts, keys, bands = batch.column(0), [], [], []
            for text in text_bytes(batch.column(1)):
                s = shingle_set(text, hashes, shingle)
                counts.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(band_keys(s, permutations, rows).view(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "node_key", "bands"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash.shared()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t, hashes, shingle).tobytes() for t in text_bytes(batch.column(1))], pa.binary())], ["node", "items"])

    return run


def _confirm(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("items_a").to_pylist(), batch.column("items_b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both > 0 and 100 * both >= threshold * (len(x) + len(y) - both))
            out = batch.select(["a", "b"])
            yield out.filter(pa.array(keep))

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) for all ends of ``links`` (a, b): least node reachable, by min-label rounds with pointer jumping."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = materialize(both, "edges")
    labels = materialize(edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        step = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("component").alias("far"))
        step = materialize(step.join(jump, "mid", "left").select("node", "was", F.least("mid", "far").alias("component")), "labels")
        labels = step.select("node", "component")
        if step.where("component <> was").limit(1).count() == 0:
            return labels


def _compare(threshold: int):
    def run(table):
        rows = table.to_pydict()
        items = [np.frombuffer(x, np.uint64) for x in rows["items"]]
        sizes = np.array([len(x) for x in items], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        everything, node, c, minor = np.concatenate(items), np.array(rows["node"]), np.array(rows["c"]), np.array(rows["minor"])
        found = []
        for k in np.flatnonzero(minor):
            fits = ~minor & (c != c[k]) & (100 * np.minimum(sizes, sizes[k]) >= threshold * np.maximum(sizes, sizes[k]))
            if not fits.any():
                continue
            at = np.searchsorted(items[k], everything)
            both = np.add.reduceat(items[k][np.minimum(at, sizes[k] - 1)] == everything, starts)
            linked = fits & (100 * both >= threshold * (sizes + sizes[k] - both))
            found += [(min(node[k], n), max(node[k], n)) for n in node[linked]]
        return pa.table([pa.array([f[i] for f in found], pa.int64()) for i in range(2)], names=["a", "b"])

    return run


def _across(placed: DataFrame, threshold: int, members: int = 400_000, minors: int = 100_000) -> DataFrame:
    """Links between nodes of different components in one bucket; ``placed`` has bucket, node, c (component) and items.

    Nodes outside the bucket's largest component (minors) are compared with all its nodes, in blocks of so many shingles each;
    no pair becomes a row, and no task holds more than a block of either side.
    """
    placed = placed.withColumn("size", F.octet_length("items") / 8)
    parts = placed.groupBy("bucket", "c").agg(F.sum("size").alias("size"))
    whole = parts.groupBy("bucket").agg(F.max(F.struct("size", "c")).alias("major"), F.sum("size").alias("all"))
    whole = whole.select("bucket", F.col("major.c").alias("major"), F.ceil(F.col("all") / members).cast("int").alias("n_members"), F.ceil(F.greatest(F.col("all") - F.col("major.size"), F.lit(1)) / minors).cast("int").alias("n_minors"))
    rows = placed.select("bucket", "node", "c", "items").join(whole, "bucket")
    blocks = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    minor = rows.where("c <> major").select("bucket", own(F.col("n_minors")).alias("x"), F.explode(blocks(F.col("n_members"))).alias("y"), "node", "c", "items", F.lit(True).alias("minor"))
    every = rows.select("bucket", F.explode(blocks(F.col("n_minors"))).alias("x"), own(F.col("n_members")).alias("y"), "node", "c", "items", F.lit(False).alias("minor"))
    return minor.unionByName(every).groupBy("bucket", "x", "y").applyInArrow(_compare(threshold), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, permutations: int = PERMUTATIONS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of ``docs`` (doc_id, text)."""
    docs = require_columns(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    sketch = materialize(docs.mapInArrow(_sketches(shingle, permutations, rows), _SKETCH), "sketch")
    real = sketch.where("node_key is not null and doc_id is not null")
    nodes = materialize(real.groupBy("node_key").agg(F.min("doc_id").alias("node"), F.min_by("bands", "doc_id").alias("bands")), "nodes")
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("bucket", "n")
    members = materialize(members.join(shared, "bucket"), "buckets")
    # the node that meets most others is compared with all of its bucket: the text that copies were made from, where there is one
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    ranked = members.select("bucket", "node").join(degree, "node")
    pivots = ranked.groupBy("bucket").agg(F.max(F.struct("degree", (-F.col("node")).alias("first"))).alias("p")).select("bucket", (-F.col("p.first")).alias("pivot"))
    stars = members.select("bucket", "node").join(pivots, "bucket").where("node <> pivot")

    pairs = materialize(stars.select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct(), "pairs")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    # rows that repeat an id and a text count once: their sets would meet as often as the product of their numbers
    copied = materialize(real.groupBy("doc_id", "node_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id").distinct(), "copied")
    once = docs.join(copied, "doc_id", "left_anti").unionByName(docs.join(copied, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    sets = materialize(once.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle), "node long, items binary"), "sets")

    def confirmed(found: DataFrame) -> DataFrame:
        a, b = sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), sets.select(F.col("node").alias("b"), F.col("items").alias("items_b"))
        return found.join(b, "b").join(a, "a").select("a", "b", "items_a", "items_b").mapInArrow(_confirm(threshold), "a long, b long")

    # rows that repeat a doc_id with other texts are one document: their nodes are linked
    repeated = real.groupBy("doc_id").agg(F.min("node_key").alias("lo"), F.max("node_key").alias("hi")).where("lo < hi").select("doc_id")
    named = real.join(materialize(repeated, "repeated"), "doc_id", "left_semi").join(nodes.select("node_key", "node"), "node_key")
    same = named.select("node", "doc_id").join(named.groupBy("doc_id").agg(F.min("node").alias("a")), "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    links = materialize(confirmed(pairs).unionByName(same).distinct(), "links")
    part = components(links)

    placed = members.select("bucket", "node").join(part, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("bucket")
    placed = placed.join(mixed, "bucket", "left_semi").join(sets, "node")
    more = materialize(_across(placed, threshold), "links")
    final = components(links.union(more)) if more.limit(1).count() else part

    named = nodes.select("node_key", "node").join(final, "node", "left").select("node_key", F.coalesce("component", "node").alias("of_node"))
    out = sketch.select("doc_id", "n_shingles", "node_key").join(named, "node_key", "left")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("of_node", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """One row of ``docs`` for each component, with all columns; rows with a null doc_id stay.

    Where rows repeat a doc_id, they stand for one document, the row with the least text.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))  # no name of theirs meets those used here
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select("doc_id").distinct()
    text = F.struct("row.text", F.xxhash64("row"))
    ided = rows.where("row.doc_id is not null").join(kept, F.col("row.doc_id") == F.col("doc_id"), "left_semi").groupBy("row.doc_id").agg(F.min_by("row", text).alias("row"))
    return ided.select("row").unionByName(rows.where("row.doc_id is null")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
