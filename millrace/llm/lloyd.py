"""Plain Lloyd clustering of integer vectors with exact sums.

Components become ``floor(256 * x)``.  In each round the centroids are broadcast; ``mapInPandas`` computes squared differences
centroid by centroid in NumPy, takes the least (ties: the smaller number) and adds up its partition's vectors per centroid;
one groupBy merges these sums.  Sums leave a task as limbs of 40 bits, so they are exact at any size; what the driver holds is
the centroids alone, ``k`` times ``dim`` integers.

Defined cases: vectors that are null, of another length than ``dim``, or hold a null or non-finite component have no row in the
result; rows without a vec_id are assigned and counted, and start a centroid only where fewer than ``k`` rows have one; rows
that repeat a vec_id are vectors of their own (equal hashes are ordered by their vectors); fewer than ``k`` vectors give as many
centroids; no vectors give no rows; a distance or sum beyond 64 bits is null (components beyond 2**27 are computed with
unbounded integers, so assignments stay exact); other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize, require_columns

CLUSTERS, DIM, ROUNDS, SCALE, SEED = 40, 64, 5, 256, 2
_LIMB, _SAFE = 40, 1 << 27


def integers(components: np.ndarray) -> np.ndarray:
    """floor(256 * x) exactly, as int64 where all are small, else as Python integers."""
    x = np.floor(components * SCALE)
    if not x.size or np.abs(x).max() < _SAFE:
        return x.astype(np.int64)
    out = np.empty(x.shape, object)
    out.flat = [_floored(v) for v in components.ravel().tolist()]
    return out


def _floored(x: float) -> int:
    """floor(256 * x) of any finite double, where 256 * x may be beyond them."""
    numerator, denominator = x.as_integer_ratio()
    return SCALE * numerator // denominator


def nearest(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid and the squared distance to it, for each row of integers."""
    big = x.dtype == object or any(abs(v) >= _SAFE for c in centroids for v in c)
    x, best, at = x.astype(object) if big else x, None, np.zeros(len(x), np.int64)
    for k, c in enumerate(centroids):
        d = x - np.array(c, object if big else np.int64)
        d = (d * d).sum(axis=1)
        if best is None:
            best = d
        else:
            closer = d < best
            best, at = np.where(closer, d, best), np.where(closer, k, at)
    return at, best


def _assigned(centroids):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                at, d = nearest(integers(np.stack(f["embedding"].to_numpy()).astype(np.float64)), centroids.value)
                fits = [int(v) if v < 1 << 63 else None for v in d]
                yield pd.DataFrame({"vec_id": f["vec_id"].astype("Int64"), "cluster": at, "distance": pd.array(fits, "Int64")})

    return run


def _sums(centroids):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, list] = {}
        for f in frames:
            if not len(f):
                continue
            x = integers(np.stack(f["embedding"].to_numpy()).astype(np.float64))
            at, _ = nearest(x, centroids.value)
            for k in np.unique(at):
                mine = x[at == k]
                n, s = total.get(int(k), (0, 0))
                total[int(k)] = n + len(mine), s + mine.sum(axis=0).astype(object)
        rows = []
        for k, (n, s) in total.items():
            limb, last = 0, False
            while not last:
                last = all(abs(v) < 1 << _LIMB for v in s)  # the top limb keeps the sign
                rows.append((k, limb, 0 if limb else n, [int(v) if last else int(v & ((1 << _LIMB) - 1)) for v in s]))
                s, limb = s >> _LIMB, limb + 1
        yield pd.DataFrame(rows, columns=["cluster", "limb", "n", "sums"])

    return run


def lloyd(vectors: DataFrame, k: int = CLUSTERS, dim: int = DIM, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of the vectors kept from (vec_id, embedding)."""
    spark, rows = vectors.sparkSession, require_columns(vectors, "vec_id", "embedding")
    usable = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where((F.size("embedding") == dim) & usable).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    kept = materialize(kept, "vectors")
    start = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.orderBy(start.asc_nulls_last(), "embedding").limit(k).collect()
    centroids = [integers(np.array([r.embedding])).tolist()[0] for r in first]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centroids)
        parts = kept.mapInPandas(_sums(shared), "cluster int, limb int, n long, sums array<long>")
        each = [F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(dim)]
        merged = parts.groupBy("cluster", "limb").agg(F.sum("n").alias("n"), *each).collect()
        counts = {r.cluster: r.n for r in merged if r.limb == 0}
        for c, n in counts.items():
            total = [sum(r[f"s{i}"] << _LIMB * r.limb for r in merged if r.cluster == c) for i in range(dim)]
            centroids[c] = [v // n for v in total]
        shared.unpersist()
    digests = [(c, hashlib.sha256(",".join(map(str, v)).encode()).hexdigest()) for c, v in enumerate(centroids)]
    out = kept.mapInPandas(_assigned(spark.sparkContext.broadcast(centroids)), "vec_id long, cluster int, distance long")
    out = materialize(out, "assigned")
    whole = lambda name: F.when(F.count("distance") == F.count("*"), F.sum(F.col("distance").cast("decimal(38,0)")).try_cast("long")).alias(name)
    per = out.groupBy("cluster").agg(whole("cluster_inertia")).crossJoin(F.broadcast(out.agg(whole("inertia"))))
    per = per.join(spark.createDataFrame(digests, "cluster int, centroid_sha256 string"), "cluster")
    return out.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
