"""Exact and near-duplicate operators of the small kind: fingerprints of titles and questions, and greedy resolution."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import let
from millrace.operators import similarity
from millrace.session import written


#: Features that are hashed and counted at once.
PIECE = 50_000


def features(text: Column) -> Column:
    """Words and word pairs, with repeats."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    pairs = lambda w: F.transform(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), lambda x, i: F.concat(x, F.lit(" "), F.get(w, i + 1)))
    return let(w, lambda w: F.concat(w, pairs(w)))


def pieces(lists: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of runs of lists that hold ``most`` elements together, or are a single list."""
    ends, lo = lists.offsets.to_numpy()[1:], 0
    while lo < len(lists):
        hi = max(int(np.searchsorted(ends, lists.offsets[lo].as_py() + most, side="right")), lo + 1)
        yield lo, hi
        lo = hi


def _simhashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo, hi in pieces(batch.column(1), PIECE):
            part = batch.slice(lo, hi - lo)
            said, ends = part.column(1).flatten().to_pylist(), np.cumsum([0, *pc.list_value_length(part.column(1)).to_pylist()])
            heads = {f: hashlib.md5(f.encode(), usedforsecurity=False).digest()[:8] for f in set(said)}
            bits = np.unpackbits(np.frombuffer(b"".join(map(heads.__getitem__, said)), np.uint8).reshape(-1, 8), axis=1)
            votes = np.concatenate((np.zeros((1, 64), np.int64), np.cumsum(bits, axis=0, dtype=np.int64)))
            most = 2 * (votes[ends[1:]] - votes[ends[:-1]]) > np.diff(ends)[:, None]
            raw = (most + np.uint8(48)).astype(np.uint8).tobytes().decode()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([raw[k : k + 64] for k in range(0, len(raw), 64)], pa.string())], ["key", "simhash"])


def simhash(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and a string of 64 bits: bit i is set if more features than not have it in the first 8 bytes of their md5.

    Rows of one key count together.  They meet in one shuffle, before anything is gathered; no task holds votes but for a few texts.
    """
    said = rows.select(F.col(key).alias("key"), text).repartition("key").groupBy("key").agg(F.flatten(F.collect_list(features(F.col(text)))).alias("said"))
    kind = rows.schema[key].dataType.simpleString()
    return said.mapInArrow(_simhashes, f"key {kind}, simhash string").withColumnRenamed("key", key)


def hamming(a: Column, b: Column) -> Column:
    """Places where two strings of bits differ."""
    return F.size(F.filter(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: x != y), lambda e: e))


def simhash_pairs(hashes: DataFrame, key: str, distance: int = 3, checkpoint=lambda d: written(d, "simhash")) -> DataFrame:
    """Pairs (a, b, distance) of hashes (strings of 64 bits) at most so far apart; no pair is lost.

    Rows with equal hashes are linked with the first of them only, which stands for all in other pairs: copies make no pairs of their own.
    """
    bits = hashes.select(key, F.conv("simhash", 2, -10).cast("long").alias("bits"))
    return similarity.hamming_pairs(bits, key, "bits", distance, checkpoint)


def shingles(text: Column) -> Column:
    """Distinct word trigrams; pairs for two words; the text for one; a mark for none."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    n = lambda w: F.when(F.size(w) >= 3, 3).when(F.size(w) == 2, 2).otherwise(1)
    return let(w, lambda w: F.when(F.size(w) == 0, F.array(F.lit("_empty_"))).otherwise(_grams(w, n(w), " ")))


def _grams(w: Column, n: Column, between: str) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - n, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, n), between)))


def question_shingles(text: Column) -> Column:
    """The shingles of the reference's filter: joined by ``_``, a single word as it stands in the text."""
    w = F.filter(F.split(F.lower(text), r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"), lambda x: x != "")
    n = lambda w: F.when(F.size(w) >= 3, 3).otherwise(2)
    return let(w, lambda w: F.when(F.size(w) == 0, F.array(F.lit("_empty_"))).when(F.size(w) == 1, F.array(F.lower(text))).otherwise(_grams(w, n(w), "_")))


def minhash(text: Column, permutations: int = 128, cut=shingles) -> Column:
    """Signature: for each seed the least md5 of ``seed|shingle``."""
    return F.transform(F.array(cut(text)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda p: F.array_min(F.transform(s, lambda x: F.md5(F.concat(p.cast("string"), F.lit("|"), x))))))[0]


# MD5 (RFC 1321): rotations and constants of its 64 steps.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Messages of so many bytes are one block; so many are hashed at once.
ONE_BLOCK, AT_ONCE = 55, 8192


def md5_heads(first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """First 8 bytes, as big-endian numbers, of the MD5 of messages of one padded block: their first words, and rows 0 to 15 with all others."""
    a, b, c, d = (np.full(len(first), v, np.uint32) for v in _START)
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += words[g] if g else first
        f += np.uint32(_SINES[i])
        turned = f << np.uint32(_TURNS[i])
        f >>= np.uint32(32 - _TURNS[i])
        turned |= f
        turned += b
        a, b, c, d = d, turned, b, c
    head = np.stack((a + np.uint32(_START[0]), b + np.uint32(_START[1])), axis=1)
    return head.astype("<u4", copy=False).view(">u8")[:, 0].astype(np.uint64)


def seeded_minima(said: list[bytes], starts: np.ndarray, permutations: int) -> np.ndarray:
    """For each run of strings (from one start to the next) and seed the least of the first 8 bytes of the MD5s of ``seed|string``."""
    out = np.empty((permutations, len(starts)), np.uint64)
    size = np.fromiter(map(len, said), np.int64, len(said))
    for digits in range(1, len(str(permutations - 1)) + 1):
        head = digits + 1
        short = np.flatnonzero(size + head <= ONE_BLOCK)
        raw = np.zeros((len(short), 64), np.uint8)
        flat = np.frombuffer(b"".join(said[k] for k in short.tolist()), np.uint8)
        row = np.repeat(np.arange(len(short)), size[short])
        raw[row, head + np.arange(len(flat)) - np.repeat(np.cumsum(size[short]) - size[short], size[short])] = flat
        raw[np.arange(len(short)), head + size[short]] = 128
        raw[:, 56:58] = (8 * (head + size[short])).astype("<u2").view(np.uint8).reshape(-1, 2)
        words = np.ascontiguousarray(raw.view("<u4").T)
        long = [(k, said[k]) for k in np.flatnonzero(size + head > ONE_BLOCK).tolist()]
        found = np.empty(len(said), np.uint64)
        for seed in range(10 ** (digits - 1) if digits > 1 else 0, min(10**digits, permutations)):
            prefix = f"{seed}|".encode()
            first = words[0] | np.uint32(int.from_bytes(prefix, "little"))  # up to four bytes: seeds have three digits at most
            for lo in range(0, len(short), AT_ONCE):
                found[short[lo : lo + AT_ONCE]] = md5_heads(first[lo : lo + AT_ONCE], words[:, lo : lo + AT_ONCE])
            for k, s in long:
                found[k] = int.from_bytes(hashlib.md5(prefix + s, usedforsecurity=False).digest()[:8])
            out[seed] = np.minimum.reduceat(found, starts)
    return out.T


def _signatures(permutations: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in pieces(batch.column(1), PIECE):
                part = batch.slice(lo, hi - lo)
                starts = np.cumsum([0, *pc.list_value_length(part.column(1)).to_pylist()])[:-1]
                least = seeded_minima(part.column(1).flatten().cast(pa.binary()).to_pylist(), starts, permutations).view(np.int64)
                ends = pa.array(np.arange(len(least) + 1) * permutations, pa.int32())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(ends, pa.array(least.ravel()))], ["t", "signature"])

    return run


def signed(items: DataFrame, key: str, text: str, checkpoint, permutations: int = 128) -> tuple[DataFrame, DataFrame]:
    """(key, t) of all items, and (t, signature, same) of their unlike texts, each of which is signed once; null texts count as empty.

    Signatures hold the first 8 bytes of the least md5 of ``seed|shingle`` for each seed, ``same`` is equal for equal ones.
    """
    said = checkpoint(items.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")))
    texts = said.select("t").distinct()
    parts = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # not fewer for few bytes: the work is in the hashes
    cut = texts.repartition(parts, F.xxhash64("t")).select("t", question_shingles(F.col("t")).alias("said"))
    return said, checkpoint(cut.mapInArrow(_signatures(permutations), "t string, signature array<long>").withColumn("same", F.md5(F.concat_ws("|", F.col("signature").cast("array<string>")))))


def minhash_pairs(signatures: DataFrame, key: str, bands: int = 16, rows: int = 8, threshold: float = 0.85) -> DataFrame:
    """Pairs (a, b, similarity) that share a band and agree in at least ``threshold`` of the signature."""
    band = F.posexplode(F.array(*[F.md5(F.concat_ws("|", F.slice("signature", i * rows + 1, rows).cast("array<string>"))) for i in range(bands)]))
    keyed = signatures.select(key, band.alias("no", "band"))
    found = keyed.select(F.col(key).alias("a"), "no", "band").join(keyed.select(F.col(key).alias("b"), "no", "band"), ["no", "band"]).where("a < b").select("a", "b").distinct()
    sig = lambda end: signatures.select(F.col(key).alias(end), F.col("signature").alias("s" + end))
    same = F.size(F.filter(F.zip_with("sa", "sb", lambda x, y: x == y), lambda e: e)) / F.size("sa")
    return found.join(sig("a"), "a").join(sig("b"), "b").select("a", "b", F.round(same, 6).alias("similarity")).where(F.col("similarity") >= threshold)


def greedy_keep(items: DataFrame, key: str, pairs: DataFrame, checkpoint) -> DataFrame:
    """key and kept: an item is dropped only for a similar, earlier, kept item.

    Every round settles the items whose earlier neighbours are all settled; ``checkpoint`` cuts the lineage of a round.
    """
    state = checkpoint(items.select(key, F.lit(None).cast("boolean").alias("kept")))
    edges = pairs.select(F.col("a").alias("earlier"), F.col("b").alias(key))
    while state.where("kept is null").limit(1).count():
        near = edges.join(state.select(F.col(key).alias("earlier"), F.col("kept").alias("k")), "earlier").groupBy(key).agg(F.max(F.coalesce("k", F.lit(False))).alias("hit"), F.count_if(F.col("k").isNull()).alias("open"))
        decided = F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("hit", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        state = checkpoint(state.join(near, key, "left").select(key, decided.alias("kept")))
    return state


def _firsts(items: DataFrame, key: str, text: str, checkpoint) -> tuple[DataFrame, DataFrame]:
    """(key, first) of all items, and (key, signature) of the first item of each signature."""
    rows, texts = signed(items, key, text, checkpoint)
    seen = rows.groupBy("t").agg(F.min(key).alias("k")).join(texts, "t")
    firsts = checkpoint(seen.groupBy("same").agg(F.min("k").alias("first")))
    named = checkpoint(texts.select("t", "same").join(firsts, "same").select("t", "first"))
    single = seen.join(firsts, "same").where(F.col("k") == F.col("first")).select(F.col("k").alias(key), "signature")
    return rows.join(named, "t").select(key, "first"), checkpoint(single)


def near_duplicates(items: DataFrame, key: str, text: str, checkpoint, threshold: float = 0.85) -> DataFrame:
    """key and kept of every item, in the order of ``key``: dropped if an earlier, kept item shares a band and is similar enough.

    Equal signatures share one decision, on the earliest; so copies make no pairs.  Null texts count as empty.
    """
    rows, single = _firsts(items, key, text, checkpoint)
    kept = greedy_keep(single, key, checkpoint(minhash_pairs(single, key, threshold=threshold)), checkpoint)
    first = kept.select(F.col(key).alias("first"), "kept")
    return rows.join(first, "first").select(key, (F.col("kept") & (F.col(key) == F.col("first"))).alias("kept"))


def preloaded(items: DataFrame, known: DataFrame, key: str, text: str, checkpoint, threshold: float = 0.85) -> DataFrame:
    """key and kept of ``items``, of which none is kept that is near to a text of ``known`` (key, text): those count as kept from the start.

    Keys are numbers, of any sign; those of ``known`` are shifted below all others, so the two sides never meet.
    """
    mine = items.select(F.col(key).cast("long").alias(key), text)
    first = known.select(F.col(key).cast("long").alias(key), text)
    border = min(mine.agg(F.min(key)).first()[0] or 0, 0)
    low = first.agg(F.max(key)).first()[0] or 0
    both = first.select((F.col(key) - low - 1 + border).alias(key), text).unionByName(mine)
    _, single = _firsts(both, key, text, checkpoint)
    pairs = checkpoint(minhash_pairs(single, key, threshold=threshold))
    hit = pairs.where((F.col("a") < border) & (F.col("b") >= border)).select(F.col("b").alias(key)).distinct()
    open_ = single.where(F.col(key) >= border).join(hit, key, "left_anti")
    left = pairs.where(F.col("a") >= border).join(open_.select(F.col(key).alias("a")), "a").join(open_.select(F.col(key).alias("b")), "b")
    kept = greedy_keep(open_.select(key), key, left, checkpoint).where("kept")
    return mine.select(key).join(kept.select(key, "kept"), key, "left").select(key, F.coalesce("kept", F.lit(False)).alias("kept"))


def staged(sources: DataFrame, key: str, fingerprint: Column, title: str, checkpoint, distance: int = 3) -> DataFrame:
    """key and stage of sources in the order of ``key``: 'url' for a fingerprint that an earlier source has, 'title' for one near an
    earlier kept title, else null (kept).  A blank title is near nothing; equal titles are settled once, on the earliest."""
    seen = checkpoint(sources.select(key, fingerprint.alias("print"), F.trim(F.coalesce(F.col(title), F.lit(""))).alias("title")))
    firsts = checkpoint(seen.groupBy("print").agg(F.min(key).alias(key)).join(seen.select(key, "title"), key))
    titled = firsts.where("title <> ''").groupBy("title").agg(F.min(key).alias(key))
    hashes = checkpoint(simhash(titled, key, "title"))
    kept = greedy_keep(hashes.select(key), key, checkpoint(simhash_pairs(hashes, key, distance)), checkpoint).where("kept")
    fine = titled.join(kept.select(key), key, "left_semi").select(key).unionByName(firsts.where("title = ''").select(key)).withColumn("fine", F.lit(True))
    first = firsts.select(key, F.lit(True).alias("first"))
    return seen.select(key).join(first, key, "left").join(fine, key, "left").select(key, F.when(F.col("first").isNull(), "url").when(F.col("fine").isNull(), "title").alias("stage"))


def staged_with_meaning(sources: DataFrame, key: str, fingerprint: Column, title: str, vector: str, checkpoint, distance: int = 4, threshold: float = 0.92) -> DataFrame:
    """key and stage as ``staged`` gives them, and 'meaning' for a source that both stages keep but whose vector is at least so
    similar to an earlier kept one's; a source without a vector passes and stands in nobody's way."""
    from millrace.operators import semantic  # it builds on this module

    early = checkpoint(staged(sources, key, fingerprint, title, checkpoint, distance))
    left = checkpoint(sources.join(early.where("stage IS NULL").select(key), key, "left_semi").select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")))
    kept = semantic.semantic_keep(left.where("v IS NOT NULL"), key, "v", checkpoint, threshold)
    late = kept.where("NOT kept").select(key, F.lit("meaning").alias("late"))
    return early.join(late, key, "left").select(key, F.coalesce("stage", "late").alias("stage"))
