"""Spelling variants: words one edit apart, found by rolling-hash deletions.

A word's prefix and suffix polynomial hashes (two primes of 31 bits) give the hashes of all its deletions in one NumPy pass over
a batch of words.  Rows (hash, place, number of the word) are radix-partitioned by their hash and sorted.  Words that agree in the
hash and the place of a deletion differ by one replaced code point; a word that agrees with another's deletion differs by one
inserted one.  Each pair meets exactly once, and a run of such rows yields counts and the best partner of each member, never the
pairs.  Only rows that meet others fetch their strings: these are compared, and rows that collide are set apart.

A run is bounded by the alphabet times the word's length, so no key is hot; occurrences are added up inside tasks before words
are shuffled.  Forms are followed to their roots by doubling.

Defined cases: null and blank texts have no runs; a null doc_id counts as the text "null" in the hash that decides deletions;
rows that repeat a doc_id count each; runs and words of any length are handled; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialize, require_columns, whole_groups

SHORTEST, LEAST, TYPO_EVERY, RATIO = 5, 3, 97, 2
_PRIMES, _BASE = (2147483647, 2147483629), 911382323
#: Bytes of Latin-1: letters with A-Z lowered, blanks for all else.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_SLICE = 1 << 20


def runs(text: str) -> Iterator[list[bytes]]:
    """Lists of the letter runs of ``text`` as Latin-1 bytes with A-Z lowered, a megabyte at a time."""
    carry = b""
    for at in range(0, len(text), _SLICE):
        part = text[at : at + _SLICE].encode("latin-1", "replace").translate(_LETTERS)
        if at + _SLICE < len(text):  # a run may go on in the next slice
            cut = part.rfind(b" ") + 1
            if not cut:
                carry += part
                continue
            carry, part = part[cut:], carry + part[:cut]
        else:
            part = carry + part
        yield part.split()


def _counts(every: int):
    """Occurrences of each word in a task, with the planted deletions, as rows of at most so many words at a time."""

    def word_of(run: bytes, seed: int) -> bytes:
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
        return run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]

    def rows(found: Counter) -> pa.RecordBatch:
        words = pa.array([w.decode("latin-1") for w in found], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(found.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed, own = zlib.crc32(f"{'null' if doc_id is None else doc_id}:".encode()), Counter()
                for part in runs(text):
                    own.update(part)
                for word, n in own.items():
                    found[word_of(word, seed)] += n
                if len(found) > 200_000:
                    yield rows(found)
                    found = Counter()
        yield rows(found)

    return run


def _powers(n: int, p: int, base: int) -> np.ndarray:
    out = np.ones(max(n, 1), np.uint64)
    done, step = 1, base % p
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(step) % np.uint64(p)
        done, step = done + more, step * step % p
    return out


def deletion_hashes(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, place, hash) of each word (place -1) and of each of its deletions, flat over all words."""
    sizes = np.array([len(w) for w in words], np.int64)
    text = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64) + np.uint64(1)
    start = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - start[owner]
    longest = int(sizes.max(initial=0))
    both = np.zeros(len(text) + len(words), np.uint64)
    for p in _PRIMES:
        q, power = np.uint64(p), _powers(longest + 1, p, _BASE)
        back = np.uint64(pow(_BASE, -1, p))
        term = text * power[place] % q
        total = np.concatenate(([np.uint64(0)], np.cumsum(term)))  # below 2**31 a letter: exact up to 2**33 letters
        prefix = (total[:-1] - total[start][owner]) % q
        whole = (total[start + sizes] - total[start]) % q
        suffix = (whole[owner] + q + q - prefix - term) % q
        deleted = (prefix + suffix * back) % q
        both = both * np.uint64(1 << 31) + np.concatenate((deleted, whole))
    number = np.concatenate((owner, np.arange(len(words))))
    return number, np.concatenate((place, np.full(len(words), -1))), both.view(np.int64)


def _deletions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, place, lone, no): lone is false where the letter before is the same, so that its deletion gives the same string."""
    for batch in batches:
        words, numbers = [w.encode("latin-1") for w in batch.column("word").to_pylist()], batch.column("no").to_numpy()
        lo = 0
        while lo < len(words):  # a few million letters at a time, whole words
            hi, size = lo, 0
            while hi < len(words) and (hi == lo or size + len(words[hi]) < 2_000_000):
                size, hi = size + len(words[hi]), hi + 1
            number, place, key = deletion_hashes(words[lo:hi])
            text = np.frombuffer(b"".join(words[lo:hi]), np.uint8)
            lone = np.ones(len(key), bool)
            lone[1 : len(text)] = (text[1:] != text[:-1]) | (place[1 : len(text)] == 0)
            for at in range(0, len(key), 500_000):
                part = slice(at, at + 500_000)
                columns = [pa.array(key[part]), pa.array(place[part], pa.int32()), pa.array(lone[part]), pa.array(numbers[lo:hi][number[part]])]
                yield pa.RecordBatch.from_arrays(columns, ["key", "place", "lone", "no"])
            lo = hi


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, slot, place, no) of the runs in which words may meet: one deletion's place as slot, or -1 for a word and its insertions."""
    for rows in whole_groups(batches, ["key"]):
        key, place, no = (rows.column(c).to_numpy() for c in ("key", "place", "no"))
        lone = rows.column("lone").to_numpy(zero_copy_only=False)
        same = np.concatenate(([False], (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (place[1:] >= 0), [False]))
        replaced = same[1:] | same[:-1]
        group = np.cumsum(np.concatenate(([True], key[1:] != key[:-1]))) - 1
        whole = np.bincount(group, place < 0) > 0
        longer = np.bincount(group, (place >= 0) & lone) > 0
        inserted = (whole & longer)[group] & lone
        at = np.concatenate((np.flatnonzero(replaced), np.flatnonzero(inserted)))
        slot = np.where(np.arange(len(at)) < replaced.sum(), place[at], -1)
        columns = [pa.array(key[at]), pa.array(slot, pa.int32()), pa.array(place[at], pa.int32()), pa.array(no[at])]
        yield pa.RecordBatch.from_arrays(columns, ["key", "slot", "place", "no"])


def _best_two(members: list[tuple[int, str]]) -> tuple:
    """The greatest n, ties to the smaller word, and the next one."""
    ranked = sorted(members, key=lambda m: (-m[0], m[1]))[:2]
    return ranked[0], ranked[1] if len(ranked) > 1 else None


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each word of a run: how many others it meets there, and the best of them."""
    for rows in whole_groups(batches, ["key", "slot"]):
        keys, slots = rows.column("key").to_numpy(), rows.column("slot").to_numpy()
        change = np.flatnonzero((keys[1:] != keys[:-1]) | (slots[1:] != slots[:-1])) + 1
        words, places, ns = (rows.column(c).to_pylist() for c in ("word", "place", "n"))
        out = []
        for lo, hi in zip([0, *change.tolist()], [*change.tolist(), len(words)], strict=True):
            texts: dict[str, list[int]] = {}  # equal hashes of unlike strings part here
            for k in range(lo, hi):
                w, i = words[k], places[k]
                texts.setdefault(w if i < 0 else w[:i] + w[i + 1 :], []).append(k)
            for at in texts.values():
                if len(at) > 1:
                    _meet(at, words, places, ns, out)
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["word", "near", "form", "form_n"])


def _meet(at: list[int], words: list[str], places: list[int], ns: list[int], out: list) -> None:
    """Rows of one run whose strings agree: words that replace one letter, or one word (place -1) and longer ones."""
    whole = [k for k in at if places[k] < 0]
    if not whole:
        best, second = _best_two([(ns[k], words[k]) for k in at])
        for k in at:
            n, w = second if best[1] == words[k] else best
            out.append((words[k], len(at) - 1, w, n))
    elif len(at) > 1:
        k = whole[0]
        longer = [j for j in at if places[j] >= 0]
        best, _ = _best_two([(ns[j], words[j]) for j in longer])
        out.append((words[k], len(longer), best[1], best[0]))
        out += [(words[j], 1, words[k], ns[k]) for j in longer]


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form), form null at a root: each round doubles the steps that are followed."""
    steps = materialize(forms.select("word", F.coalesce("form", "word").alias("root")), "roots")
    while True:
        ahead = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialize(steps.join(ahead, "root").select("word", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "roots")
        steps = longer.select("word", "root")
        if longer.where("moved").limit(1).count() == 0:
            return steps


def spelling_variants(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST, every: int = TYPO_EVERY, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n for each word of ``docs`` (doc_id, text)."""
    docs = require_columns(docs, "doc_id", "text")
    counted = docs.mapInArrow(_counts(every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(counted.where((F.length("word") >= shortest) & (F.col("n") >= least)).withColumn("no", F.monotonically_increasing_id()), "words")
    radix = F.shiftrightunsigned("key", 40)
    keyed = words.select("word", "no").mapInArrow(_deletions, "key long, place int, lone boolean, no long")
    shared = keyed.repartition(radix).sortWithinPartitions("key", "place").mapInArrow(_shared, "key long, slot int, place int, no long")
    runs_ = shared.join(words, "no").repartition("key", "slot").sortWithinPartitions("key", "slot")
    met = runs_.mapInArrow(_partners, "word string, near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    met = met.groupBy("word").agg(F.sum("near").alias("n_near"), best.alias("best"))
    follows = -F.col("best.m") >= ratio * F.col("n")
    joined = words.join(met, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(follows, F.col("best.form")).alias("form"), F.when(follows, -F.col("best.m")).alias("form_n")
    )
    joined = materialize(joined, "forms")
    return joined.join(roots(joined), "word").select("word", "form", "root", "n", "n_near", "form_n")
