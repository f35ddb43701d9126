"""Operators 11 to 13 against brute force: nulls, odd vectors, ties, repeats, clashing columns, very long texts, empty tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import lloyd, spelling, spherical_caps

NAN, INF = float("nan"), float("inf")


def unit_rows(n, dim, seed):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.fixture(scope="module")
def vectors(spark):
    base = unit_rows(400, 32, 1)
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist(), i % 3) for i, x in enumerate(base)]
    for k in range(150):  # one dense group, and pairs on both sides of the threshold
        rows.append((1000 + k, (base[0] + 0.01 * rng.standard_normal(32)).tolist(), 0))
    for k in range(60):
        other = unit_rows(1, 32, 100 + k)[0]
        other -= (other @ base[k]) * base[k]
        angle = np.arccos(0.98) * (0.9 + 0.2 * (k + 0.5) / 60)  # never at the threshold itself
        rows.append((2000 + k, (np.cos(angle) * base[k] + np.sin(angle) * other / np.linalg.norm(other)).tolist(), k % 3))
    rows += [(5, base[5].tolist(), 2), (5, base[5].tolist(), 2), (3000, (base[7] * 1e200).tolist(), 1), (3001, base[8].tolist(), None)]
    rows += [(3002, None, 1), (3003, [], 1), (3004, [0.0] * 32, 1), (3005, [1.0, None] * 16, 1), (3006, [NAN] * 32, 1), (3007, [INF] * 32, 1)]
    rows += [(None, base[9].tolist(), 0), (3008, base[9].tolist()[:31], 0), (3009, [1.0], 1), (3010, [2.0], 1), (3011, [-2.0], 1), (5, base[6].tolist(), 0)]
    return spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], "vec_id long, embedding array<double>, label int, node int, copies int, filter int, own int")


def brute_links(rows, threshold=0.98):
    good = [
        r.vec_id is not None and r.label is not None and bool(r.embedding) and None not in r.embedding and np.isfinite(r.embedding).all() and any(r.embedding)
        for r in rows
    ]
    near = defaultdict(set)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if good[i] and good[j] and a.label == b.label and len(a.embedding) == len(b.embedding):
                x, y = (np.array(v.embedding) / max(map(abs, v.embedding)) for v in (a, b))
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold:
                    near[i].add(j), near[j].add(i)
    out = []
    for i, r in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = near[todo.pop()] - seen
            seen |= new
            todo += new
        least = min((rows[k].vec_id for k in seen), default=None) if r.vec_id is not None else None
        out.append((r.vec_id, len(near[i]), least, r.vec_id is None or r.vec_id == least))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1000, 40])
def test_near_vectors_equal_brute_force(vectors, block):
    got = spherical_caps.near_vectors(vectors, block=block).collect()
    want = brute_links(vectors.collect())
    assert sorted(map(tuple, got), key=str) == want
    assert sum(n for _, n, *_ in want) > 150 * 149


def test_near_vectors_of_an_empty_table(vectors):
    assert spherical_caps.near_vectors(vectors.limit(0)).count() == 0


def test_filters_miss_no_pair_at_the_threshold():
    x, z = unit_rows(20_000, 64, 3), unit_rows(20_000, 64, 4)
    z -= (z * x).sum(axis=1)[:, None] * x
    z /= np.linalg.norm(z, axis=1)[:, None]
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z
    for filters in (1 << 12, 1 << 20):
        hit = np.zeros(len(x), bool)
        for r in range(spherical_caps.ROTATIONS):
            code = spherical_caps.ProductCode(64, filters, r)
            a, b = (code.exceeded(v.astype(np.float32), spherical_caps.BEST) for v in (x, y))
            hit |= (a[:, :, None] == b[:, None, :]).any(axis=(1, 2))
        assert hit.all()


def test_best_filters_equal_a_full_scan():
    code, x = spherical_caps.ProductCode(24, 1000, 0), unit_rows(50, 24, 5).astype(np.float32)
    parts = [x @ p.T for p in code.parts]
    every = parts[0]
    for p in parts[1:]:
        every = (every[:, :, None] + p[:, None, :]).reshape(len(x), -1)
    for row, found in zip(every, code.exceeded(x, 8), strict=True):
        assert sorted(row[found.astype(int)]) == sorted(np.sort(row)[-8:])


def brute_lloyd(rows, k, dim, rounds):
    keep = [(r.vec_id, [x for x in r.embedding]) for r in rows if r.embedding is not None and len(r.embedding) == dim]
    keep = [(i, x) for i, x in keep if None not in x and np.isfinite(x).all()]
    ints = [(i, [x.as_integer_ratio()[0] * 256 // x.as_integer_ratio()[1] for x in v], v) for i, v in keep]
    order = sorted(ints, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[2]))
    centres = [x for _, x, _ in order[:k]]

    def nearest(x):
        d = [sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centres]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        groups = defaultdict(list)
        for _, x, _ in ints:
            groups[nearest(x)[0]].append(x)
        centres = [[sum(v) // len(groups[c]) for v in zip(*groups[c], strict=True)] if c in groups else m for c, m in enumerate(centres)]
    at = [(i, *nearest(x)) for i, x, _ in ints]
    fits = lambda v: v if v < 1 << 63 else None
    per = defaultdict(int)
    for _, c, d in at:
        per[c] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, fits(d), fits(per[c]), fits(sum(per.values())), digest[c]) for i, c, d in at), key=str)


def test_lloyd_equals_brute_force(spark):
    x = unit_rows(300, 6, 7)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3, x[9].tolist()), (4, x[4].tolist()), (None, x[1].tolist()), (400, [-0.0] * 6)]
    rows += [(401, None), (402, []), (403, [1.0] * 5), (404, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (405, [NAN] * 6), (406, [INF] * 6)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, cluster int, limb int").repartition(3)
    got = lloyd.lloyd(frame, k=5, dim=6, rounds=4).collect()
    assert sorted(map(tuple, got), key=str) == brute_lloyd(frame.collect(), 5, 6, 4)
    assert lloyd.lloyd(frame.limit(0), k=5, dim=6).count() == 0
    few = frame.where("vec_id < 3")
    assert sorted(map(tuple, lloyd.lloyd(few, k=5, dim=6).collect()), key=str) == brute_lloyd(few.collect(), 5, 6, 5)


def test_lloyd_is_exact_beyond_machine_integers(spark):
    rows = [(1, [3e38, -1.0]), (2, [2.5e38, 1.0]), (3, [1.0, 2.0]), (4, [-3e300, 0.5]), (5, [5e8, -5e8])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = lloyd.lloyd(frame, k=2, dim=2, rounds=3).collect()
    want = brute_lloyd(frame.collect(), 2, 2, 3)
    assert [(r[0], r[1], r[2], r[5]) for r in sorted(map(tuple, got), key=str)] == [(w[0], w[1], w[2], w[5]) for w in want]


def edit_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows, shortest=5, least=3, every=97):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            n[run if h % every else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    n = {w: k for w, k in n.items() if len(w) >= shortest and k >= least}
    form, near = {}, {}
    for w in n:
        mates = [v for v in n if abs(len(v) - len(w)) < 2 and edit_one(v, w)]
        near[w], best = len(mates), min(mates, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], near[w], n.get(form[w])))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def spelled():
    rng = np.random.default_rng(11)
    stems = ["".join(rng.choice(list("abà"), rng.integers(4, 8))) for _ in range(150)] + ["aaaaaa", "aaaaa", "aaaaaaa", "Ñandu", "ñandu", "Àbcde"]
    text = lambda: "".join(w + str(rng.choice([" ", "-", "_", "日", "\n", "'"])) for w in rng.choice(stems, 60))
    rows = [(i, text()) for i in range(60)] + [(1, text()), (None, text()), (70, None), (71, ""), (72, "12 !! 日本"), (73, "x×y÷z ß " * 4)]
    rows.append((90, "stone " * 40 + "stene " * 10 + "stenes " * 4))
    return [*rows, (80, "ab" * 700_000), (81, "ab" * 700_000), (82, "ab" * 700_000), (83, "ba" * 350_000 + "b" + "ba" * 350_000), (84, "wörds " * 400_000)]


def test_spelling_equals_brute_force(spark, spelled):
    docs = spark.createDataFrame([(*r, 1, 2) for r in spelled], "doc_id long, text string, word int, n int").repartition(5)
    got = spelling.spelling_variants(docs).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == brute_words(spelled)
    assert any(r.form and r.root != r.form for r in got)
    assert spelling.spelling_variants(docs.limit(0)).count() == 0


def test_runs_are_not_cut_between_slices(monkeypatch):
    monkeypatch.setattr(spelling, "_SLICE", 7)
    text = "abc defghijklmnopqrstuvw x yz" * 5
    assert [w for part in spelling.runs(text) for w in part] == text.encode().split()


def test_colliding_hashes_are_told_apart():
    words = ["abcde", "abcdf", "vwxyz", "vwxyq"]
    rows = [{"key": 7, "slot": 4, "place": 4, "word": w, "n": 5} for w in words]  # one hash for two strings
    rows += [{"key": 7, "slot": -1, "place": i, "word": w, "n": 5} for w, i in (("vwxy", -1), ("vwxyz", 4), ("abcde", 4))]
    rows.sort(key=lambda r: r["slot"])
    out = [r for b in spelling._partners([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    want = [("abcde", "abcdf"), ("abcdf", "abcde"), ("vwxy", "vwxyz"), ("vwxyq", "vwxyz"), ("vwxyz", "vwxy"), ("vwxyz", "vwxyq")]
    assert sorted((r["word"], r["form"]) for r in out) == want and all(r["near"] == 1 for r in out)


def test_deletion_hashes_equal_hashes_of_the_deletions():
    words = [b"abcde", b"a", b"zzzz", bytes(range(0xC0, 0xFF))]
    number, place, key = spelling.deletion_hashes(words)
    whole = {}
    for w in {words[k] if i < 0 else words[k][:i] + words[k][i + 1 :] for k, i in zip(number, place, strict=True)} - {b""}:
        n, p, h = spelling.deletion_hashes([w])
        whole[w] = h[p == -1][0]
    for k, i, h in zip(number, place, key, strict=True):
        w = words[k] if i < 0 else words[k][:i] + words[k][i + 1 :]
        assert not w or whole[w] == h
