"""Similarity joins against brute force: ties, copies, empty sets, one hot element, one hot block of bits."""

import hashlib
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import dedup, similarity
from millrace.plans.registry import QUERIES
from millrace.session import written

RNG = np.random.default_rng(21)


def keep(df):
    return written(df, "similarity")


def brute_sets(rows, threshold):
    seen, firsts, out = {}, [], []
    for k, s in sorted((k, frozenset(s)) for k, s in rows if s):
        if s in seen:
            out.append((seen[s], k, 1.0))
        else:
            seen[s] = k
            firsts.append((k, s))
    for (a, x), (b, y) in itertools.combinations(firsts, 2):
        same = len(x & y) / len(x | y)
        if same >= threshold:
            out.append((a, b, round(same, 9)))
    return sorted(out)


@pytest.mark.parametrize("threshold,block", [(0.75, 400), (0.5, 20), (1.0, 400), (0.2, 50)])
def test_jaccard_pairs(spark, threshold, block):
    words = [f"w{k}" for k in range(60)]
    rows = [(k, RNG.choice(words, RNG.integers(1, 12)).tolist() + ["hot"] * (k % 3 == 0)) for k in range(250)]
    rows += [(1000 + k, [*rows[k][1], "more"]) for k in range(60)] + [(2000 + k, rows[k][1]) for k in range(20)] + [(3000, []), (3001, None), (3002, ["hot"])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, s array<string>, n int")
    got = similarity.jaccard_pairs(df, "id", "s", threshold, keep, block).collect()
    assert sorted((r.a, r.b, round(r.similarity, 9)) for r in got) == brute_sets(rows, threshold)
    assert similarity.jaccard_pairs(df.limit(0), "id", "s", threshold, keep).count() == 0


def test_elements_of_one_set_alone_do_not_travel(spark):
    rows = [(k, [f"own{k}-{i}" for i in range(30)]) for k in range(50)] + [(100, [*"abcdefgh"]), (101, [*"abcdefg", "mine"])]
    seen = []
    keep_all = lambda d: (seen.append(keep(d)), seen[-1])[1]
    got = similarity.jaccard_pairs(spark.createDataFrame(rows, "id long, s array<string>"), "id", "s", 0.75, keep_all).collect()
    assert [(r.a, r.b, round(r.similarity, 6)) for r in got] == [(100, 101, round(7 / 9, 6))]
    coded = next(d for d in seen if "codes" in d.columns)
    assert coded.select(F.sum(F.size("codes"))).first()[0] == 14


def brute_hashes(rows, distance):
    seen, firsts, out = {}, [], []
    for k, b in sorted(rows):
        if b in seen:
            out.append((seen[b], k, 0))
        else:
            seen[b] = k
            firsts.append((k, b))
    keys, bits = np.array([k for k, _ in firsts]), np.array([b for _, b in firsts], np.int64).view(np.uint64)
    far = np.bitwise_count(bits[:, None] ^ bits[None, :])
    for i, j in zip(*np.nonzero(np.triu(far <= distance, 1)), strict=True):
        out.append((int(keys[i]), int(keys[j]), int(far[i, j])))
    return sorted(out)


@pytest.mark.parametrize("distance,crowded,block", [(3, 1000, 400), (3, 30, 10), (4, 50, 400), (0, 10, 400)])
def test_hamming_pairs(spark, distance, crowded, block):
    base = RNG.integers(-(2**63), 2**63 - 1, 300)
    hot = (base[:400] & ~np.int64(0xFFFF)) | np.int64(0x1234)  # one block of bits that many share
    hotter = (hot & ~np.int64(0xFFFF0000)) | np.int64(0x77770000)  # and two
    flips = [int(b) ^ sum(1 << int(p) for p in RNG.choice(63, RNG.integers(0, 6), replace=False)) for b in base]
    rows = [(k, int(b)) for k, b in enumerate([*base, *hot, *hotter, *flips])]
    df = spark.createDataFrame(rows, "id long, h long")
    got = similarity.hamming_pairs(df, "id", "h", distance, keep, crowded, block).collect()
    assert sorted((r.a, r.b, r.distance) for r in got) == brute_hashes(rows, distance)


def test_a_band_that_very_many_share(spark):
    """A hundred thousand hashes with one equal block: cut again, so that few are compared."""
    bits = RNG.integers(0, 2**47, 100_000).astype(np.int64) << 16 | np.int64(0x4242)
    planted = bits[:50] ^ np.int64(1 << 40 | 1 << 20)
    rows = spark.createDataFrame([(k, int(b)) for k, b in enumerate([*bits, *planted])], "id long, h long").repartition(8)
    got = similarity.hamming_pairs(rows, "id", "h", 3, keep).where("distance > 0").collect()
    assert {(k, 100_000 + k, 2) for k in range(50)} <= {(r.a, r.b, r.distance) for r in got}
    sample = np.array([r.a for r in got[:200]]), np.array([r.b for r in got[:200]])
    every = np.concatenate((bits, planted)).view(np.uint64)
    assert (np.bitwise_count(every[sample[0]] ^ every[sample[1]]) <= 3).all()


def test_simhash_pairs_keep_their_rule(spark):
    rows = [(k, "".join(RNG.choice(["0", "1"], 64))) for k in range(60)]
    rows += [(100 + k, rows[k][1][:10] + ("1" if rows[k][1][10] == "0" else "0") + rows[k][1][11:]) for k in range(20)] + [(200, rows[3][1])]
    got = dedup.simhash_pairs(spark.createDataFrame(rows, "id long, simhash string"), "id", 3)
    want = brute_hashes([(k, int(b, 2) - (1 << 64 if b[0] == "1" else 0)) for k, b in rows], 3)
    assert sorted((r.a, r.b, r.distance) for r in got.collect()) == want


def test_three_stages_of_sources(spark):
    rng = np.random.default_rng(4)
    v = [x.tolist() for x in rng.standard_normal((12, 6))]
    near = (np.array(v[0]) + 0.01).tolist()
    rows = [
        (1, "https://a.org/x", "carbon disclosure rules for banks in europe today", v[0]),
        (2, "https://a.org/x?utm_source=m", "another title altogether about water and forests", v[1]),  # the same page
        (3, "https://b.org/y", "carbon disclosure rules for banks in europe today", v[2]),  # the same title
        (4, "https://c.org/z", "solar panels on every roof by the year twenty thirty", near),  # the same meaning
        (5, "https://d.org/z", "wind parks far off the coast need longer cables now", None),
        (6, "https://e.org/z", "", v[4]),
        (7, "https://f.org/z", "hydrogen trains on rural lines replace diesel slowly", v[4]),  # the same meaning as 6
        (8, "https://g.org/z", "a fish farm in the north asks for new permits again", (-np.array(v[0])).tolist()),
    ]
    df = spark.createDataFrame(rows, "id long, url string, title string, v array<double>")
    from millrace.functions import urls

    got = dedup.staged_with_meaning(df, "id", urls.fingerprint(F.col("url")), "title", "v", keep)
    assert {r.id: r.stage for r in got.collect()} == {1: None, 2: "url", 3: "title", 4: "meaning", 5: None, 6: None, 7: "meaning", 8: None}


def test_known_texts_stand_before_items_of_any_key(spark):
    known = spark.createDataFrame([(-5, "who has to report on climate risks under the new rules"), (9, "what is a green bond")], "id long, t string")
    items = [(-20, "what is a green bond"), (-3, "when does the law apply to small firms in the union"), (0, "when does the law apply to small firms in the union"), (4, "quite another question here"), (7, None)]
    got = dedup.preloaded(spark.createDataFrame(items, "id long, t string"), known, "id", "t", keep)
    assert {r.id: r.kept for r in got.collect()} == {-20: False, -3: True, 0: False, 4: True, 7: True}


def test_simhash_counts_a_keys_rows_together_and_equal_titles_once(spark, tmp_path):
    def bits(texts):
        w = [t.lower().split() for t in texts if t]
        said = [f for x in w for f in [*x, *(f"{a} {b}" for a, b in itertools.pairwise(x))]]
        heads = [int(hashlib.md5(f.encode()).hexdigest()[:16], 16) for f in said]
        return "".join("1" if 2 * sum(h >> (63 - i) & 1 for h in heads) > len(heads) else "0" for i in range(64))

    rows = [(1, "a b"), (1, None), (2, None), (3, ""), (4, "One two  one"), (4, "two"), (5, "ż ż\tx " * 40)]
    got = {r.k: r.simhash for r in dedup.simhash(spark.createDataFrame(rows, "k long, t string"), "k", "t").collect()}
    assert got == {k: bits([t for i, t in rows if i == k]) for k in range(1, 6)}
    parts = [(k, ["old ring", "new bolt"][k % 2], f"Brand#{k % 3}") for k in range(40)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string").write.parquet(f"{tmp_path}/part.parquet")
    found = QUERIES["title_neighbours"](spark, str(tmp_path)).collect()
    classes = {}
    for k, name, brand in parts:
        for i, t in enumerate((name, name.upper().replace(" ", "  "), f"{name} {name} {brand} more")):
            classes.setdefault(bits([t]), []).append(3 * k + i)
    want = {(min(x), min(y), f, len(x), len(y)) for a, x in classes.items() for b, y in classes.items() if min(x) < min(y) and (f := sum(c != d for c, d in zip(a, b, strict=True))) <= 3}
    assert {(r.a, r.b, r.distance, r.n_a, r.n_b) for r in found} == want and len(found) == len(want)


@pytest.mark.parametrize("permutations", [1, 10, 128])
def test_signatures_are_the_least_md5s_of_unlike_texts(spark, permutations):
    texts = ["", None, "One", "a b", "a b c d", "é " * 50 + "x", "w" * 49 + " b c", "w" * 60 + " b c", "a b c d", "w" * 48 + " b c", "w" * 50 + " b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    said, signed = dedup.signed(rows, "id", "t", keep, permutations)
    cut = {r.t: r.s for r in said.select("t", dedup.question_shingles(F.col("t")).alias("s")).collect()}
    got = {r.t: [x % 2**64 for x in r.signature] for r in signed.collect()}
    assert signed.count() == len(got) == len({t or "" for t in texts}) and said.count() == len(texts)
    assert got == {t: [min(int(hashlib.md5(f"{p}|{x}".encode()).hexdigest()[:16], 16) for x in s) for p in range(permutations)] for t, s in cut.items()}
