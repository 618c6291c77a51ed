import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import probminhash
from millrace.llm.probminhash import choose_bands, expand_pairs, groups, near_duplicates, signatures

VOCABULARY = [f"w{i}" for i in range(400)]


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in texts], "id long, text string, band string, size int")


def jaccard(a, b):
    a, b = set((a or "").lower().split()), set((b or "").lower().split())
    return len(a & b) / len(a | b) if a | b else 0.0


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    texts = []
    for i in range(120):
        base = rng.sample(VOCABULARY, 25)
        texts.append(" ".join(base))
        for _ in range(i % 4):
            other = base[:]
            for k in rng.sample(range(25), rng.choice([0, 1, 2, 3, 8])):
                other[k] = rng.choice(VOCABULARY)
            rng.shuffle(other)
            texts.append(" ".join(other).upper())
    data = list(enumerate(texts, 10))
    members, pairs = near_duplicates(rows(spark, data), F.col("text"), 0.7, 1)
    got = {tuple(r) for r in expand_pairs(members, pairs).collect()}
    want = {(i, j) for n, (i, a) in enumerate(data) for j, b in data[n + 1 :] if jaccard(a, b) >= 0.7}
    assert got == want and len(want) > 100
    group = {r["id"]: r["group_id"] for r in groups(members, pairs).collect()}
    assert set(group) == {i for i, _ in data} and all(group[a] == group[b] for a, b in want)
    parent = {i: i for i, _ in data}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in want:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert group == {i: root(i) for i, _ in data}


def test_nulls_empty_copies_and_long_texts(spark):
    long = " ".join(VOCABULARY * 500)
    data = [(1, None), (2, ""), (3, " - !"), (4, "one two"), (5, "Two, ONE"), (6, long), (7, long + " extra"), (8, "lonely text here"), (9, "one two")]
    members, pairs = near_duplicates(rows(spark, data), F.col("text"), 0.7, 1)
    assert {tuple(r) for r in expand_pairs(members, pairs).collect()} == {(4, 5), (4, 9), (5, 9), (6, 7)}
    assert {r["id"] for r in members.collect()} == {4, 5, 6, 7, 8, 9}
    members, pairs = near_duplicates(rows(spark, []), F.col("text"), 0.7, 1)
    assert expand_pairs(members, pairs).count() == 0 and groups(members, pairs).count() == 0


def test_shingles_of_five_words(spark):
    text = " ".join(VOCABULARY[:60])
    data = [(1, text), (2, text + " tail"), (3, " ".join(reversed(text.split()))), (4, "a b"), (5, "a b")]
    members, pairs = near_duplicates(rows(spark, data), F.col("text"))
    assert {tuple(r) for r in expand_pairs(members, pairs).collect()} == {(1, 2), (4, 5)}


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(5)
    words = rng.integers(1, 2**62, 40).astype(np.uint64)
    weight = np.linspace(1, 4, 40)
    a, b = np.arange(0, 30), np.arange(10, 40)
    s = signatures(np.array([0, 30, 60]), np.r_[words[a], words[b]], np.r_[weight[a], weight[b]], 4096)
    true = weight[10:30].sum() / weight.sum()
    assert abs((s[0] == s[1]).mean() - true) < 0.04
    again = signatures(np.array([0, 30]), words[b][::-1], weight[b][::-1], 4096)
    assert (again[0] == s[1]).all()  # neither order nor neighbours matter


def test_bands_keep_the_miss_rate():
    bands, size = choose_bands(0.7, 1e-3, 5)
    assert (1 - 0.7**size) ** bands <= 1e-3 < (1 - 0.7**size) ** (bands - 1)


def test_crowded_bands_lose_nothing(spark):
    # Many different sets that share nearly everything: bands are crowded, and every pair is a pair.
    common = " ".join(VOCABULARY[:60])
    data = [(i, f"{common} own{i}") for i in range(90)]
    old = probminhash.CROWD
    try:
        for probminhash.CROWD in (4, 40):
            members, pairs = near_duplicates(rows(spark, data), F.col("text"), 0.7, 1)
            assert pairs.count() == 90 * 89 // 2 and expand_pairs(members, pairs).count() == 90 * 89 // 2
    finally:
        probminhash.CROWD = old


def test_pairer_streams_a_band_larger_than_its_buffer():
    import pyarrow as pa

    def batch(band, ids):
        n = len(ids)
        return pa.RecordBatch.from_arrays([pa.array([band] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array([5] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())], names=["band", "id", "size", "b0", "b1"])

    batches = [batch(1, [1, 2])] + [batch(2, list(range(k, k + 50_000))) for k in range(0, 450_000, 50_000)] + [batch(3, [7, 8, 9]), batch(4, [1]), batch(5, [3, 4])]
    out = list(probminhash._pairer(0.7, 8_192)(iter(batches)))
    crowd = [x for b in out for x in b.column("band").to_pylist() if x is not None]
    found = {(x, y) for b in out for x, y in zip(b.column("id_a").to_pylist(), b.column("id_b").to_pylist()) if x is not None}
    assert crowd == [2] * 450_000 and found == {(1, 2), (7, 8), (7, 9), (8, 9), (3, 4)}


def test_weighted_shingles_against_brute_force(spark):
    rng = random.Random(21)
    texts = []
    for i in range(80):
        base = rng.choices(VOCABULARY[:40], k=rng.choice([1, 12, 60]))
        texts.append(base)
        for _ in range(i % 3):
            other = base[:]
            for k in rng.sample(range(len(base)), min(len(base), rng.choice([0, 1, 3, 9]))):
                other[k] = rng.choice(VOCABULARY)
            rng.shuffle(other)
            texts.append(other + base[: rng.choice([0, 2])])
    data = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")]

    def similarity(a, b):
        a, b = Counter(a), Counter(b)
        return sum((a & b).values()) / sum((a | b).values())

    members, pairs = near_duplicates(rows(spark, data), F.col("text"), 0.7, 1, weighted=True)
    got = {tuple(r) for r in expand_pairs(members, pairs).collect()}
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and similarity(a, b) >= 0.7}
    plain = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if i < j and len(set(a) & set(b)) >= 0.7 * len(set(a) | set(b))}
    assert got == want and want != plain and len(want) > 40
    true = {(i, j): similarity(texts[i], texts[j]) for i, j in want}
    assert all(abs(r["similarity"] - true[r["set_a"], r["set_b"]]) < 1e-9 for r in pairs.collect())
    members, pairs = near_duplicates(rows(spark, [(1, "a b c d e f a b c d e f"), (2, "a b c d e f"), (3, "x a b c d e f a b c d e f a b c d e f a b c d e f")]), F.col("text"), weighted=True)
    assert pairs.count() == 0 and members.count() == 3


def test_pairs_of_a_full_band_are_handed_on_in_parts():
    import pyarrow as pa

    n = 1_000
    ids = np.arange(n)
    batch = pa.RecordBatch.from_arrays([pa.array([7] * n, pa.int64()), pa.array(ids, pa.int64()), pa.array([50] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array([0] * n, pa.int64())], names=["band", "id", "size", "b0", "b1"])
    sizes, pairs = [], set()
    for out in probminhash._pairer(0.7, n)(iter([batch])):
        sizes.append(out.num_rows)
        pairs.update(zip(out.column("id_a").to_pylist(), out.column("id_b").to_pylist()))
    assert len(pairs) == n * (n - 1) // 2 == sum(sizes) and max(sizes) <= probminhash.PAIRS_HELD + n
