import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest

from millrace.llm import leaks
from millrace.llm.leaks import Fingerprints, MultiIndex, leaked_items, weighted_shingle_similarity, word_pairs
from millrace.llm.words import mix

WORDS = [f"w{i}" for i in range(300)]
DOC, ITEM = "doc_id long, text string, item_id long, words string", "item_id long, passage string, id long"


def found(spark, docs, items, **more):
    d = spark.createDataFrame([(*x, 1, "x") for x in docs], DOC)
    return leaked_items(d, spark.createDataFrame([(*x, 1) for x in items], ITEM), **more)


def exact(spark, docs, items, **more):
    return sorted((r["doc_id"], r["item_id"]) for r in found(spark, docs, items, **more).filter("exact").collect())


def bits(hashes):
    return np.unpackbits(mix(hashes).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(int)


def test_fingerprints_against_counting():
    rng = np.random.default_rng(1)
    words = rng.integers(-(2**62), 2**62, 50)
    prints, single = Fingerprints(words), bits(words.view(np.uint64))
    double = 2 * np.unpackbits(word_pairs(words).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for width in (16, 1, 2, 3, 7, 10, 13, 48):
        counts = [single[i : i + width].sum(0) + double[i : i + width - 1].sum(0) for i in range(50 - width + 1)]
        want = [int("".join("1" if c > (3 * width - 2) / 2 else "0" for c in count), 2) for count in counts]
        assert prints.windows(width).tolist() == want
    assert len(Fingerprints(rng.integers(0, 9, 3)).windows(5)) == 0 and len(Fingerprints(words[:0]).windows(1)) == 0 and len(Fingerprints(words[:1]).windows(1)) == 1


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 400).astype(np.uint64)
    probes = base.copy()
    for _ in range(16):
        probes ^= np.where(rng.random(400) < 0.7, np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64), np.uint64(0))
    for radius in (0, 1, 3, 7, 11, 15):
        rows, items = MultiIndex(base, radius).within(probes)
        want = {(i, j) for i in range(400) for j in range(400) if int(probes[i] ^ base[j]).bit_count() <= radius}
        assert len(rows) == len(want) and set(zip(rows.tolist(), items.tolist())) == want
    assert len(MultiIndex(base[:0], 3).within(probes)[0]) == 0


def test_similarity():
    a = np.array([[1, 2, 3, 4], [1, 1, 2, 2], [1, 2, 3, 4]])
    b = np.array([[1, 2, 3, 4], [1, 2, 2, 2], [9, 8, 7, 6]])
    s = weighted_shingle_similarity(a, b)
    assert s[0] == 1 and s[2] == 0 and abs(s[1] - (3 + 2 * 2) / (2 * 10 - 7)) < 1e-12


def test_similarity_against_counting():
    rng = np.random.default_rng(7)
    for width in (2, 9, 33):
        a, b = (mix(rng.integers(0, 2 + width // 2, (50, width)).astype(np.uint64)).view(np.int64) for _ in range(2))
        count = lambda w: Counter(w) + Counter(zip(w, w[1:])) + Counter(zip(w, w[1:]))
        for s, x, y in zip(weighted_shingle_similarity(a, b), map(tuple, a.tolist()), map(tuple, b.tolist())):
            shared = sum((count(x) & count(y)).values())
            assert abs(s - shared / (2 * (3 * width - 2) - shared)) < 1e-12
    assert len(weighted_shingle_similarity(a[:0], b[:0])) == 0


def test_against_brute_force(spark):
    rng = random.Random(6)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([5, 9, 10, 30])))) for i in range(40)]
    docs = []
    for i in range(150):
        text = rng.choices(WORDS, k=rng.choice([0, 8, 60]))
        for _ in range(rng.choice([0, 1, 2])):
            passage = rng.choice(items)[1].split()
            k = rng.choice([9, 10, 12])
            at = rng.randint(0, max(0, len(passage) - k))
            text += passage[at : at + k] + rng.choices(WORDS, k=3)
        docs.append((i, rng.choice([" ", ", ", "--\n"]).join(text).upper()))
    grams = lambda t: {tuple(t[i : i + 10]) for i in range(len(t) - 9)}
    split = lambda t: "".join(c if c.isalnum() else " " for c in t.lower()).split()
    want = sorted((d, i) for d, t in docs for i, p in items if grams(split(t)) & grams(split(p)))
    assert exact(spark, docs, items) == want and len(want) > 20
    old = leaks.WINDOWS_PER_BLOCK
    leaks.WINDOWS_PER_BLOCK = 50  # several blocks of items, and passages that are spread over them
    try:
        assert exact(spark, docs, items) == want
    finally:
        leaks.WINDOWS_PER_BLOCK = old


def test_edges(spark):
    p = " ".join(WORDS[:20])
    docs = [(1, None), (2, ""), (3, p), (3, p), (4, " ".join(WORDS[5:14])), (5, ("filler " * 100_000) + p), (6, p.replace(" ", "’s ")), (7, " ".join(WORDS[:9] + ["x"] + WORDS[10:19]))]
    items = [(1, p), (2, None), (3, "too short"), (4, p)]
    assert exact(spark, docs, items) == [(3, 1), (3, 4), (5, 1), (5, 4)]
    assert exact(spark, [], items) == [] and exact(spark, docs, []) == []


def test_windows_do_not_span_documents(spark):
    p = WORDS[:10]
    assert exact(spark, [(1, " ".join(["y"] * 10 + p[:5])), (2, " ".join(p[5:] + ["z"] * 10))], [(1, " ".join(p))]) == []


def altered(rng, words):
    """A passage with a word in every ten changed, two neighbours swapped, a word put in, or one dropped."""
    words, kind = list(words), rng.randrange(4)
    for i in range(rng.randrange(10), len(words), 10):
        if kind == 0:
            words[i] = "other"
        elif kind == 1:
            words[i : i + 2] = words[i : i + 2][::-1]
        else:
            words[i : i + 1] = [words[i], "more"] if kind == 2 else []
    return words


def test_passages_altered_all_over_are_found(spark):
    """Passages with 5 to 10 % of their words replaced, each in a document of its own, and documents without any."""
    rng = random.Random(12)
    words = [f"v{i}" for i in range(5_000)]
    passages = [rng.choices(words, k=rng.randint(24, 160)) for _ in range(150)]
    docs = []
    for i in range(600):
        p = passages[i % 150][:]
        for k in rng.sample(range(len(p)), round(len(p) * rng.uniform(0.05, 0.1))):
            p[k] = rng.choice(words)
        docs.append((i, " ".join(rng.choices(words, k=50) + p + rng.choices(words, k=50))))
    docs += [(1000 + i, " ".join(rng.choices(words, k=200))) for i in range(200)]
    items = [(i, " ".join(p)) for i, p in enumerate(passages)]
    got = {(r["doc_id"], r["item_id"]) for r in found(spark, docs, items).collect()}
    want = {(i, i % 150) for i in range(600)}
    assert len(got & want) >= 0.99 * len(want) and got <= want


def test_item_sized_windows_against_brute_force(monkeypatch):
    """Without the keys of shared pairs: fingerprints alone find the item-sized windows at the similarity and above."""
    rng = random.Random(13)
    words = [f"v{i}" for i in range(5_000)]
    passages = [rng.choices(words, k=49) for _ in range(60)]
    docs, want = [], set()
    for i in range(400):
        p = passages[i % 60][:]
        for k in range(rng.randrange(12), 49, rng.choice((12, 16, 24))):
            p[k] = rng.choice(words)
        docs.append((i, " ".join(rng.choices(words, k=20) + p + rng.choices(words, k=20))))
        a, b = (np.array([[hash(w) for w in x]]) for x in (p, passages[i % 60]))
        if weighted_shingle_similarity(a, b)[0] >= 0.8:
            want.add((i, i % 60))
    monkeypatch.setattr(leaks.SharedPairs, "candidates", lambda self, words: (np.empty(0, np.int64),) * 2)
    own = leaks._finder(SimpleNamespace(value=[(i, np.array([hash(w) for w in p])) for i, p in enumerate(passages)]), 48, 0.8, leaks.ITEM_WIDTHS)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _ in docs], pa.int64()), pa.array([[hash(w) for w in t.split()] for _, t in docs], pa.list_(pa.int64()))], names=["id", "words"])
    rows = [r for out in own(iter([batch])) for r in out.to_pylist()]
    got = {(r["doc_id"], r["item_id"]) for r in rows}
    assert len(want) > 200 and len(got & want) >= 0.95 * len(want)


@pytest.mark.parametrize("width, similarity", [(10, 0.8), (10, 0.6), (4, 0.5), (16, 0.75)])
def test_altered_stretches_against_brute_force(spark, width, similarity):
    rng = random.Random(8)
    passages = [rng.choices(WORDS if i % 3 else WORDS[:3], k=rng.choice([width, 24])) for i in range(16)]
    docs = [rng.choices(WORDS, k=3) + altered(rng, rng.choice(passages)) + rng.choices(WORDS, k=3) for _ in range(60)]

    def windows(w):
        return {(g, frozenset(c.items())) for g in (tuple(w[i : i + width]) for i in range(len(w) - width + 1)) for c in [Counter(g) + Counter(zip(g, g[1:])) + Counter(zip(g, g[1:]))]}

    def score(a, b):
        a, b = dict(a), dict(b)
        shared = sum(min(n, b.get(k, 0)) for k, n in a.items())
        return shared / (2 * (3 * width - 2) - shared)

    split, want = [windows(p) for p in passages], {}
    for d, doc in enumerate(docs):
        own = windows(doc)
        for i, p in enumerate(split):
            best = max((score(a, b) for _, a in own for _, b in p), default=0.0)
            if best >= similarity:
                want[d, i] = round(best, 9)
    rows = found(spark, [(d, " ".join(w)) for d, w in enumerate(docs)], [(i, " ".join(w)) for i, w in enumerate(passages)], width=width, similarity=similarity, item_widths=()).collect()
    assert {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in rows} == want
    assert sum(s < 1 for s in want.values()) > 10


def test_too_low_a_similarity_is_refused(spark):
    with pytest.raises(ValueError):
        found(spark, [], [], similarity=0.05)
