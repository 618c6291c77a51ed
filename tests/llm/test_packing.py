import os
import random

import numpy as np
import pytest

from millrace.llm.packing import TOKENIZER, Packer, fill_report, hilbert_keys, pack_sizes, packed, tokenizer

pytestmark = pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no vocabulary file")
DOC = "doc_id long, text string, key long, n_tokens long"


def test_hilbert_curve_visits_neighbours():
    side = np.arange(8)
    points = np.stack(np.meshgrid(side, side, side, indexing="ij"), -1).reshape(-1, 3)
    keys = hilbert_keys(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = points[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_best_fit():
    packer = Packer(10, 4)
    rows = pack_sizes([(1, 6), (2, 5), (3, 4), (4, 5), (5, 23), (6, 0)], packer)
    used = {}
    for box, _, _, _, n, offset in sorted(rows, key=lambda r: (r[0], r[5])):
        assert offset == used.get(box, 0)
        used[box] = offset + n
    assert max(used.values()) == 10 and len(used) == 5 and sum(used.values()) == 43
    assert sorted(r[2:5] for r in rows if r[1] == 5) == [(0, 0, 10), (1, 10, 10), (2, 20, 3)]


def texts(n, seed=1):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(["bread", "garden", "résumé", "語", "\n", "a", "meeting,"], k=rng.choice([0, 3, 40, 300, 3_000])))) for i in range(n)]


def check(spark, docs, capacity):
    rows = packed(spark.createDataFrame([(*d, 1, 1) for d in docs], DOC), capacity).collect()
    encode = tokenizer(open(TOKENIZER, "rb").read()).encode_ordinary
    pieces, boxes = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append((r["first_token"], r["n_tokens"]))
        boxes.setdefault(r["container_id"], []).append((r["offset"], r["n_tokens"]))
    want = {d: len(encode(t)) for d, t in docs if t is not None}
    assert set(pieces) == set(want)
    for d, n in want.items():
        at = 0
        for first, k in sorted(pieces[d]):
            assert first == at
            at += k
        assert at == n and (len(pieces[d]) == 1) == (n <= capacity)
    for parts in boxes.values():
        at = 0
        for offset, k in sorted(parts):
            assert offset == at
            at += k
        assert at <= capacity
    return sum(want.values()), len(boxes)


def test_every_token_is_in_one_container(spark):
    tokens, boxes = check(spark, texts(400), 2_048)
    assert boxes <= 1.02 * -(-tokens // 2_048) + 4


def test_edges(spark):
    check(spark, [(1, None), (2, ""), (3, ""), (4, "same"), (5, "same"), (6, "word " * 50_000), (7, "x" * 5_000)], 512)
    assert packed(spark.createDataFrame([], DOC)).count() == 0
    copies = packed(spark.createDataFrame([(9, "twice the row", 1, 1)] * 2, DOC))
    assert copies.count() == 2
    report = fill_report(copies).first()
    assert report["n_containers"] == 1 and report["n_tokens"] == 2 * copies.first()["n_tokens"]
