"""Evaluation texts leaking into training text.

Windows of words have SimHash fingerprints of their weighted shingles. A multi-index over blocks of the fingerprints'
bits finds every passage window within a Hamming radius of a document's window, and the exact weighted-shingle
similarity verifies these candidates. There are two sizes of windows: the stretch of a few words that counts as a leak,
and item-sized ones, which find a passage that was altered all over.

One replaced word of ten moves about 8 of 64 bits, so the small windows' radius finds copies and little else. Altered
small windows are found by keys of shared pairs of words: any two windows at or above the similarity have one in common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix, word_hashes

#: Bits by which fingerprints of the stretch's windows and of item-sized windows may differ.
RADIUS, ITEM_RADIUS = 3, 15
#: Widths of item-sized windows: a passage takes the widest that fits, at every half width and at its end. They are one
#: above sums of two powers of two at most, of which ``Fingerprints`` puts windows together.
ITEM_WIDTHS = (17, 25, 33, 49, 65, 97, 129)
#: Passage windows in one block of the item set; a larger set takes further passes over the documents.
WINDOWS_PER_BLOCK = 400_000
#: Keys of a window; a key holds as many pairs of words as that number allows.
MOST_KEYS = 20


def _add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced numbers: list element i holds bit i of 64 counters."""
    out, carry = [], None
    for i in range(max(len(a), len(b))):
        x = a[i] if i < len(a) else None
        y = b[i] if i < len(b) else None
        if x is None or y is None:
            z = x if y is None else y
            out.append(z if carry is None else z ^ carry)
            carry = None if carry is None else z & carry
        else:
            half = x ^ y
            out.append(half if carry is None else half ^ carry)
            carry = (x & y) if carry is None else (x & y) | (carry & half)
    return out if carry is None else [*out, carry]


def _at_least(counts: list[np.ndarray], least: int) -> np.ndarray:
    """Bits whose counter is at least a constant."""
    above = np.zeros_like(counts[0])
    same = np.full_like(counts[0], np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in reversed(range(len(counts))):
        if least >> i & 1:
            same = same & counts[i]
        else:
            above = above | (same & counts[i])
            same = same & ~counts[i]
    return above | same


class Fingerprints:
    """SimHash of windows of word hashes: a bit is set where it is in the larger part of the window's shingles by weight.

    Shingles are words, and pairs of neighbouring words with double weight. The 64 counters of a window are kept
    bit-sliced. A word and the pair it starts are added up first; a window's sum is put together from sums of these over
    powers of two, which all widths share, and its last word.
    """

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.single = mix(words.view(np.uint64) if words.dtype == np.int64 else words)
        both = self.single[:-1]
        self.powers = [_add([both], [np.zeros_like(both), word_pairs(words)])] if self.n > 1 else []

    def windows(self, width: int) -> np.ndarray:
        """Fingerprints of every ``width`` consecutive words."""
        n = self.n - width + 1
        if n <= 0:
            return np.empty(0, np.uint64)
        total, done = [self.single[width - 1 :]], 0
        for k in range((width - 1).bit_length()):
            size = 1 << k
            if k == len(self.powers):
                half = self.powers[-1]
                m = len(half[0]) - size // 2
                self.powers.append(_add([x[:m] for x in half], [x[size // 2 : size // 2 + m] for x in half]))
            if (width - 1) & size:
                total = _add(total, [x[done : done + n] for x in self.powers[k]])
                done += size
        return _at_least(total, (3 * width - 2) // 2 + 1)


class MultiIndex:
    """Fingerprints by blocks of their bits. Two within the radius differ in one of four blocks by a fourth of it at most
    (rounded down), so a fingerprint stands under every value that near to its own, block by block."""

    BLOCKS, BITS = 4, 16

    def __init__(self, fingerprints: np.ndarray, radius: int):
        self.fingerprints, self.radius, self.blocks = fingerprints, radius, []
        near = [sum(1 << b for b in bits) for k in range(radius // self.BLOCKS + 1) for bits in combinations(range(self.BITS), k)]
        for lo in range(0, 64, self.BITS):
            key = (self._key(fingerprints, lo)[:, None] ^ np.array(near, np.int32)).reshape(-1)
            order = np.argsort(key, kind="stable")
            starts = np.searchsorted(key[order], np.arange((1 << self.BITS) + 1))
            self.blocks.append((lo, (order // len(near)).astype(np.int32), starts, np.diff(starts) > 0))

    def _key(self, fingerprints: np.ndarray, lo: int) -> np.ndarray:
        return ((fingerprints >> np.uint64(lo)) & np.uint64((1 << self.BITS) - 1)).astype(np.int32)

    def within(self, probes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (probe, fingerprint) positions within the radius, each once."""
        found = [np.empty(0, np.int64)]
        size = max(len(self.fingerprints), 1)
        for lo, items, starts, filled in self.blocks:
            key = self._key(probes, lo)
            hit = np.flatnonzero(filled[key])
            for s in range(0, len(hit), 100_000):
                part = hit[s : s + 100_000]
                first = starts[key[part]]
                n = starts[key[part] + 1] - first
                row = np.repeat(part, n)
                item = items[np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())]
                near = np.bitwise_count(probes[row] ^ self.fingerprints[item]) <= self.radius
                found.append(row[near] * size + item[near])
        both = np.unique(np.concatenate(found))
        return both // size, both % size


def word_pairs(x: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring words, along the last axis."""
    with np.errstate(over="ignore"):
        return mix(x[..., :-1].astype(np.uint64) * np.uint64(3) + x[..., 1:].astype(np.uint64))


def lost_pairs(width: int, similarity: float) -> int:
    """How many of its ``width - 1`` pairs a window may lack in another at a weighted-shingle similarity, at most."""
    weight = 3 * width - 2
    return (weight - ceil(2 * weight * similarity / (1 + similarity) - 1e-9)) // 2


class SharedPairs:
    """Windows by keys of their pairs of words: two that lack at most ``lost`` pairs of each other share a key at least.

    Of two sorted windows with all but ``lost`` pairs in common, the first k common pairs are among the first
    ``lost + k`` of each. The keys are the sums of every k of these.
    """

    def __init__(self, words: np.ndarray, at: np.ndarray, width: int, lost: int):
        self.n, self.lost = width - 1, lost
        self.k = max((k for k in range(1, self.n - lost + 1) if comb(lost + k, lost) <= MOST_KEYS), default=1)
        keys = [x[at] for x in self._keys(words)]
        item = np.tile(np.arange(len(at)), len(keys))
        key = np.concatenate(keys)
        order = np.lexsort((item, key))
        key, item = key[order], item[order]
        fresh = np.r_[True, (key[1:] != key[:-1]) | (item[1:] != item[:-1])]
        self.size, self.key, self.item = len(at), key[fresh], item[fresh].astype(np.int32)
        bits = min(max(len(self.key).bit_length() + 3, 12), 24)
        self.shift = np.uint64(64 - bits)
        self.starts = np.searchsorted(self.key >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        self.filled = np.diff(self.starts) > 0

    def _keys(self, words: np.ndarray) -> Iterator[np.ndarray]:
        """Each key of every window of consecutive words."""
        pairs = word_pairs(words)
        n, m = len(pairs) - self.n + 1, self.lost + self.k
        if n <= 0:
            return
        if m == self.n:
            parts = [pairs[i : i + n] for i in range(m)]
        else:
            parts = list(np.sort(np.lib.stride_tricks.sliding_window_view(pairs, self.n), axis=1)[:, :m].T.copy())
        total = reduce(np.add, parts)
        for left_out in combinations(parts, self.lost):
            yield reduce(np.subtract, left_out, total)

    def candidates(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window of the words, indexed window) positions with a key in common, each once."""
        found = [np.empty(0, np.int64)]
        for key in self._keys(words):
            bucket = (key >> self.shift).astype(np.int32)
            hit = np.flatnonzero(self.filled[bucket])
            if not len(hit):
                continue
            first = self.starts[bucket[hit]]
            n = self.starts[bucket[hit] + 1] - first
            row = np.repeat(hit, n)
            place = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            same = self.key[place] == key[row]
            found.append(row[same] * self.size + self.item[place[same]])
        both = np.unique(np.concatenate(found))
        return both // self.size, both % self.size


def weighted_shingle_similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Weighted Jaccard similarity, row by row, of windows (rows, width) of word hashes.

    Shingles are words and pairs of neighbouring words, weighted by how often they occur; a pair weighs double.
    """

    def common(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        # The size of the multiset intersection: both sides sorted together, the lowest bit of a hash tells the side.
        z = np.sort(np.concatenate([x.astype(np.uint64) & ~np.uint64(1), y.astype(np.uint64) | np.uint64(1)], axis=1), axis=1)
        value, side = z >> np.uint64(1), (z & np.uint64(1)).astype(np.int64)
        fresh = np.ones(z.shape, bool)
        fresh[:, 1:] = value[:, 1:] != value[:, :-1]
        run = np.flatnonzero(fresh)
        right = np.add.reduceat(side.reshape(-1), run)
        left = np.diff(np.r_[run, z.size]) - right
        return np.bincount(run // z.shape[1], np.minimum(left, right), len(z)).astype(np.int64)

    if not len(a):
        return np.empty(0)
    w = a.shape[1]
    shared = common(mix(a), mix(b)) + 2 * common(word_pairs(a), word_pairs(b))
    return shared / (2 * (w + 2 * (w - 1)) - shared)


class _Passages:
    """Passages of one block and, by width, the places of their windows."""

    def __init__(self, passages: list[tuple[int, np.ndarray]], width: int, item_widths: tuple[int, ...]):
        self.words = np.concatenate([w for _, w in passages])
        self.item_of = np.repeat(np.array([i for i, _ in passages], np.int64), [len(w) for _, w in passages])
        starts = np.cumsum([0] + [len(w) for _, w in passages])
        self.small = np.concatenate([np.arange(s, s + len(w) - width + 1) for s, (_, w) in zip(starts, passages)])
        self.large: dict[int, np.ndarray] = {}
        for wide, longer in zip(item_widths, (*item_widths[1:], None)):
            at = [np.r_[np.arange(s, s + len(w) - wide, wide // 2), s + len(w) - wide] for s, (_, w) in zip(starts, passages) if len(w) >= wide > width and (longer is None or len(w) < longer)]
            if at:
                self.large[wide] = np.concatenate(at)


def _finder(block: Broadcast[list[tuple[int, np.ndarray]]], width: int, similarity: float, item_widths: tuple[int, ...] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _Passages(block.value, width, item_widths or ())
        prints = Fingerprints(own.words)
        levels = [(width, own.small, MultiIndex(prints.windows(width)[own.small], RADIUS))]
        shared = None
        if item_widths is not None:
            levels += [(wide, at, MultiIndex(prints.windows(wide)[at], ITEM_RADIUS)) for wide, at in own.large.items()]
            shared = SharedPairs(own.words, own.small, width, lost_pairs(width, similarity))

        def candidates(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
            """(width, places in the documents' words, places in the passages' words) of windows to be compared."""
            prints = Fingerprints(flat)
            for wide, at, index in levels:
                row, item = index.within(prints.windows(wide))
                yield wide, row, at[item]
            if shared is not None:
                row, item = shared.candidates(flat)
                yield width, row, own.small[item]

        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                batch = whole.slice(start, 512)
                lists = batch.column("words")
                offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                flat = lists.flatten().to_numpy()
                found: dict[tuple[int, int], tuple[float, bool]] = {}
                docs = batch.column("id").to_numpy()
                for wide, row, place in candidates(flat):
                    owner = np.searchsorted(offsets, row, side="right") - 1
                    inside = row + wide <= offsets[owner + 1]  # a window does not run into the next document
                    row, place, owner = row[inside], place[inside], owner[inside]
                    step, many = np.arange(wide), max(1, 400_000 // wide)
                    for s in range(0, len(row), many):
                        a = flat[row[s : s + many, None] + step]
                        b = own.words[place[s : s + many, None] + step]
                        exact = (a == b).all(axis=1)
                        score = np.ones(len(a))
                        if not exact.all():
                            score[~exact] = weighted_shingle_similarity(a[~exact], b[~exact])
                        for k in np.flatnonzero(score >= similarity):
                            pair = (int(docs[owner[s + k]]), int(own.item_of[place[s + k]]))
                            old = found.get(pair, (0.0, False))
                            found[pair] = (max(old[0], float(score[k])), old[1] or bool(exact[k]))
                if found:
                    keys = list(found)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([found[k][0] for k in keys]), pa.array([found[k][1] for k in keys])],
                        names=["doc_id", "item_id", "similarity", "exact"],
                    )

    return run


def leaked_items(documents: DataFrame, items: DataFrame, width: int = 10, similarity: float = 0.8, altered: bool = True, item_widths: tuple[int, ...] = ITEM_WIDTHS) -> DataFrame:
    """Documents with a stretch of an item's passage: (doc_id, item_id, similarity, exact).

    documents: doc_id BIGINT, text; items: item_id BIGINT, passage. A stretch is ``width`` consecutive words. Equal
    windows have equal fingerprints, so every stretch that occurs word by word is found, and has ``exact``. With
    ``altered``, so is every window of ``width`` words whose weighted-shingle similarity to one of the passage's is at
    least ``similarity``, and item-sized windows of that similarity as far as their fingerprints lie within
    ``ITEM_RADIUS`` bits (about 19 of 20 at the similarity itself, more above it). ``similarity`` is the largest found.
    A similarity so low that small windows without a common pair of words reach it is a ValueError. Null and empty texts
    and passages shorter than ``width`` words match nothing. Repeated document ids give one row per pair; a whole text
    is read whatever its length.

    The items are the query set: they go to the tasks in blocks of ``WINDOWS_PER_BLOCK`` windows, each block one pass
    over the documents. Documents are not shuffled.
    """
    if not 0 <= lost_pairs(width, similarity) < width - 1:
        raise ValueError("windows of this width need no pair of words in common to reach the similarity")
    hashed = items.select(F.col("item_id").cast("long").alias("id"), word_hashes(F.col("passage")).alias("words")).filter(F.size("words") >= width)
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), word_hashes(F.col("text")).alias("words"))
    more = max((width, *item_widths))

    def blocks() -> Iterator[list[tuple[int, np.ndarray]]]:
        block: list[tuple[int, np.ndarray]] = []
        room = WINDOWS_PER_BLOCK + more
        for r in hashed.toLocalIterator():
            w = np.array(r["words"], np.int64)
            # An oversized passage is spread over blocks; consecutive parts overlap, so no window is lost.
            for s in range(0, len(w) - width + 1, WINDOWS_PER_BLOCK):
                part = w[s : s + WINDOWS_PER_BLOCK + more - 1]
                if block and room < len(part):
                    yield block
                    block, room = [], WINDOWS_PER_BLOCK + more
                block.append((r["id"], part))
                room -= len(part)
        if block:
            yield block

    schema = "doc_id long, item_id long, similarity double, exact boolean"
    spark = documents.sparkSession
    # The driver holds one block at a time; each is broadcast, of a size that WINDOWS_PER_BLOCK bounds.
    parts = [docs.mapInArrow(_finder(spark.sparkContext.broadcast(b), width, similarity, item_widths if altered else None), schema) for b in blocks()]
    if not parts:
        return spark.createDataFrame([], schema)
    found = reduce(DataFrame.unionAll, parts)
    return found.groupBy("doc_id", "item_id").agg(F.max("similarity").alias("similarity"), F.max("exact").alias("exact"))
