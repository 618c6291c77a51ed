"""Filling fixed-capacity containers with items.

Documents are measured in tokens and hashed to vectors, which are projected to a few dimensions and put in the order of
a Hilbert curve. Neighbours on the curve are packed together: best fit decreasing over a window of the curve, with
containers that still have room carried on to the next window.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix
from millrace.plans.session import cut_lineage

CAPACITY = 2_048
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the public byte-level BPE vocabularies split text before merging.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
DIMENSIONS, BITS, BUCKETS = 4, 10, 256


@lru_cache(2)
def tokenizer(ranks: bytes):
    """The tokenizer of a vocabulary file's content (token in base64 and rank on each line)."""
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def hashed_vectors(tokens: list[list[int]]) -> np.ndarray:
    """Unit vectors (documents, BUCKETS) of signed hashed token counts, damped by a logarithm."""
    owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    flat = np.fromiter((x for t in tokens for x in t), np.uint64, len(owner))
    code = mix(flat + np.uint64(1))
    bucket = (code % np.uint64(BUCKETS)).astype(np.int64)
    sign = np.where(code >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
    raw = np.bincount(owner * BUCKETS + bucket, sign, len(tokens) * BUCKETS).reshape(-1, BUCKETS)
    raw = np.sign(raw) * np.log1p(np.abs(raw))
    return raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1e-12)


def _measurer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(shared.value).encode_ordinary
        axes = np.random.default_rng(1).standard_normal((BUCKETS, DIMENSIONS))
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                tokens = [encode(t) for t in batch.column("text").to_pylist()]
                x = hashed_vectors(tokens) @ axes
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array([len(t) for t in tokens], pa.int64())] + [pa.array(x[:, i]) for i in range(DIMENSIONS)],
                    names=["doc_id", "n_tokens", *(f"x{i}" for i in range(DIMENSIONS))],
                )

    return run


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (n, dimensions) below 2**bits, by Skilling's transform."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = (key << 1) | (x[i] >> b & 1)
    return key


def _keyer(mean: list[float], spread: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = np.stack([(batch.column(f"x{i}").to_numpy() - mean[i]) / spread[i] for i in range(DIMENSIONS)], axis=1)
            # The logistic curve stands for the normal distribution's: cells of about equal numbers of documents.
            cell = np.clip(((1 << BITS) / (1 + np.exp(-1.702 * z))).astype(np.int64), 0, (1 << BITS) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(hilbert_keys(cell)), batch.column("doc_id"), batch.column("n_tokens")], names=["key", "doc_id", "n_tokens"])

    return run


class Packer:
    """Best fit decreasing over windows, on the free room of the open containers."""

    def __init__(self, capacity: int, carry: int):
        self.capacity, self.carry, self.made = capacity, carry, 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]  # containers by free room
        self.rooms = 0  # bit r is set where a container has room r

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> tuple[int, int]:
        """Container and offset for an item, in the fullest container that it fits in."""
        fit = self.rooms >> size
        if fit:
            room = size + ((fit & -fit).bit_length() - 1)
            box = self.open[room].pop()
            if not self.open[room]:
                self.rooms &= ~(1 << room)
        else:
            room, box = self.capacity, self.new()
        left = room - size
        self.open[left].append(box)
        self.rooms |= 1 << left
        return box, self.capacity - room

    def settle(self) -> None:
        """Close all but the ``carry`` emptiest containers, and all full ones."""
        kept, rooms = 0, 0
        for room in range(self.capacity, -1, -1):
            if room == 0 or kept >= self.carry:
                self.open[room] = []
            elif self.open[room]:
                self.open[room] = self.open[room][: self.carry - kept]
                kept += len(self.open[room])
                rooms |= 1 << room
        self.rooms = rooms


def pack_sizes(items: list[tuple[int, int]], packer: Packer) -> list[tuple[int, int, int, int, int, int]]:
    """One window of (doc_id, n_tokens): rows (container, doc_id, piece, first token, tokens, offset in the container)."""
    cap = packer.capacity
    rows, rest = [], []
    for doc, n in items:
        whole = n // cap if n > cap else 0
        for i in range(whole):
            rows.append((packer.new(), doc, i, i * cap, cap, 0))
        if n - whole * cap or not whole:
            rest.append((n - whole * cap, doc, whole))
    for size, doc, piece in sorted(rest, key=lambda x: -x[0]):
        box, offset = packer.put(size)
        rows.append((box, doc, piece, piece * cap, size, offset))
    return rows


def _filler(capacity: int, window: int, carry: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 40
        packer = Packer(capacity, carry)
        names = ["container_id", "doc_id", "piece", "first_token", "n_tokens", "offset"]
        waiting: list[tuple[int, int]] = []

        def emit(items: list[tuple[int, int]]) -> pa.RecordBatch:
            rows = pack_sizes(items, packer)
            packer.settle()
            columns = list(zip(*rows))
            columns[0] = [first + c for c in columns[0]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)

        for batch in batches:
            waiting += zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist())
            while len(waiting) >= window:
                yield emit(waiting[:window])
                waiting = waiting[window:]
        if waiting:
            yield emit(waiting)

    return run


def packed(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = TOKENIZER, window: int = 4_096, carry: int = 256) -> DataFrame:
    """Containers of documents: (container_id, doc_id, piece, first_token, n_tokens, offset).

    documents: doc_id BIGINT, text. A document of at most ``capacity`` tokens is one piece; a longer one gives full
    pieces, containers of their own, and a rest that is packed like a document. Null texts are left out; an empty text is
    a piece of no tokens. Repeated rows are packed as often as they come. Each range of the curve is packed by itself,
    so up to ``carry`` containers a range stay partly empty, in practice one or two. The vocabulary file is read on the
    driver and sent to the tasks; it has a fixed size.
    """
    spark = documents.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    columns = ", ".join(f"x{i} double" for i in range(DIMENSIONS))
    # Cut here, as the range partitioning below reads its input twice.
    measured = cut_lineage(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null").mapInArrow(_measurer(shared), f"doc_id long, n_tokens long, {columns}"))
    stats = measured.agg(*(F.avg(f"x{i}").alias(f"m{i}") for i in range(DIMENSIONS)), *(F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(DIMENSIONS))).first()
    mean = [stats[f"m{i}"] or 0.0 for i in range(DIMENSIONS)]
    spread = [s if (s := stats[f"s{i}"]) and math.isfinite(s) and s > 1e-9 else 1.0 for i in range(DIMENSIONS)]
    keyed = measured.mapInArrow(_keyer(mean, spread), "key long, doc_id long, n_tokens long")
    schema = "container_id long, doc_id long, piece long, first_token long, n_tokens long, offset long"
    return keyed.repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id").mapInArrow(_filler(capacity, window, carry), schema)


def fill_report(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens, unused share, and the containers that a packing without waste would need."""
    boxes = pieces.groupBy("container_id").agg(F.sum("n_tokens").alias("used"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("n_tokens"), F.max("used").alias("fullest"),
        (1 - F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("unused_share"), F.ceil(F.sum("used") / capacity).alias("least_containers"),
    )
