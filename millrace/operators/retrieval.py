"""Similarity search, ranking and the answer gate.

Queries are a stated set; they are sent to the tasks in blocks of a bounded size, and each task keeps the best k of its
own rows for every query with one matrix product a batch. Only those partial results are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries in one block; more queries take further passes over the vectors.
QUERIES_PER_BLOCK = 2_000
#: Similarities of groups to queries that a task keeps before it hands them on.
CELLS_PER_TASK = 4_000_000


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    """Unit rows of the vectors; zeros for null, unequally long and zero vectors."""
    lists = lists.cast(pa.list_(pa.float64()))
    size = np.diff(lists.offsets.to_numpy())
    good = (size == dim) & ~np.asarray(lists.is_null())
    out = np.zeros((len(lists), dim))
    if good.any():
        flat = lists.filter(pa.array(good)).flatten()
        out[good] = np.nan_to_num(flat.to_numpy(zero_copy_only=False)).reshape(-1, dim)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class _Shared:
    """Which rows share a token with which queries."""

    def __init__(self, tokens: list[list[int] | None]):
        self.n = len(tokens)
        query = np.repeat(np.arange(self.n), [len(t or ()) for t in tokens])
        flat = np.array([x for t in tokens for x in t or ()], np.int64)
        order = np.argsort(flat, kind="stable")
        self.token, self.query = flat[order], query[order]

    def mask(self, lists: pa.Array) -> np.ndarray:
        sizes = np.asarray(lists.value_lengths().fill_null(0))
        row, token = np.repeat(np.arange(len(lists)), sizes), lists.flatten().to_numpy(zero_copy_only=False)
        first = np.searchsorted(self.token, token)
        n = np.searchsorted(self.token, token, side="right") - first
        at = np.repeat(first - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        out = np.zeros((self.n, len(lists)), bool)
        out[self.query[at], np.repeat(row, n)] = True
        return out


class Block(NamedTuple):
    """Queries that go to the tasks together."""

    ids: list[int]
    units: np.ndarray
    kinds: list[int | None] | None
    tokens: list[list[int] | None] | None


def _searcher(shared_block: Broadcast[Block], k: int, floor: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, kinds, tokens = shared_block.value
        kept: list[tuple[np.ndarray, ...]] = []
        names = ["query_id", "id", "similarity", "score"]
        query_ids = np.array(ids)
        shared = None if tokens is None else _Shared(tokens)
        known = None if kinds is None else np.array([x is not None for x in kinds])
        own_kind = None if kinds is None else np.array([x or 0 for x in kinds], np.int64)

        def best(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
            q, i, s, c = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((i, -c, q))
            q, i, s, c = q[order], i[order], s[order], c[order]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
            rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            return tuple(x[rank < k] for x in (q, i, s, c))

        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column("id").to_numpy()
            similarity = units @ _matrix(batch.column("vector"), units.shape[1]).T
            score = similarity * batch.column("weight").to_numpy()
            usable = (query_ids[:, None] != own[None, :]) & (similarity >= floor if floor is not None else True)
            if own_kind is not None:
                kind = batch.column("kind")
                usable &= (own_kind[:, None] == kind.fill_null(0).to_numpy(zero_copy_only=False)[None, :]) & known[:, None] & np.asarray(kind.is_valid())[None, :]
            if shared is not None:
                usable &= shared.mask(batch.column("tokens"))
            ranked = np.where(usable, score, -np.inf)
            # Everything as good as the k-th best stays, so that ties are settled by id afterwards.
            kth = np.partition(ranked, -k, axis=1)[:, -k] if ranked.shape[1] > k else np.full(len(ranked), -np.inf)
            q, i = np.nonzero(usable & (ranked >= kth[:, None]))
            if len(q):
                kept.append((query_ids[q], own[i], similarity[q, i], score[q, i]))
            if len(kept) > 16:
                kept = [best(kept)]
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best(kept)], names=names)

    return run


def _blocks(queries: DataFrame) -> Iterator[Broadcast[Block]]:
    """The queries block by block, with unit vectors. The driver holds one block at a time: each is broadcast, of a size
    that the block's bounds."""
    own = [c for c in ("kind", "tokens") if c in queries.columns]
    rows = queries.select(F.col("id").cast("long"), F.col("vector").cast("array<double>"), *own).toLocalIterator()
    while block := list(islice(rows, QUERIES_PER_BLOCK)):
        vectors = [r["vector"] for r in block]
        dim = max((len(v) for v in vectors if v is not None), default=0) or 1
        units = _matrix(pa.array([v if v is not None else [] for v in vectors], pa.list_(pa.float64())), dim)
        made = Block([r["id"] for r in block], units, *([r[c] for r in block] if c in own else None for c in ("kind", "tokens")))
        yield queries.sparkSession.sparkContext.broadcast(made)


def top_k(queries: DataFrame, vectors: DataFrame, k: int = 6, floor: float | None = None) -> DataFrame:
    """The k best vectors of each query: (query_id, id, similarity, score, rank).

    queries: id, vector; vectors: id, vector and optionally weight DOUBLE, by which the cosine similarity is multiplied
    to the score that ranks; a query doesn't find its own id. Where the queries have a column kind BIGINT, they find only
    rows of that kind, where they have tokens ARRAY<BIGINT>, only rows that share one; null is no kind and no token.
    ``floor`` drops rows below a similarity before ranking. Null, zero and unequally long vectors have similarity 0; ties
    go to the smaller id. No queries, no rows.
    """
    spark = vectors.sparkSession
    weight = F.coalesce(F.col("weight").cast("double"), F.lit(1.0)) if "weight" in vectors.columns else F.lit(1.0)
    own = [F.col(c).cast(t).alias(c) for c, t in (("kind", "long"), ("tokens", "array<long>")) if c in queries.columns]
    rows = vectors.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), weight.alias("weight"), *own)
    schema = "query_id long, id long, similarity double, score double"
    parts = [rows.mapInArrow(_searcher(block, k, floor), schema) for block in _blocks(queries)]
    if not parts:
        return spark.createDataFrame([], schema + ", rank int")
    found = reduce(DataFrame.unionAll, parts)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _grouper(shared_block: Broadcast[Block]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, units, *_ = shared_block.value
        query_ids = np.array(ids)
        best: dict[int | None, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for group, similarity in best.items():
                seen = similarity > -np.inf
                n = int(seen.sum())
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(query_ids[seen]), pa.array([group] * n, pa.int64()), pa.array(similarity[seen])], names=["query_id", "group_id", "similarity"])
            best.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            groups = batch.column("group_id").dictionary_encode(null_encoding="encode")
            codes = groups.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            similarity = units @ _matrix(batch.column("vector"), units.shape[1])[order].T
            similarity[query_ids[:, None] == batch.column("id").to_numpy()[order][None, :]] = -np.inf
            # Every code of the dictionary occurs, so the segments are the groups in the dictionary's order.
            top = np.maximum.reduceat(similarity, np.flatnonzero(np.diff(codes[order], prepend=-1)), axis=1)
            for group, x in zip(groups.dictionary.to_pylist(), top.T):
                best[group] = np.maximum(best[group], x) if group in best else x.copy()
            if len(best) * len(ids) > CELLS_PER_TASK:
                yield from flush()
        yield from flush()

    return run


def best_members(queries: DataFrame, members: DataFrame) -> DataFrame:
    """Similarity of each query to the nearest member of each group: (query_id, group_id, similarity).

    queries: id, vector; members: id, vector, group_id BIGINT. Every member counts, but a query isn't its own member.
    Each task finds the maxima of its rows, and only those are shuffled. Null, zero and unequally long vectors have
    similarity 0.
    """
    rows = members.select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.col("group_id").cast("long").alias("group_id"))
    schema = "query_id long, group_id long, similarity double"
    parts = [rows.mapInArrow(_grouper(b), schema) for b in _blocks(queries)]
    if not parts:
        return members.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionAll, parts).groupBy("query_id", "group_id").agg(F.max("similarity").alias("similarity"))


def gate(ranked: DataFrame, threshold: float = 0.35) -> DataFrame:
    """The ranked rows whose similarity clears the threshold: the cut to k comes first, the gate second."""
    return ranked.filter(F.col("similarity") >= threshold)


def answered(queries: DataFrame, *cleared: DataFrame) -> DataFrame:
    """(query_id, answered): whether anything cleared the gate for a query; else the answer is withheld."""
    hits = reduce(DataFrame.unionAll, [c.select("query_id") for c in cleared]).distinct().withColumn("hit", F.lit(True))
    return queries.select(F.col("id").cast("long").alias("query_id")).join(hits, "query_id", "left").select("query_id", F.coalesce("hit", F.lit(False)).alias("answered"))


def centroids(members: DataFrame) -> DataFrame:
    """Mean vector of each group: (group_id, vector, n). members: group_id, vector; lengths may not differ in a group.

    Sums go by position, so a group of any size is added up before the shuffle.
    """
    cells = members.filter("vector is not null and size(vector) > 0").select("group_id", F.posexplode("vector").alias("pos", "x"))
    mean = cells.groupBy("group_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("group_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda c: c["x"]).alias("vector"), F.max("n").alias("n"))


def group_scores(to_centroid: DataFrame, to_members: DataFrame, k: int = 3) -> DataFrame:
    """Groups ranked for each query by the larger of the centroid's and the best member's similarity, from 0 on.

    to_centroid: query_id, group_id, similarity; to_members: the same, one row per member.
    """
    both = to_centroid.select("query_id", "group_id", F.greatest(F.col("similarity"), F.lit(0.0)).alias("similarity")).unionAll(to_members.select("query_id", "group_id", "similarity"))
    best = both.groupBy("query_id", "group_id").agg(F.max("similarity").alias("similarity"))
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "group_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def recruited(cleared_groups: DataFrame, members: DataFrame, seen: DataFrame) -> DataFrame:
    """Members of the cleared groups that weren't found directly, each by its best group.

    Every member of a cleared group is a row for every query that cleared it; a large group's join is split where AQE
    finds it skewed.

    cleared_groups: query_id, group_id, similarity; members: group_id, id; seen: query_id, id.
    """
    pool = cleared_groups.join(members.select("group_id", "id"), "group_id").join(seen.select("query_id", "id"), ["query_id", "id"], "left_anti")
    best = pool.groupBy("query_id", "id").agg(F.max_by(F.struct("group_id", "similarity"), F.struct(F.col("similarity"), -F.col("group_id"))).alias("x"))
    return best.select("query_id", "id", "x.group_id", "x.similarity")
