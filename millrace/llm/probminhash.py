"""Near-duplicate records with small edits.

Every record is a weighted set of shingles. ProbMinHash lets each shingle arrive at random registers of the signature
as a Poisson process whose rate is the shingle's weight; a register keeps its first arrival, and a shingle stops as soon
as its next arrival would come after every register's. Two signatures agree in a register with the probability Jaccard
similarity of the sets. Bands of registers give candidates, which are verified exactly on the shingle sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.words import mix, words
from millrace.plans.session import cut_lineage, written

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def signatures(offsets: np.ndarray, shingles: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures of many sets at once: (sets, registers) of shingle hashes.

    Set i has ``shingles[offsets[i]:offsets[i + 1]]``, each once, with positive weights. Arrivals are functions of the
    shingle's hash and its arrival number alone, so equal shingles arrive alike in every set and task.
    """
    n = len(offsets) - 1
    first = np.full(n * registers, np.inf)
    who = np.zeros(n * registers, np.uint64)
    item = shingles.astype(np.uint64)
    owner = np.repeat(np.arange(n), np.diff(offsets))
    base = owner * registers
    # The process of a shingle at unit rate is the same in every set: it is drawn once for each distinct shingle.
    distinct, which = np.unique(item, return_inverse=True)
    seed, clock = mix(distinct), np.zeros(len(distinct))
    pace = 1.0 / weights.astype(np.float64)
    steady = bool(len(pace)) and bool((pace == pace[0]).all())
    live = np.arange(len(item))
    last = np.full(n, np.inf)
    k = 0
    while len(live):
        k += 1
        with np.errstate(over="ignore"):
            draw = mix(seed + np.uint64(k) * _GOLDEN)
            register = (mix(draw + np.uint64(1)) % np.uint64(registers)).astype(np.int64)
        clock -= np.log1p(-((draw >> np.uint64(11)).astype(np.float64) * 2.0**-53))
        kind = which[live]
        at = clock[kind] * (pace[0] if steady else pace[live])
        if k > 8:
            stay = at < last[owner[live]]
            live, kind, at = live[stay], kind[stay], at[stay]
            if not len(live):
                break
        slot = base[live] + register[kind]
        np.minimum.at(first, slot, at)
        won = np.flatnonzero(first[slot] == at)
        who[slot[won]] = item[live[won]]
        if k >= 8 and k % 4 == 0:  # the bound may be stale: it only falls
            last = first.reshape(n, registers).max(axis=1)
    return who.reshape(n, registers)


def rows_for(n: int) -> int:
    """Registers a band for n sets: one more for ten times the sets. Each divides the sets that meet by chance by about
    three and nearly doubles the signatures' work; what is missed at most is the same for all."""
    return max(4, math.ceil(math.log10(max(n, 1) / 200_000)) + 4)


def choose_bands(similarity: float, miss: float = 2e-4, rows: int = 5) -> tuple[int, int]:
    """Bands and rows a band, so that a pair at the threshold is missed with at most the given probability."""
    return math.ceil(math.log(miss) / math.log(1 - similarity**rows)), rows


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted hashes with repeats as distinct shingles, their numbers as weights, and a unit for each: the n-th copy of a
    shingle is the same unit in every set, so weighted Jaccard similarity is that of the sets of units."""
    for whole in batches:
        for start in range(0, whole.num_rows, 4096):
            batch = whole.slice(start, 4096)
            lists = batch.column("hashes")
            offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            flat = lists.flatten().to_numpy()
            first = np.zeros(len(flat), bool)
            first[1:] = flat[1:] != flat[:-1]
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            at = np.flatnonzero(first)
            count = np.diff(np.r_[at, len(flat)])
            nth = np.arange(len(flat)) - np.repeat(at, count)
            with np.errstate(over="ignore"):
                units = np.where(nth > 0, mix(flat.view(np.uint64) + nth.astype(np.uint64) * _GOLDEN).view(np.int64), flat)
            ends = np.r_[0, np.cumsum(first)][offsets].astype(np.int32)
            lists_of = lambda o, v: pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v))
            yield pa.RecordBatch.from_arrays([batch.column("id"), lists_of(ends, flat[at]), lists_of(ends, count.astype(np.int64)), lists_of(offsets, units)], names=["id", "shingles", "weights", "units"])


def _bander(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 4096):
                batch = whole.slice(start, 4096)
                sets = batch.column("shingles")
                offsets = sets.offsets.to_numpy() - sets.offsets[0].as_py()
                items = sets.flatten().to_numpy().view(np.uint64)
                n = batch.num_rows
                weighted = "weights" in batch.schema.names
                weights = batch.column("weights").flatten().to_numpy() if weighted else np.ones(len(items))
                table = signatures(offsets, items, weights, bands * rows).reshape(n, bands, rows)
                if weighted:
                    sets = batch.column("units")
                    offsets = sets.offsets.to_numpy() - sets.offsets[0].as_py()
                    items = sets.flatten().to_numpy().view(np.uint64)
                key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=np.uint64)), (n, bands)).copy()
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = mix(key * np.uint64(31) + table[:, :, r])
                # A bitmap of the shingles: two sets differ in at least as many elements as their bitmaps do in bits.
                bit = mix(items ^ np.uint64(0xABCDEF)) & np.uint64(127)
                bitmap = np.zeros((n, 2), np.uint64)
                np.bitwise_or.at(bitmap, (np.repeat(np.arange(n), np.diff(offsets)), (bit >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (bit & np.uint64(63)))
                size = np.diff(offsets).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), bands)), pa.array(np.repeat(size, bands))]
                    + [pa.array(np.repeat(bitmap[:, i], bands).view(np.int64)) for i in range(2)],
                    names=["band", "id", "size", "b0", "b1"],
                )

    return run


#: Sets of one band that are compared in one task; the pairs of more crowded bands come from a salted join.
CROWD = 1_024
#: Pairs that a task holds before it hands them on.
PAIRS_HELD = 200_000
_BAND = ["band", "id", "size", "b0", "b1"]


def _pairer(similarity: float, crowd: int):
    """Over rows sorted by band: pairs of sets that share a band and can reach the similarity, and crowded bands' rows."""

    def pairs(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        band, ids, size, b0, b1 = rows
        start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
        n = np.diff(np.r_[start, len(band)])
        crowded = np.repeat(n > crowd, n)
        if crowded.any():
            kept = [c[crowded] for c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in kept] + [pa.nulls(len(kept[0]), pa.int64())] * 2, names=[*_BAND, "id_a", "id_b"])
        # Pairs as one number: the sets of these rows, counted in order of their ids.
        known, which = np.unique(ids, return_inverse=True)
        b0, b1 = b0.view(np.uint64), b1.view(np.uint64)  # of signed numbers NumPy counts the bits of the absolute value
        # A pair of sizes m and n whose bitmaps differ in d bits has at most (m + n - d) / 2 elements in common.
        share = (1 - similarity) / (1 + similarity) + 1e-9

        def flush(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            code = np.unique(np.concatenate(found))
            none = [pa.nulls(len(code), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(known[code // len(known)]), pa.array(known[code % len(known)])], names=[*_BAND, "id_a", "id_b"])

        # The d-th neighbour of every row inside its band, for all bands at once: no pair is made twice.
        end = np.repeat(start + n, n)
        live = np.flatnonzero(~crowded)
        found: list[np.ndarray] = []
        held, d = 0, 1
        while len(live := live[live + d < end[live]]):
            other = live + d
            differ = np.bitwise_count(b0[live] ^ b0[other]).astype(np.int32) + np.bitwise_count(b1[live] ^ b1[other])
            ok = differ <= (size[live] + size[other]) * share
            x, y = which[live[ok]], which[other[ok]]
            found.append(np.minimum(x, y) * len(known) + np.maximum(x, y))
            held += len(x)
            if held > PAIRS_HELD:
                yield from flush(found)
                found, held = [], 0
            d += 1
        if held:
            yield from flush(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[list[np.ndarray]] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(c).to_numpy() for c in _BAND]
            columns[2] = columns[2].astype(np.int32)
            waiting.append(columns)
            held += batch.num_rows
            if held >= 200_000:
                rows = [np.concatenate(c) for c in zip(*waiting)]
                # The last band may go on in the next batch. One that fills everything is crowded: its rows go out as they come.
                cut = int(np.searchsorted(rows[0] == rows[0][-1], True)) if rows[0][0] != rows[0][-1] else 0
                if cut:
                    yield from pairs([c[:cut] for c in rows])
                    rows = [c[cut:] for c in rows]
                waiting, held = [rows], len(rows[0])
                if held >= 200_000:
                    band = rows[0][0]
                    for kept in rows_of_one_band(batches, rows, band):
                        if isinstance(kept, pa.RecordBatch):
                            yield kept
                        else:
                            waiting, held = ([kept], len(kept[0])) if len(kept[0]) else ([], 0)
        if held:
            yield from pairs([np.concatenate(c) for c in zip(*waiting)])

    def rows_of_one_band(batches: Iterator[pa.RecordBatch], rows: list[np.ndarray], band: int) -> Iterator[pa.RecordBatch | list[np.ndarray]]:
        """Give out the rows of a very crowded band without holding them, then what follows it."""
        while True:
            mine = int((rows[0] == band).sum())
            if mine:
                yield pa.RecordBatch.from_arrays([pa.array(c[:mine]) for c in rows] + [pa.nulls(mine, pa.int64())] * 2, names=[*_BAND, "id_a", "id_b"])
            if mine < len(rows[0]):
                yield [c[mine:] for c in rows]
                return
            batch = next(batches, None)
            if batch is None:
                yield [c[mine:] for c in rows]
                return
            rows = [batch.column(c).to_numpy() for c in _BAND]
            rows[2] = rows[2].astype(np.int32)

    return run


def similar_sets(sets: DataFrame, similarity: float, miss: float = 2e-4, rows: int | None = None) -> DataFrame:
    """Pairs (id_a, id_b, similarity), id_a < id_b, of sets with at least the given Jaccard similarity.

    sets: id BIGINT unique, shingles ARRAY<BIGINT> distinct hashes; of weighted sets also weights ARRAY<BIGINT> and units
    ARRAY<BIGINT>, as ``word_sets`` makes them: their similarity is weighted Jaccard similarity, the sum of the smaller
    weights by that of the larger ones. It is never above the probability Jaccard similarity by which signatures agree,
    so the bands miss no more of it. A pair is found through ProbMinHash bands with
    probability 1 - ``miss`` at the threshold and more above it, whatever ``rows`` (see ``rows_for``). Empty sets are in no pair. The bands are shuffled once;
    the sets of a band are compared by size and bitmap, whose bound on the similarity is safe, so only pairs that can
    reach the threshold leave the task. A band that very many different sets share leaves it too and is joined with
    itself on a salt, so no task compares a crowd.
    """
    bands, size = choose_bands(similarity, miss, rows or rows_for(sets.count()))
    keyed = sets.select("id", "shingles", *(["weights", "units"] if "units" in sets.columns else [])).filter(F.size("shingles") > 0).mapInArrow(_bander(bands, size), "band long, id long, size int, b0 long, b1 long")
    met = written(keyed.repartition("band").sortWithinPartitions("band").mapInArrow(_pairer(similarity, CROWD), "band long, id long, size int, b0 long, b1 long, id_a long, id_b long"))
    crowd = met.filter("band is not null").select(*_BAND)
    salts = crowd.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / CROWD).cast("int").alias("salts"))
    shared = crowd.join(salts, "band")
    left = shared.withColumn("salt", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int"))
    right = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    differ = sum((F.bit_count(F.col(f"a.b{i}").bitwiseXOR(F.col(f"b.b{i}"))) for i in range(2)), F.lit(0))
    total = F.col("a.size") + F.col("b.size")
    salted = left.alias("a").join(
        right.alias("b"), (F.col("a.band") == F.col("b.band")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.id") < F.col("b.id")) & ((total - differ) >= (total + differ) * F.lit(similarity - 1e-9))
    ).select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"))
    candidates = met.filter("id_a is not null").select("id_a", "id_b").unionAll(salted).distinct()
    units = "units" if "units" in sets.columns else "shingles"
    one = lambda s: sets.select(F.col("id").alias(f"id_{s}"), F.col(units).alias(f"s_{s}"))
    common = F.size(F.array_intersect("s_a", "s_b"))
    score = common / (F.size("s_a") + F.size("s_b") - common)
    return candidates.join(one("a"), "id_a").join(one("b"), "id_b").select("id_a", "id_b", score.alias("similarity")).filter(F.col("similarity") >= similarity - 1e-12)


def word_sets(rows: DataFrame, text: Column, shingle_words: int = 1, weighted: bool = False) -> DataFrame:
    """(id, set_key, shingles[, weights, units]): the shingles of each row's text as hashes, and a key of the whole set.

    A text of fewer words than a shingle is one shingle of all its words; one without words has none. Null is empty.
    ``weighted``: a shingle weighs as often as it occurs, and each occurrence is a unit; the key is that of the units.
    """
    w = words(text)
    if shingle_words > 1:
        k = shingle_words
        w = F.when(F.size(w) <= k, F.filter(F.array(F.array_join(w, " ")), lambda x: x != "")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(w) - k, F.lit(0))), lambda i: F.array_join(F.slice(w, i + 1, k), " ")))
    hashes = F.transform(w, lambda x: F.xxhash64(x))
    if weighted:
        kind = dict(rows.dtypes)["id"]
        counted = rows.select("id", F.sort_array(hashes).alias("hashes")).mapInArrow(_counted, f"id {kind}, shingles array<long>, weights array<long>, units array<long>")
        return counted.withColumn("set_key", F.xxhash64("units", F.lit(5)))
    return rows.select("id", F.sort_array(F.array_distinct(hashes)).alias("shingles")).withColumn("set_key", F.xxhash64("shingles", F.lit(5)))


def near_duplicates(rows: DataFrame, text: Column, similarity: float = 0.8, shingle_words: int = 5, weighted: bool = False) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate records: membership (id, set_id) and pairs of sets (set_a, set_b, similarity).

    Rows with equal shingle sets are one set, named by its smallest id, so a text copied a million times is compared
    once. Rows without words are members of no set. Repeated ids, ties and nulls are defined as in ``word_sets``, and so
    is ``weighted``, with which shingles that occur more often count for more.
    """
    # Filtered behind the table: before it, the filter would make every text's shingles a second time.
    keyed = written(word_sets(rows, text, shingle_words, weighted)).filter(F.size("shingles") > 0)
    representatives = keyed.groupBy("set_key").agg(F.min("id").alias("set_id"))
    members = keyed.select("id", "set_key").join(representatives, "set_key").select("id", "set_id")
    sets = keyed.join(representatives.select(F.col("set_id").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]).drop("set_key")
    pairs = similar_sets(written(sets), similarity)
    return members, pairs.select(F.col("id_a").alias("set_a"), F.col("id_b").alias("set_b"), "similarity")


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs of rows (id_a, id_b), id_a < id_b: of rows in one set, and of rows in paired sets."""
    both = pairs.select("set_a", "set_b").unionAll(members.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("set_id", "set_id"))
    one = lambda s: members.select(F.col("id").alias(f"id_{s}"), F.col("set_id").alias(f"set_{s}"))
    met = both.join(one("a"), "set_a").join(one("b"), "set_b").filter((F.col("set_a") != F.col("set_b")) | (F.col("id_a") < F.col("id_b")))
    return met.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))


def groups(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, group_id): connected components over the links between sets, a row's group named by its smallest member.

    Each round takes every set's smallest label among its neighbours and then jumps along labels, so a chain of n links
    takes about log n rounds; the rounds stop when nothing changes. Labels never leave the cluster.
    """
    pairs = cut_lineage(pairs)
    edges = cut_lineage(pairs.select(F.col("set_a").alias("u"), F.col("set_b").alias("v")).unionAll(pairs.select("set_b", "set_a")).distinct())
    labels = cut_lineage(edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("label")))
    while True:  # labels only fall, so this ends
        seen = edges.join(labels.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        low = labels.join(seen, "u").select("u", F.least("label", "near").alias("low"))
        new = cut_lineage(low.join(labels.select(F.col("u").alias("low"), F.col("label").alias("jump")), "low", "left").select("u", F.least(F.col("low"), F.coalesce("jump", "low")).alias("label")))
        settled = new.join(labels.withColumnRenamed("label", "old"), "u").filter("label <> old").isEmpty()
        labels = new
        if settled:
            break
    return members.join(labels.withColumnRenamed("u", "set_id"), "set_id", "left").select("id", F.coalesce("label", "set_id").alias("group_id"))
