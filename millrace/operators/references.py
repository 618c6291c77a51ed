"""References to records that do not exist.

Parent keys and the distinct keys that are referred to go through one range partitioning, so every range of keys
meets its own references. In a range the parents are kept as a sorted array, and batches of references are looked up
in it by binary search. Only keys with a finding return to the references, so a clean hot key costs one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import utc_timestamp
from millrace.plans.session import cut_lineage

_PARENT, _DELETED, _PROBE = 0, 1, 2


#: Bytes up to which keys are held in arrays of one width.
_NARROW = 128


def _keys(strings: pa.Array) -> np.ndarray:
    """Byte keys in the order of code points; the last byte keeps trailing NULs significant. Short keys have one width;
    where one is long, all are held as they are, so that it doesn't make the others as wide."""
    keys = [x.encode() + b"\x01" for x in strings.to_pylist()]
    if not keys:
        return np.empty(0, "S1")
    if max(map(len, keys)) <= _NARROW:
        return np.array(keys, dtype="S")
    out = np.empty(len(keys), object)
    out[:] = keys
    return out


def _find(sorted_keys: np.ndarray, probes: np.ndarray) -> np.ndarray:
    """Position of each probe in the array, or -1."""
    if not len(sorted_keys):
        return np.full(len(probes), -1)
    if sorted_keys.dtype != object and probes.dtype == object:
        sorted_keys = sorted_keys.astype(object)
    elif sorted_keys.dtype == object:
        probes = probes.astype(object)
    at = np.minimum(np.searchsorted(sorted_keys, probes), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == probes, at, -1)


def _probe_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over one range, sorted so that parents come first: yield the referenced keys that have a finding."""
    parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {_PARENT: [], _DELETED: []}
    ready = None
    for batch in batches:
        tag = batch.column("tag").to_numpy()
        time = batch.column("t").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
        for kind in (_PARENT, _DELETED):
            rows = np.flatnonzero(tag == kind)
            if len(rows):
                parts[kind].append((_keys(batch.column("key").take(pa.array(rows))), time[rows]))
        rows = np.flatnonzero(tag == _PROBE)
        if not len(rows):
            continue
        if ready is None:
            ready = {}
            for kind, found in parts.items():
                keys = np.concatenate([k for k, _ in found]) if found else np.empty(0, "S1")
                times = np.concatenate([t for _, t in found]) if found else np.empty(0, np.int64)
                order = np.argsort(keys, kind="stable")
                ready[kind] = (keys[order], times[order])
        probes = batch.take(pa.array(rows))
        keys = _keys(probes.column("key"))
        parents, created = ready[_PARENT]
        at = _find(parents, keys)
        deleted = _find(ready[_DELETED][0], keys) >= 0
        made = created[at] if len(created) else np.zeros(len(keys), np.int64)
        late = (at >= 0) & (made > time[rows]) & (time[rows] > np.iinfo(np.int64).min)
        hit = np.flatnonzero((at < 0) | late)
        if len(hit):
            kind = np.where(at < 0, np.where(deleted, "deleted", "missing"), "late")[hit]
            yield pa.RecordBatch.from_arrays(
                [probes.column("key").take(pa.array(hit)), pa.array(kind), pa.array(np.where(at[hit] < 0, 0, made[hit]))],
                names=["key", "kind", "made"],
            )


def _composite(entry: Column, item: Column) -> Column:
    # The length keeps ("a", "b\x1fc") and ("a\x1fb", "c") apart.
    return F.concat_ws("\x1f", F.lit("i"), F.length(entry).cast("string"), entry, item)


def orphan_references(references: DataFrame, entries: DataFrame, deletions: DataFrame, items: DataFrame) -> DataFrame:
    """Distinct references without a valid target: (table_name, row_key, field, kind, period).

    references: table_name, row_key, entry_id, item_id, own_time TIMESTAMP; entries: entry_id, created TIMESTAMP;
    deletions: entry_id; items: entry_id, item_id. Other columns are ignored.

    A null entry_id or item_id is no reference. Ids are compared exactly, the empty string too. An id filed twice
    counts from its earliest time. Where own_time or created is null nothing is late, and a null own_time gives a
    null period. Repeated references give one row. Empty inputs give no rows, and without entries every reference is
    'missing' or 'deleted'.
    """
    refs = references.select("table_name", "row_key", "entry_id", "item_id", "own_time").filter("entry_id is not null").distinct()
    micros = lambda c: F.unix_micros(c)
    entry_key = F.concat(F.lit("e\x1f"), F.col("entry_id"))
    item_key = _composite(F.col("entry_id"), F.col("item_id"))
    row = lambda tag, key, t: [F.lit(tag).cast("byte").alias("tag"), key.alias("key"), t.alias("t")]
    none = F.lit(None).cast("long")
    has_item = F.col("item_id").isNotNull()
    everything = (
        entries.filter("entry_id is not null").groupBy("entry_id").agg(F.min("created").alias("created")).select(*row(_PARENT, entry_key, micros(F.col("created"))))
        .unionAll(deletions.filter("entry_id is not null").select("entry_id").distinct().select(*row(_DELETED, entry_key, none)))
        .unionAll(items.filter("entry_id is not null and item_id is not null").select("entry_id", "item_id").distinct().select(*row(_PARENT, item_key, none)))
        .unionAll(refs.groupBy("entry_id").agg(F.min("own_time").alias("first")).select(*row(_PROBE, entry_key, micros(F.col("first")))))
        .unionAll(refs.filter(has_item).select("entry_id", "item_id").distinct().select(*row(_PROBE, item_key, none)))
    )
    findings = cut_lineage(everything.repartitionByRange("key").sortWithinPartitions("tag").mapInArrow(_probe_range, "key string, kind string, made long"))
    by_entry = findings.filter(F.col("key").startswith("e\x1f"))
    by_item = findings.filter(F.col("key").startswith("i\x1f")).select("key")
    of_entry = (
        refs.withColumn("key", entry_key).join(by_entry, "key")
        .filter((F.col("kind") != "late") | (F.col("made") > micros(F.col("own_time"))))
        .select("table_name", "row_key", F.lit("entry_id").alias("field"), "kind", "own_time")
    )
    gone = by_entry.filter("kind <> 'late'").select(F.col("key").alias("gone"))
    of_item = (
        refs.filter(has_item).withColumn("key", item_key).join(by_item, "key")
        .join(gone, entry_key == F.col("gone"), "left_anti")
        .select("table_name", "row_key", F.lit("item_id").alias("field"), F.lit("missing").alias("kind"), "own_time")
    )
    month = F.date_format(F.to_utc_timestamp("own_time", F.current_timezone()), "yyyy-MM")
    return of_entry.unionAll(of_item).select("table_name", "row_key", "field", "kind", month.alias("period")).distinct()


def references_of(item_vectors: DataFrame, entry_index: DataFrame, jobs: DataFrame) -> DataFrame:
    """The references of the three tables in the form that ``orphan_references`` takes."""
    none = F.lit(None).cast("string")
    return (
        item_vectors.select(F.lit("item_vectors").alias("table_name"), F.concat(F.col("entry_id"), F.lit("/"), F.coalesce("item_id", F.lit(""))).alias("row_key"), "entry_id", "item_id", utc_timestamp(F.col("embedded_at")).alias("own_time"))
        .unionAll(entry_index.select(F.lit("entry_index"), F.col("entry_id"), F.col("entry_id"), none, utc_timestamp(F.col("created_at"))))
        .unionAll(jobs.select(F.lit("jobs"), F.col("job_id"), F.col("entry_id"), none, utc_timestamp(F.col("updated_at"))))
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Misses per table, field, kind and month."""
    return orphans.groupBy("table_name", "field", "kind", "period").agg(F.count(F.lit(1)).alias("n_references"))
