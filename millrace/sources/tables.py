"""Writing and merging tables without a lake format: a new version beside the old one, then read from there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the last in order; nulls come first. The maximum is taken before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max(F.struct(*order, F.struct(*[c for c in rest if c not in order]).alias("rest"))).alias("x"))
    return best.select(*keys, *(F.col(f"x.{c}") for c in order if c not in keys), *(F.col(f"x.rest.{c}") for c in rest if c not in order)).select(*rows.columns)


def upserted(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """The table with the changes in place of rows of the same key; a null key in the changes inserts."""
    kept = table.join(changes.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(changes)


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The table without the given keys."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


def write_version(rows: DataFrame, path: str, version: int, partition_by: list[str] | None = None) -> str:
    """Write one version of a table and return its folder; a version that exists is replaced as a whole."""
    folder = f"{path}/version={version:08d}"
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(folder)
    return folder
