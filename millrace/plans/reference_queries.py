"""Queries over references between the tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import utc_timestamp
from millrace.operators.references import orphan_references, orphan_report, references_of
from millrace.plans.session import load


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    entries = load(spark, d, "entries")
    return orphan_references(
        references_of(load(spark, d, "item_vectors"), load(spark, d, "entry_index"), load(spark, d, "jobs")),
        entries.select("entry_id", utc_timestamp(F.col("meta.created_at")).alias("created")),
        load(spark, d, "entry_deletions"),
        entries.select("entry_id", F.explode("knowledge_items.item_id").alias("item_id")),
    )


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(p5_found(spark, d))


_P5 = """
WITH refs AS (
  SELECT DISTINCT 'item_vectors' AS table_name, entry_id || '/' || item_id AS row_key, entry_id, item_id, embedded_at AS t FROM item_vectors
  UNION ALL SELECT DISTINCT 'entry_index', entry_id, entry_id, NULL, created_at FROM entry_index
  UNION ALL SELECT DISTINCT 'jobs', job_id, entry_id, NULL, updated_at FROM jobs WHERE entry_id IS NOT NULL),
timed AS (SELECT *, CASE WHEN regexp_matches(t, '(Z|[+-]\\d{2}:\\d{2})$') THEN t ELSE t || 'Z' END::TIMESTAMPTZ AS own FROM refs),
ent AS (SELECT DISTINCT entry_id, CASE WHEN regexp_matches(meta.created_at, '(Z|[+-]\\d{2}:\\d{2})$') THEN meta.created_at ELSE meta.created_at || 'Z' END::TIMESTAMPTZ AS created FROM entries),
items AS (SELECT DISTINCT entry_id, unnest(knowledge_items).item_id AS item_id FROM entries),
found AS (
  SELECT table_name, row_key, 'entry_id' AS field, CASE WHEN e.entry_id IS NOT NULL THEN 'late' WHEN d.entry_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS kind, own
  FROM timed r LEFT JOIN ent e ON e.entry_id = r.entry_id LEFT JOIN (SELECT DISTINCT entry_id FROM entry_deletions) d ON d.entry_id = r.entry_id
  WHERE e.entry_id IS NULL OR e.created > r.own
  UNION ALL
  SELECT table_name, row_key, 'item_id', 'missing', own FROM timed r JOIN ent e ON e.entry_id = r.entry_id
  LEFT JOIN items i ON i.entry_id = r.entry_id AND i.item_id = r.item_id WHERE r.item_id IS NOT NULL AND i.item_id IS NULL),
p5 AS (SELECT DISTINCT table_name, row_key, field, kind, strftime(own AT TIME ZONE 'UTC', '%Y-%m') AS period FROM found)
"""


def queries() -> dict:
    return {"p5_found": p5_found, "p5_report": p5_report}


def oracle_sql() -> dict[str, str]:
    return {
        "p5_found": _P5 + "SELECT * FROM p5",
        "p5_report": _P5 + "SELECT table_name, field, kind, period, count(*) AS n_references FROM p5 GROUP BY ALL",
    }
