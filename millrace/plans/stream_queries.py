"""Streams run to the end of a table, with the SQL of what they must have given out by then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.streaming.events import event_stream, leases, once_within, run_to_end, sessions, windowed_counts


def _stamp(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*(F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) if c in columns else F.col(c) for c in df.columns))


def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    counts = windowed_counts(event_stream(spark, f"{d}/events.parquet"), "event_type")
    return _stamp(run_to_end(counts), "start", "end").select("event_type", F.col("start").alias("window_start"), "n", F.round("total", 2).alias("total"))


def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    found = run_to_end(sessions(event_stream(spark, f"{d}/events.parquet"), "user_id"))
    return found.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_sessions"), F.sum("n").alias("n_events"), F.max("n").alias("longest"))


def stream_once(spark: SparkSession, d: str) -> DataFrame:
    """Events counted once by id, although the stream has each of them twice."""
    twice = event_stream(spark, f"{d}/events.parquet")
    once = run_to_end(once_within(twice.unionByName(twice), ["event_id"]))
    return once.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_leases(spark: SparkSession, d: str) -> DataFrame:
    """Users' leases of six hours, renewed by every event: how many ran out."""
    events = event_stream(spark, f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), F.lit("worker").alias("holder"), "ts")
    return run_to_end(leases(events, 6 * 3600)).groupBy("key").agg(F.count(F.lit(1)).alias("n_expired"), F.sum("renewals").alias("renewals"))


_SESSIONS = """s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL {0} THEN 0 ELSE 1 END AS new FROM events)),
g AS (SELECT user_id, k, count(*) AS n, max(ts) AS last FROM s GROUP BY ALL), closed AS (SELECT * FROM g WHERE last + INTERVAL {0} <= (SELECT max(ts) FROM events) - INTERVAL {1})"""


def queries() -> dict:
    return {f.__name__: f for f in (stream_windows, stream_sessions, stream_once, stream_leases)}


def oracle_sql() -> dict[str, str]:
    return {
        "stream_windows": """WITH w AS (SELECT event_type, date_trunc('day', ts) AS s, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL)
SELECT event_type, strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, n, total FROM w WHERE s + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR""",
        "stream_sessions": "WITH " + _SESSIONS.format("30 MINUTE", "1 HOUR") + " SELECT user_id, count(*) AS n_sessions, sum(n)::BIGINT AS n_events, max(n) AS longest FROM closed GROUP BY user_id",
        "stream_once": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
        "stream_leases": "WITH " + _SESSIONS.format("6 HOUR", "10 SECOND") + " SELECT user_id::VARCHAR AS key, count(*) AS n_expired, sum(n - 1)::BIGINT AS renewals FROM closed GROUP BY user_id",
    }
