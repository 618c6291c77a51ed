from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.streaming.events import event_stream, leases, once_within, run_to_end, sessions, windowed_counts

START = datetime(2024, 1, 1)


def stream(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts timestamp, user string, value double").coalesce(1).write.parquet(str(path))
    return event_stream(spark, str(path))


def test_windows_sessions_and_repeats(spark, tmp_path):
    rows = [(i % 40, START + timedelta(minutes=10 * (i % 40)), "ab"[i % 2], 1.0) for i in range(80)]
    events = stream(spark, tmp_path / "e", rows)
    counts = run_to_end(windowed_counts(events, "user", "1 hour", late="10 minutes"), str(tmp_path / "w")).collect()
    # The last time is 06:30, the watermark 06:20: six whole hours are out, for two users.
    assert len(counts) == 12 and sum(r["n"] for r in counts) == 72 and max(r["end"] for r in counts) == START + timedelta(hours=6)
    assert run_to_end(once_within(events, ["event_id"], "1 day"), str(tmp_path / "o")).count() == 40
    assert run_to_end(sessions(events, "user", "15 minutes", "1 minute"), str(tmp_path / "s")).count() == 38


def test_leases(spark, tmp_path):
    at = lambda s: START + timedelta(seconds=s)
    rows = [(1, at(0), "a|w1", 0.0), (2, at(50), "a|w1", 0.0), (3, at(60), "a|w2", 0.0), (4, at(200), "a|w2", 0.0), (5, at(10), "b|w1", 0.0), (6, at(10_000), "c|w9", 0.0)]
    events = stream(spark, tmp_path / "l", rows).select(F.split("user", r"\|")[0].alias("key"), F.split("user", r"\|")[1].alias("holder"), "ts")
    got = sorted((r["key"], r["holder"], r["renewals"], r["until"]) for r in run_to_end(leases(events, 100), str(tmp_path / "x")).collect())
    assert got == [("a", "w1", 1, at(150)), ("a", "w2", 0, at(300)), ("b", "w1", 0, at(110))]
