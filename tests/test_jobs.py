import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from millrace.operators import jobs as J  # noqa: N812
from millrace.streaming.events import answer_events, event_stream, run_to_end, state_machine

START = datetime(2024, 1, 1)
at = lambda s: START + timedelta(seconds=s)


def test_folds_against_the_step_function(spark):
    import random

    rng = random.Random(6)
    names = [*J.QUEUE.events, "unknown"]
    rows = [(f"k{rng.randrange(20)}", i, rng.choice(names)) for i in range(900)] + [("n", 1, None), ("only", 1, "claim")]
    want = {}
    for key, _, event in rows:
        if event:
            state, applied, refused = want.get(key, ("", 0, 0))
            after = J.next_state(J.QUEUE, state, event)
            want[key] = (state, applied, refused + 1) if after is None else (after, applied + 1, refused)
    df = spark.createDataFrame(rows, "key string, seq int, event string")
    assert {r["key"]: (r["state"], r["n_applied"], r["n_refused"]) for r in J.folded_states(df).collect()} == want
    legal = df.select("event", J.legal(F.lit("queued"), F.col("event")).alias("after")).distinct().collect()
    assert {r["event"]: r["after"] for r in legal} == {e: J.next_state(J.QUEUE, "queued", e) for e in {r[2] for r in rows}}


def test_claims_sweeps_recovery_and_clearing(spark):
    jobs = spark.createDataFrame([("b", "queued", at(5)), ("a", "queued", at(5)), ("c", "queued", at(1)), ("d", "running", at(0)), ("e", "queued", None)], "job_id string, status string, created timestamp")
    assert [(r["job_id"], r["nth"]) for r in J.claimed(jobs, "queued", 3).orderBy("nth").collect()] == [("e", 0), ("c", 1), ("a", 2)] and J.claimed(jobs, "failed", 3).count() == 0
    assert {r["job_id"]: r["status"] for r in J.recovered(jobs).collect()}["d"] == "queued"
    rows = [("a", "collecting", at(10), at(99)), ("b", "collecting", at(10), at(20)), ("c", "awaiting_collection", None, at(20)), ("d", "collecting", at(99), None), ("e", "done", at(1), at(1))]
    swept = J.swept(spark.createDataFrame(rows, "job_id string, status string, lease_until timestamp, deadline timestamp"), F.lit(at(50))).collect()
    assert {r["job_id"]: (r["status"], r["cause"]) for r in swept} == {"a": ("awaiting_collection", "lease"), "b": ("failed", "deadline"), "c": ("failed", "deadline"), "d": ("collecting", None), "e": ("done", None)}
    seen = spark.createDataFrame([("a", "done", at(0)), ("b", "done", at(90_000)), ("c", "failed", at(0)), ("d", "queued", at(0)), ("e", "removed", None)], "job_id string, status string, seen timestamp")
    assert {r["job_id"]: r["action"] for r in J.autocleared(seen, F.lit(at(100_000))).collect()} == {"a": "clear", "b": None, "c": "reap", "d": None, "e": None}


def test_outcomes_of_submissions(spark):
    jobs = spark.createDataFrame([("l", "collecting", None), ("q", "queued", None), ("d", "done", "t"), ("f", "failed", None)], "job_id string, status string, collected_at string")
    submits = spark.createDataFrame([(2, "l"), (1, "l"), (3, "q"), (4, "d"), (5, "f"), (6, "x")], "submit_id int, job_id string")
    got = {r["submit_id"]: r["outcome"] for r in J.submit_outcomes(submits, jobs).collect()}
    assert got == {1: "accepted", 2: "already_submitted", 3: "already_submitted", 4: "already_submitted", 5: "not_leased", 6: "not_found"}


def test_state_machine_goes_on_after_a_restart(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")

    def arrive(rows):
        spark.createDataFrame(rows, "key string, event string, ts timestamp").coalesce(1).write.mode("append").parquet(source)
        found = run_to_end(state_machine(event_stream(spark, source), J.QUEUE), folder)
        return sorted((r["key"], r["ts"], r["event"], r["outcome"], r["state"]) for r in found.collect() if r["key"] != "clock")

    first = arrive([("a", "file_fetch", at(0)), ("a", "claim_fetch", at(1)), ("a", "refused", at(2)), ("a", "lease", at(3)), ("b", "file", at(0)), ("b", "finish", at(1)), ("c", "file", at(0)), ("c", "claim", at(1)), ("c", "claim", at(2))])
    assert [x[3:] for x in first if x[0] == "a"] == [("applied", "pending_fetch"), ("applied", "fetching"), ("applied", "awaiting_collection"), ("applied", "collecting")]
    assert [x[3:] for x in first if x[0] == "b"] == [("applied", "queued"), ("refused", "queued")] and [x[3] for x in first if x[0] == "c"] == ["applied", "applied", "repeated"]
    # Another query starts where the first stopped: the lease of a has run out before its submission comes.
    second = arrive([("a", "submit", at(700)), ("a", "lease", at(701)), ("a", "submit", at(702)), ("c", "finish", at(5))])
    assert [(x[1], *x[2:]) for x in second if x[0] == "a"][4:] == [(at(603), None, "timeout", "awaiting_collection"), (at(700), "submit", "refused", "awaiting_collection"), (at(701), "lease", "applied", "collecting"), (at(702), "submit", "applied", "queued")]
    # What is done is cleared a day later by the watermark alone, and the key is new again.
    arrive([("clock", "file", at(100_000))])
    third = arrive([("clock", "file", at(100_001)), ("c", "file", at(100_000))])
    assert [x[2:] for x in third if x[0] == "c"][-2:] == [(None, "timeout", ""), ("file", "applied", "queued")]


def test_answers_are_shown_when_they_are_whole(spark, tmp_path):
    whole = json.dumps({"answer": "So it is.", "cited": ["k"]})
    rows = [("q1", at(0), 0, "chunk", whole[:9], True), ("q1", at(1), 1, "chunk", whole[9:], True), ("q1", at(2), 2, "end", None, True), ("q2", at(0), 0, "chunk", "half", True), ("q2", at(1), 1, "error", "broken off", True)]
    rows += [("q2", at(2), 2, "chunk", "plain text", True), ("q2", at(3), 3, "end", None, True), ("q3", at(0), 0, "chunk", "x", False), ("q3", at(1), 1, "end", None, True), ("q4", at(0), 0, "chunk", "never ends", True)]
    spark.createDataFrame(rows, "question_id string, ts timestamp, n int, kind string, text string, cleared boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = sorted((r["question_id"], r["kind"], r["seq"], r["text"]) for r in run_to_end(answer_events(event_stream(spark, str(tmp_path / "in"))), str(tmp_path / "out")).collect())
    assert got == [("q1", "delta", 0, "So it is."), ("q1", "final", 1, whole), ("q2", "delta", 0, "plain text"), ("q2", "error", 0, "broken off"), ("q2", "final", 1, "plain text"), ("q3", "abstain", 0, None)]
