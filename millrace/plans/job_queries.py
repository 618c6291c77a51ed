"""Queries of the job table as a queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.times import utc_timestamp
from millrace.operators import jobs as J  # noqa: N812
from millrace.plans.session import load
from millrace.sources.tables import latest
from millrace.streaming.events import answer_events, event_stream, run_to_end

AS_OF = "2025-06-30T00:00:00Z"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    """Every job in its last state."""
    rows = load(spark, d, "jobs").select("job_id", utc_timestamp(F.col("updated_at")).alias("seen"), "phase_index", "status", utc_timestamp(F.col("created_at")).alias("created"), "lease_expires_at", "collection_deadline", "collected_at")
    return latest(rows, ["job_id"], ["seen", "phase_index", "status"])


def job_claims(spark: SparkSession, d: str, n: int = 5) -> DataFrame:
    """The next five of each line, oldest first."""
    jobs = _jobs(spark, d)
    lines = [J.claimed(jobs, state, n).select(F.lit(state).alias("line"), "nth", "job_id") for state in ("queued", "pending_fetch", "awaiting_collection")]
    return lines[0].unionAll(lines[1]).unionAll(lines[2])


def job_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Jobs that a sweep at a fixed time changes. No job of the table is leased: all that wait get a lease of ten minutes
    from their last change, every other one."""
    jobs = _jobs(spark, d).withColumn("leased", (F.col("status") == "awaiting_collection") & F.col("job_id").rlike("[02468ace]$"))
    shaped = jobs.select("job_id", F.when(F.col("leased"), "collecting").otherwise(F.col("status")).alias("status"), F.when(F.col("leased"), F.col("seen") + F.expr("interval 10 minutes")).alias("lease_until"), utc_timestamp(F.col("collection_deadline")).alias("deadline"))
    return J.swept(shaped, F.lit(AS_OF).cast("timestamp")).filter("cause is not null")


def job_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by state after a restart."""
    return J.recovered(_jobs(spark, d)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def job_autoclear(spark: SparkSession, d: str) -> DataFrame:
    """What is cleared a day after a fixed time, and whose files go."""
    return J.autocleared(_jobs(spark, d), F.lit(AS_OF).cast("timestamp")).filter("action is not null")


def job_actions(spark: SparkSession, d: str) -> DataFrame:
    """What each job could be told, and its state afterwards."""
    told = _jobs(spark, d).select("job_id", "status", F.explode(F.array(*(F.lit(x) for x in ("retry", "remove", "clear_finished", "clear_failed", "submit", "claim")))).alias("event"))
    return told.select("job_id", "event", J.legal(F.col("status"), F.col("event")).alias("after")).filter("after is not null")


def job_submits(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes of two submissions for every job, with those that wait leased out, and of one for a job that isn't there."""
    jobs = _jobs(spark, d).withColumn("status", F.when(F.col("status") == "awaiting_collection", "collecting").otherwise(F.col("status")))
    twice = jobs.select(F.explode(F.array(F.concat(F.lit("1-"), "job_id"), F.concat(F.lit("2-"), "job_id"))).alias("submit_id"), "job_id")
    stray = spark.createDataFrame([("1-none", "none")], "submit_id string, job_id string")
    return J.submit_outcomes(twice.unionAll(stray), jobs).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


def job_transitions(spark: SparkSession, d: str) -> DataFrame:
    """State of every user after their events, read as steps of a job: a sign-up files, a view claims, a purchase
    finishes, an error fails, a click tries again."""
    names = {"signup": "file", "view": "claim", "purchase": "finish", "error": "fail", "click": "retry"}
    machine = J.Machine({"file": {"": "queued", "done": "queued"}, "claim": {"queued": "running"}, "finish": {"running": "done"}, "fail": {"running": "failed"}, "retry": {"failed": "queued"}})
    event = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), F.col("event_type"))
    rows = load(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.struct("ts", "event_id").alias("seq"), event.alias("event"))
    return J.folded_states(rows, machine)


def answer_stream(spark: SparkSession, d: str) -> DataFrame:
    """The events table as chunks of answers: a user's events of a kind are one answer, which errors break off."""
    rows = event_stream(spark, f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "end").otherwise("chunk")
    chunks = rows.select(F.col("user_id").cast("string").alias("question_id"), "ts", F.col("event_id").cast("int").alias("n"), kind.alias("kind"), F.substring("event_type", 1, 1).alias("text"), (F.col("user_id") % 5 > 0).alias("cleared"))
    return run_to_end(answer_events(chunks)).groupBy("question_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n_chars"))


_UTC = r"CASE WHEN regexp_matches({0}, '(Z|[+-]\d{{2}}:\d{{2}})$') THEN {0} ELSE {0} || 'Z' END::TIMESTAMPTZ"
_J = "WITH j AS (SELECT *, " + _UTC.format("updated_at") + " AS seen, " + _UTC.format("created_at") + " AS created FROM jobs), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seen DESC, phase_index DESC NULLS LAST, status DESC) AS r FROM j) WHERE r = 1)"
_NOW = "'2025-06-30T00:00:00Z'::TIMESTAMPTZ"


def queries() -> dict:
    return {f.__name__: f for f in (job_claims, job_sweep, job_recovery, job_autoclear, job_actions, job_submits, job_transitions, answer_stream)}


def oracle_sql() -> dict[str, str]:
    return {
        "job_claims": _J + ", c AS (SELECT status AS line, row_number() OVER (PARTITION BY status ORDER BY created, job_id) - 1 AS nth, job_id FROM l WHERE status IN ('queued', 'pending_fetch', 'awaiting_collection')) SELECT * FROM c WHERE nth < 5",
        "job_sweep": _J + f", s AS (SELECT *, status = 'awaiting_collection' AND regexp_matches(job_id, '[02468ace]$') AS leased, coalesce({_UTC.format('collection_deadline')} < {_NOW}, false) AS late FROM l)"
        f" SELECT job_id, CASE WHEN late THEN 'failed' ELSE 'awaiting_collection' END AS status, CASE WHEN late THEN 'deadline' ELSE 'lease' END AS cause FROM s WHERE status = 'awaiting_collection' AND (late OR leased AND seen + INTERVAL 10 MINUTE < {_NOW})",
        "job_recovery": _J + " SELECT CASE status WHEN 'running' THEN 'queued' WHEN 'fetching' THEN 'pending_fetch' ELSE status END AS status, count(*) AS n FROM l GROUP BY 1",
        "job_autoclear": _J + f" SELECT job_id, status, CASE WHEN status = 'failed' THEN 'reap' ELSE 'clear' END AS action FROM l WHERE status IN ('done', 'low_value', 'removed', 'failed') AND seen < {_NOW} - INTERVAL 1 DAY",
        "job_actions": _J + """ SELECT job_id, e.event, CASE WHEN e.event IN ('retry', 'submit') THEN 'queued' WHEN e.event = 'remove' THEN 'removed' WHEN e.event = 'claim' THEN 'running' ELSE '' END AS after FROM l, (VALUES ('retry'), ('remove'), ('clear_finished'), ('clear_failed'), ('submit'), ('claim')) e(event)
WHERE e.event = 'retry' AND status = 'failed' OR e.event = 'remove' AND status IN ('queued', 'pending_fetch', 'awaiting_collection') OR e.event = 'clear_finished' AND status IN ('done', 'low_value', 'removed') OR e.event = 'clear_failed' AND status = 'failed' OR e.event = 'submit' AND status = 'collecting' OR e.event = 'claim' AND status = 'queued'""",
        "job_submits": _J + """, o AS (SELECT CASE WHEN status = 'queued' OR collected_at IS NOT NULL THEN 'already_submitted' WHEN status <> 'awaiting_collection' THEN 'not_leased' WHEN k = 1 THEN 'accepted' ELSE 'already_submitted' END AS outcome FROM l, range(1, 3) t(k) UNION ALL SELECT 'not_found')
SELECT outcome, count(*) AS n FROM o GROUP BY outcome""",
        "job_transitions": """WITH RECURSIVE e AS (SELECT user_id, event_type AS e, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s(user_id, r, state, applied) AS (SELECT DISTINCT user_id, 0::BIGINT, '', 0::BIGINT FROM e UNION ALL
 SELECT s.user_id, e.r, coalesce(CASE WHEN e = 'signup' AND state IN ('', 'done') THEN 'queued' WHEN e = 'view' AND state = 'queued' THEN 'running' WHEN e = 'purchase' AND state = 'running' THEN 'done' WHEN e = 'error' AND state = 'running' THEN 'failed' WHEN e = 'click' AND state = 'failed' THEN 'queued' END, state),
 applied + CASE WHEN e = 'signup' AND state IN ('', 'done') OR e = 'view' AND state = 'queued' OR e IN ('purchase', 'error') AND state = 'running' OR e = 'click' AND state = 'failed' THEN 1 ELSE 0 END FROM s JOIN e ON e.user_id = s.user_id AND e.r = s.r + 1)
SELECT user_id::VARCHAR AS key, arg_max(state, r) AS state, max(applied) AS n_applied, max(r) - max(applied) AS n_refused FROM s GROUP BY user_id""",
        "answer_stream": """WITH e AS (SELECT user_id, event_type AS t, ts, event_id, count(*) FILTER (event_type IN ('error', 'purchase')) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS g FROM events),
a AS (SELECT user_id, g, count(*) FILTER (t NOT IN ('error', 'purchase')) AS n, max(t) FILTER (t IN ('error', 'purchase')) AS stop FROM e GROUP BY ALL),
o AS (SELECT user_id, 'error' AS kind, 1 AS c FROM a WHERE stop = 'error' UNION ALL SELECT user_id, 'abstain', 0 FROM a WHERE stop = 'purchase' AND user_id % 5 = 0 UNION ALL SELECT user_id, 'final', n FROM a WHERE stop = 'purchase' AND user_id % 5 > 0 UNION ALL SELECT user_id, 'delta', n FROM a WHERE stop = 'purchase' AND user_id % 5 > 0 AND n > 0)
SELECT user_id::VARCHAR AS question_id, kind, count(*) AS n, sum(c)::BIGINT AS n_chars FROM o GROUP BY ALL""",
    }
