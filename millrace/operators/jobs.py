"""A queue as a table: keyed state machines, claims in order of arrival, leases, deadlines and clearing.

What a key may do next is a table of transitions, given as data. ``next_state`` is one step of it; batches fold a key's
events in order, and ``millrace.streaming.events.state_machine`` does the same over a stream.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Machine:
    """Transitions of a state machine. events: name to ({states before: state after}); "" is the state of a new key."""

    events: dict[str, dict[str, str]]
    #: Seconds after which a state falls back or goes on by itself: state to (seconds, state after).
    timeouts: dict[str, tuple[float, str]] = field(default_factory=dict)


# The states of filing, fetching ahead and collecting, and what leads from one to the other.
QUEUE = Machine(
    {
        "file": {"": "queued"}, "file_fetch": {"": "pending_fetch"}, "claim": {"queued": "running"}, "finish": {"running": "done"}, "reject": {"running": "low_value"},
        "fail": {"running": "failed", "fetching": "failed", "collecting": "failed"}, "claim_fetch": {"pending_fetch": "fetching"}, "fetched": {"fetching": "queued"},
        "refused": {"fetching": "awaiting_collection", "running": "awaiting_collection"}, "lease": {"awaiting_collection": "collecting"}, "submit": {"collecting": "queued"},
        "retry": {"failed": "queued"}, "remove": {"queued": "removed", "pending_fetch": "removed", "awaiting_collection": "removed"},
        "restart": {"running": "queued", "fetching": "pending_fetch"}, "clear_finished": {"done": "", "low_value": "", "removed": ""}, "clear_failed": {"failed": ""},
    },
    {"collecting": (600.0, "awaiting_collection"), "done": (86_400.0, ""), "low_value": (86_400.0, ""), "removed": (86_400.0, "")},
)
FINISHED = ("done", "low_value", "removed")


def next_state(machine: Machine, state: str, event: str) -> str | None:
    """The state after an event, or null where it isn't legal."""
    return machine.events.get(event, {}).get(state)


def legal(state: Column, event: Column, machine: Machine = QUEUE) -> Column:
    """The state after an event as a column, null where it isn't legal."""
    moves = [F.lit(x) for name, steps in machine.events.items() for before, after in steps.items() for x in (f"{name}\x1f{before}", after)]
    return F.try_element_at(F.create_map(*moves), F.concat_ws("\x1f", event, state))


def folded_states(events: DataFrame, machine: Machine = QUEUE) -> DataFrame:
    """(key, state, n_applied, n_refused) after all events of each key. events: key STRING, seq (orderable), event STRING.

    An event that isn't legal in its state is refused and changes nothing. A key's events are one array, so a key has as
    many as fit in a row.
    """
    moves = {f"{name}\x1f{before}": after for name, steps in machine.events.items() for before, after in steps.items()}
    table = F.create_map(*(F.lit(x) for pair in moves.items() for x in pair))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("seq", "event"))), lambda x: x["event"])
    start = F.struct(F.lit("").alias("state"), F.lit(0).cast("long").alias("applied"), F.lit(0).cast("long").alias("refused"))

    def step(acc: Column, event: Column) -> Column:
        after = F.try_element_at(table, F.concat_ws("\x1f", event, acc["state"]))
        return F.struct(F.coalesce(after, acc["state"]).alias("state"), (acc["applied"] + after.isNotNull().cast("long")).alias("applied"), (acc["refused"] + after.isNull().cast("long")).alias("refused"))

    rows = events.filter("event is not null").groupBy("key").agg(ordered.alias("events")).select("key", F.aggregate("events", start, step).alias("x"))
    return rows.select("key", "x.state", F.col("x.applied").alias("n_applied"), F.col("x.refused").alias("n_refused"))


def claimed(jobs: DataFrame, state: str, n: int) -> DataFrame:
    """The n oldest jobs in a state, to be handed out: (job_id, nth). jobs: job_id, status, created TIMESTAMP.

    Only each task's n oldest are compared. Jobs without a time come first, ties go to the smaller id.
    """
    best = jobs.filter(F.col("status") == state).select("created", "job_id").orderBy("created", "job_id").limit(n)
    ordered = F.array_sort(F.collect_list(F.struct(F.col("created").isNotNull().alias("timed"), "created", "job_id")))
    return best.agg(ordered.alias("all")).select(F.posexplode("all").alias("nth", "x")).select("x.job_id", F.col("nth").cast("long").alias("nth"))


def swept(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs after a sweep at a time: (job_id, status, cause). jobs: job_id, status, lease_until, deadline TIMESTAMP.

    A waiting or leased job whose deadline has passed has failed; a lease that has run out returns its job to those that
    wait, and its deadline stays. Others are as they were, with a null cause.
    """
    late = F.col("status").isin("awaiting_collection", "collecting") & (F.col("deadline") < now)
    free = (F.col("status") == "collecting") & (F.col("lease_until") < now)
    return jobs.select("job_id", F.when(late, "failed").when(free, "awaiting_collection").otherwise(F.col("status")).alias("status"), F.when(late, "deadline").when(free, "lease").alias("cause"))


def recovered(jobs: DataFrame) -> DataFrame:
    """Jobs after a restart: what was being worked on waits again."""
    return jobs.withColumn("status", F.coalesce(legal(F.col("status"), F.lit("restart")), F.col("status")))


def autocleared(jobs: DataFrame, now: Column, seconds: int = 86_400) -> DataFrame:
    """(job_id, status, action): finished jobs untouched for longer are cleared, failed ones stay, but give up their
    staged files ('reap'); null for the rest. jobs: job_id, status, seen TIMESTAMP; a null time is never old."""
    old = F.coalesce(F.col("seen") < now - F.make_interval(secs=F.lit(seconds)), F.lit(False))
    return jobs.select("job_id", "status", F.when(old & F.col("status").isin(*FINISHED), "clear").when(old & (F.col("status") == "failed"), "reap").alias("action"))


def submit_outcomes(submits: DataFrame, jobs: DataFrame) -> DataFrame:
    """What each submission of a collected text comes to: (submit_id, job_id, outcome).

    submits: submit_id, job_id; jobs: job_id, status, collected_at. 'not_found' without a job; 'already_submitted' where
    the job waits in the queue or was collected before; 'not_leased' where it isn't leased; of several for one leased job
    the first by submit_id is 'accepted', the others find it submitted.
    """
    known = submits.select("submit_id", "job_id").join(jobs.select("job_id", "status", "collected_at"), "job_id", "left")
    first = submits.groupBy("job_id").agg(F.min("submit_id").alias("first"))
    outcome = (
        F.when(F.col("status").isNull(), "not_found").when((F.col("status") == "queued") | F.col("collected_at").isNotNull(), "already_submitted")
        .when(F.col("status") != "collecting", "not_leased").when(F.col("submit_id") == F.col("first"), "accepted").otherwise("already_submitted")
    )
    return known.join(first, "job_id").select("submit_id", "job_id", outcome.alias("outcome"))
