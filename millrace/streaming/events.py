"""Event streams: reading, windows, repeats within a time, keyed leases and a run to the end of what is there."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.jsonx import read_object
from millrace.operators.jobs import Machine


def event_stream(spark: SparkSession, path: str, time_col: str = "ts", **options: str) -> DataFrame:
    """A stream over the Parquet files at a path, with its time as a TIMESTAMP, which watermarks need."""
    schema = spark.read.parquet(path).schema
    # The file source takes folders and patterns; this pattern is the path itself, be it a file or a folder.
    pattern = path[:-1] + f"[{path[-1]}]"
    return spark.readStream.schema(schema).options(**options).parquet(pattern).withColumn(time_col, F.col(time_col).cast("timestamp"))


def windowed_counts(events: DataFrame, key: str, width: str = "1 day", slide: str | None = None, late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """(key, start, end, n, total): events per key and window; a window appears when the watermark has passed it."""
    window = F.window(time_col, width, slide) if slide else F.window(time_col, width)
    counts = events.withWatermark(time_col, late).groupBy(window.alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", late: str = "1 hour", time_col: str = "ts") -> DataFrame:
    """(key, start, end, n): runs of events without a gap of the given length."""
    counts = events.withWatermark(time_col, late).groupBy(F.session_window(time_col, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def once_within(events: DataFrame, keys: list[str], within: str = "7 days", time_col: str = "ts") -> DataFrame:
    """Events without repeats of the same keys inside a time; the state of a key is dropped after it."""
    return events.withWatermark(time_col, within).dropDuplicatesWithinWatermark(keys)


_LEASE_STATE = "holder string, until long, renewals long"
_LEASE_OUT = "key string, holder string, renewals long, until timestamp, expired boolean"


def leases(events: DataFrame, seconds: float, late: str = "10 seconds", time_col: str = "ts") -> DataFrame:
    """Leases by event time: (key, holder, renewals, until, expired).

    events: key STRING, holder STRING, ts. The first event of a key takes the lease, later ones of the same holder before
    its end renew it, others are refused. A lease that isn't renewed by the watermark is given out as expired and its
    state dropped; state holds one row per open lease.
    """

    span = int(seconds * 1_000_000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        columns = ["key", "holder", "renewals", "until", "expired"]
        if state.hasTimedOut:
            holder, until, renewals = state.get
            state.remove()
            yield pd.DataFrame([[key[0], holder, renewals, pd.Timestamp(until, unit="us"), True]], columns=columns)
            return
        rows = pd.concat(list(batches)).sort_values(["ts", "holder"])
        holder, until, renewals = state.get if state.exists else (None, 0, 0)
        out = []
        for who, ts in zip(rows["holder"], rows["ts"]):
            at = ts.value // 1000
            if holder is not None and at >= until:
                out.append([key[0], holder, renewals, pd.Timestamp(until, unit="us"), True])
                holder = None
            if holder is None:
                holder, until, renewals = who, at + span, 0
            elif holder == who:
                until, renewals = at + span, renewals + 1
        state.update((holder, until, renewals))
        # The timer must lie behind the watermark; a lease that is already over is given out with the next batch.
        state.setTimeoutTimestamp(max(until // 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=columns)

    keyed = events.withWatermark(time_col, late).select("key", "holder", F.col(time_col).alias("ts"))
    return keyed.groupBy("key").applyInPandasWithState(step, _LEASE_OUT, _LEASE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_MACHINE_STATE = "state string, since long, seen long"
_MACHINE_OUT = "key string, ts timestamp, event string, outcome string, state string"


def state_machine(events: DataFrame, machine: Machine, late: str = "10 seconds", time_col: str = "ts") -> DataFrame:
    """Keyed state machines by event time: (key, ts, event, outcome, state), a row for each event and each timeout.

    events: key STRING, event STRING, ts. An event that is legal in its key's state is 'applied'; one that leads to the
    state the key is already in is 'repeated', any other is 'refused', and both change nothing. A state with a timeout is
    left by itself ('timeout') when an event of the key comes after its end or the watermark passes it. Events of one
    batch are taken in order of their time; one that comes later than the state's last event is taken as it comes. State
    holds one row for each key that isn't cleared, and is dropped with it.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, since, seen = state.get if state.exists else ("", 0, 0)
        out = []

        def lapse(until: int) -> None:
            nonlocal now, since
            while now in machine.timeouts and since + int(machine.timeouts[now][0] * 1_000_000) <= until:
                since += int(machine.timeouts[now][0] * 1_000_000)
                now = machine.timeouts[now][1]
                out.append([key[0], pd.Timestamp(since, unit="us"), None, "timeout", now])

        if state.hasTimedOut:
            lapse(state.getCurrentWatermarkMs() * 1_000)
        else:
            rows = pd.concat(list(batches)).sort_values(["ts", "event"])
            for event, ts in zip(rows["event"], rows["ts"]):
                at = ts.value // 1_000
                lapse(at)
                after = machine.events.get(event, {}).get(now)
                outcome = "applied" if after is not None else "repeated" if now and now in machine.events.get(event, {}).values() else "refused"
                if after is not None:
                    now, since = after, at
                seen = max(seen, at)
                out.append([key[0], ts, event, outcome, now])
        if now:
            state.update((now, since, seen))
            if now in machine.timeouts:
                state.setTimeoutTimestamp(max((since + int(machine.timeouts[now][0] * 1_000_000)) // 1_000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["key", "ts", "event", "outcome", "state"])

    keyed = events.withWatermark(time_col, late).select("key", "event", F.col(time_col).alias("ts"))
    return keyed.groupBy("key").applyInPandasWithState(step, _MACHINE_OUT, _MACHINE_STATE, "append", GroupStateTimeout.EventTimeTimeout)


_ANSWER_STATE = "parts array<string>, cleared boolean"
_ANSWER_OUT = "question_id string, seq int, kind string, text string"


def answer_events(chunks: DataFrame, late: str = "10 minutes", time_col: str = "ts") -> DataFrame:
    """Answers as they may be shown: (question_id, seq, kind, text).

    chunks: question_id STRING, ts, n INT, kind STRING ('chunk', 'end' or 'error'), text, cleared BOOLEAN (whether any
    note cleared the gate). Chunks are held back until the answer's end, since they are parts of a structured text that
    isn't to be seen: then its "answer" is a 'delta' (seq 0), followed by the 'final' text as it was (seq 1). An error discards what is
    held and is given out alone; where nothing cleared the gate there is an 'abstain' and no answer. Of an answer that
    isn't structured the whole text is the answer.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, cleared = state.get if state.exists else ([], True)
        parts, out = list(parts), []
        for r in pd.concat(list(batches)).sort_values(["ts", "n"]).to_dict("records"):
            if r["kind"] == "chunk":
                parts.append(r["text"] or "")
                cleared = bool(cleared) and bool(r["cleared"])
                continue
            if r["kind"] == "error":
                out.append((key[0], 0, "error", r["text"]))
            elif not (cleared and r["cleared"]):
                out.append((key[0], 0, "abstain", None))
            else:
                whole = "".join(parts)
                value = json.loads(read_object(whole) or "{}").get("answer")
                answer = value if isinstance(value, str) else whole
                if answer:
                    out.append((key[0], 0, "delta", answer))
                out.append((key[0], 1, "final", whole))
            parts, cleared = [], True
        if parts:
            state.update((parts, cleared))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=["question_id", "seq", "kind", "text"])

    keyed = chunks.withWatermark(time_col, late).select("question_id", F.col(time_col).alias("ts"), "n", "kind", "text", "cleared")
    return keyed.groupBy("question_id").applyInPandasWithState(step, _ANSWER_OUT, _ANSWER_STATE, "append", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """Run a stream over everything that is there now, into a table in the shared checkpoint folder, and read that."""
    from millrace.plans.session import shared_folder

    spark = stream.sparkSession
    base = folder or f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    schema = stream.schema
    query = stream.writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{base}/table")
