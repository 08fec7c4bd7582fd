"""State by key in the order of event times: requests that reuse a running job, and legal changes of a job's status."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

#: (state or None, event) -> (state or None, the output's values or None). A state with "until" (microseconds) is of no use after that time.
Step = Callable[[dict | None, dict], tuple[dict | None, tuple | None]]


def folded(events: DataFrame, key: str, time: str, tie: str, columns: Sequence[str], step: Step, schema: str, late: str = "10 minutes") -> DataFrame:
    """Walks the events of each key by time, then tie, and gives `schema` of what the step returns.

    A batch is sorted by key and time, and a task carries the state from row to row, so a key may have any number of events. On a stream, events wait in the
    key's state until the watermark passes them, so late ones take their place in the order; those later than `late` are dropped by the stream.
    Timers wake a key whose events are due, and drop states that are of no use any more. Events without key or time take no part.
    """
    names = ["key", "at", "tie", *columns]
    picked = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    picked = picked.select(F.col(key).cast("string").alias("key"), F.unix_micros(F.col(time).cast("timestamp")).alias("at"), F.col(tie).alias("tie"), *columns, F.col(time).cast("timestamp").alias("event_time"))
    out = [c.split()[0] for c in schema.split(", ")]
    if not events.isStreaming:
        ordered = picked.drop("event_time").repartition("key").sortWithinPartitions("key", "at", "tie")

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            at, state = None, None
            for pdf in frames:
                rows = []
                for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records"):
                    if r["key"] != at:
                        at, state = r["key"], None
                    state, found = step(state, r)
                    rows += [found] if found is not None else []
                yield pd.DataFrame(rows, columns=out)

        return ordered.mapInPandas(run, schema)

    def advance(_, frames: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        kept = json.loads(held.get[0]) if held.exists else {"waiting": [], "state": None}
        waiting = kept["waiting"]
        if not held.hasTimedOut:
            for pdf in frames:
                waiting += pdf[names].astype(object).where(pdf[names].notna(), None).values.tolist()
        mark = held.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda r: (r[1], r[2]))
        rows, state = [], kept["state"]
        while waiting and waiting[0][1] < mark:
            state, found = step(state, dict(zip(names, waiting.pop(0))))
            rows += [found] if found is not None else []
        if not waiting and state and state.get("until") is not None and state["until"] < mark:
            state = None
        if waiting or state:
            held.update((json.dumps({"waiting": waiting, "state": state}),))
            due = waiting[0][1] if waiting else state.get("until")
            if due is not None:
                held.setTimeoutTimestamp(max(due // 1000 + 1, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        yield pd.DataFrame(rows, columns=out)

    grouped = picked.withWatermark("event_time", late).groupBy("key")
    return grouped.applyInPandasWithState(advance, schema, "kept string", "append", GroupStateTimeout.EventTimeTimeout)


def reused_jobs(events: DataFrame, key: str, time: str, event: str, ends: str, age_seconds: float = 5.0, late: str = "10 minutes") -> DataFrame:
    """key, event, job_at (microseconds at which the event's job began), reused.

    An event asks for a job of its key. One that runs and began at most `age_seconds` ago is taken, else a new one begins. Events for which the column
    `ends` is true end the key's job and give no row.
    """
    age = round(age_seconds * 1_000_000)

    def step(state, r):
        if r[ends]:
            return None, None
        if state is not None and r["at"] - state["began"] <= age:
            return state, (r["key"], r["tie"], state["began"], True)
        return {"began": r["at"], "until": r["at"] + age}, (r["key"], r["tie"], r["at"], False)

    return folded(events, key, time, event, [ends], step, "key string, event long, job_at long, reused boolean", late)


#: what may follow a status; None: nothing yet
LEGAL: Mapping[str | None, frozenset[str]] = {None: frozenset({"pending", "running"}), "pending": frozenset({"running", "failed"}), "running": frozenset({"done", "failed"})}


def job_statuses(events: DataFrame, key: str, time: str, event: str, status: str, legal: Mapping[str | None, frozenset[str]] = LEGAL, late: str = "10 minutes") -> DataFrame:
    """key, event, before, status, legal: each change of a job's status, and whether it may follow; one that may not leaves the job as it is."""

    def step(state, r):
        before = state and state["status"]
        ok = r[status] in legal.get(before, ())
        return ({"status": r[status]} if ok else state), (r["key"], r["tie"], before, r[status], ok)

    return folded(events, key, time, event, [status], step, "key string, event long, before string, status string, legal boolean", late)
