"""Tasks and invocations as streams: leases that run out by themselves, and starts that wait on a stack for their finish."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lectern.operators.ledger import TERMINAL


def _after(us: int) -> int:
    """The first millisecond that isn't before a microsecond."""
    return -(-us // 1000)


class TaskLeases(StatefulProcessor):
    """The row of one task: what its last event made of it, and a timer at the end of its lease."""

    STATE = "kind string, at_us bigint, event_id bigint, attempts bigint, created_us bigint, version bigint"
    COLUMNS = ("task_id", "version", "status", "attempt_count", "created_us", "locked_us", "lease_expired", "claimable", "active", "terminal")

    def __init__(self, lease_seconds: int):
        self.lease_us = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("task", self.STATE)

    def _row(self, key, kind: str, at: int, event: int, attempts: int, created: int, version: int, now_ms: int) -> pd.DataFrame:
        self.state.update((kind, at, event, attempts, created, version))
        status = {"enqueue": "pending", "claim": "running"}.get(kind, kind)
        lease = at + self.lease_us if status == "running" else None
        expired = lease is not None and lease <= now_ms * 1000
        row = (key[0], version, status, attempts, created, lease, expired, status == "pending" or expired, status in ("pending", "running"), status in TERMINAL)
        return pd.DataFrame([row], columns=self.COLUMNS).astype({"locked_us": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, at, event, attempts, created, version = self.state.get() if self.state.exists() else (None, None, None, 0, None, 0)
        for batch in rows:
            for r in batch[["kind", "at_us", "event_id"]].itertuples(index=False):
                attempts += r.kind == "claim"
                created = int(r.at_us) if created is None else min(created, int(r.at_us))
                if at is None or (r.at_us, r.event_id) > (at, event):
                    kind, at, event = r.kind, int(r.at_us), int(r.event_id)
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        if kind == "claim":
            self.handle.registerTimer(_after(at + self.lease_us))
        yield self._row(key, kind, at, event, attempts, created, version + 1, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        kind, at, event, attempts, created, version = self.state.get()
        yield self._row(key, kind, at, event, attempts, created, version + 1, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_task_state(events: DataFrame, lease_seconds: int = 300, late: str = "2 hours") -> DataFrame:
    """Streaming form of ``task_state`` over ``task_table``: rows (task_id, version, status, attempt_count, created_at, locked_until, lease_expired, claimable, active, terminal).

    ``events`` are those of ``task_table``: task_id, at, event_id and kind.  A task's row of the
    highest version is its state at the watermark.  It changes with its events, which may come in
    any order within ``late``, and, without any event, when the watermark reaches the end of its
    lease.  Events behind the watermark are dropped.  State is one row for each task.  The session
    needs the RocksDB state store.
    """
    rows = events.withWatermark("at", late).select("task_id", "at", F.unix_micros(F.col("at")).alias("at_us"), F.col("event_id").cast("long").alias("event_id"), "kind")
    kinds = {"version": T.LongType(), "status": T.StringType(), "attempt_count": T.LongType(), "created_us": T.LongType(), "locked_us": T.LongType()} | dict.fromkeys(TaskLeases.COLUMNS[6:], T.BooleanType())
    schema = T.StructType([rows.schema["task_id"], *[T.StructField(c, kind) for c, kind in kinds.items()]])
    made = rows.groupBy("task_id").transformWithStateInPandas(TaskLeases(lease_seconds), outputStructType=schema, outputMode="update", timeMode="eventTime")
    return made.select("task_id", "version", "status", "attempt_count", F.timestamp_micros("created_us").alias("created_at"), F.timestamp_micros("locked_us").alias("locked_until"), "lease_expired", "claimable", "active", "terminal")


class InvocationStack(StatefulProcessor):
    """The invocations of one thread: a stack of those that run, and events that the watermark hasn't reached."""

    COLUMNS = ("task_id", "thread_id", "seq", "status", "error", "finished_seq")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "seq bigint")
        self.waiting = handle.getListState("waiting", "at_us bigint, seq bigint, kind string, status string, error string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        text = lambda x: None if pd.isna(x) else x
        first = None
        for batch in rows:
            new = [(int(r.at_us), int(r.seq), r.kind, text(r.status), text(r.error)) for r in batch.itertuples(index=False)]
            self.waiting.appendList(new)
            first = min([*([] if first is None else [first]), *(r[0] for r in new)])
        timers, due = list(self.handle.listTimers()), _after(first)  # one timer, at the first event that waits
        if not timers or due < min(timers):
            for timer in timers:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        reached = timerValues.getCurrentWatermarkInMs() * 1000
        events = sorted(self.waiting.get(), key=lambda r: r[1])
        due, rest = [r for r in events if r[0] <= reached], [tuple(r) for r in events if r[0] > reached]
        stack = [r[0] for r in self.open.get()]
        changed: dict[int, tuple] = {}
        for _, seq, kind, status, error in due:
            if kind == "started":
                stack.append(seq)
                changed[seq] = ("running", None, None)
            elif stack:
                changed[stack.pop()] = ("running" if status is None else status, error, seq)
        for state, kept in ((self.open, [(s,) for s in stack]), (self.waiting, rest)):
            if kept:
                state.put(kept)
            else:
                state.clear()
        if rest:
            self.handle.registerTimer(_after(min(r[0] for r in rest)))
        if changed:
            rows = pd.DataFrame([(*key, seq, *row) for seq, row in changed.items()], columns=self.COLUMNS)
            yield rows.astype({"finished_seq": "Int64"})

    def close(self) -> None:
        pass


def stream_invocations(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Streaming form of ``invocation_log``: rows (task_id, thread_id, seq, status, error, finished_seq).

    ``events`` are those of ``invocation_log`` and their time ``at``, which grows with seq.  They may
    come in any order within ``late``: an event waits until the watermark reaches it, so a finish
    that comes before its start still meets it.  Then a start goes on the stack of its thread, and a
    finish takes the last one off; one with nothing to finish is dropped.  An invocation gives a row
    when it starts, and another when it is finished; only the latter if both happen at once.  State
    holds what runs and what waits.  The session needs the RocksDB state store.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    rows = events.withWatermark("at", late).select("task_id", "thread_id", "at", F.unix_micros(F.col("at")).alias("at_us"), F.col("seq").cast("long").alias("seq"), text("kind"), text("status"), text("error"))
    kinds = {"seq": T.LongType(), "status": T.StringType(), "error": T.StringType(), "finished_seq": T.LongType()}
    schema = T.StructType([rows.schema["task_id"], rows.schema["thread_id"], *[T.StructField(c, kind) for c, kind in kinds.items()]])
    return rows.groupBy("task_id", "thread_id").transformWithStateInPandas(InvocationStack(), outputStructType=schema, outputMode="update", timeMode="eventTime")
