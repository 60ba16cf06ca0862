"""Ledgers of requests, tasks, steps and invocations."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import is_future
from lectern.operators.tables import with_rank

TERMINAL = ("completed", "needs_review", "failed")


class Ledger:
    """The ledger row of one (operation, key): what its last execution is known to do, and when (in microseconds) it ends and its lease runs out."""

    def __init__(self, lease_us: int, known=None, outcome=None, done_us=None, lease=None, attempt=0):
        self.lease_us, self.known, self.outcome, self.done_us, self.lease, self.attempt = lease_us, known, outcome, done_us, lease, attempt

    def row(self) -> tuple:
        return self.known, self.outcome, self.done_us, self.lease, self.attempt

    def decide(self, request_hash: str | None, at_us: int | None, outcome: str | None, done_us: int | None) -> str:
        """The decision on the next request; one that executes changes the row."""
        ended = self.done_us is not None and at_us is not None and self.done_us <= at_us
        if self.attempt == 0:
            decision = "execute"
        elif self.known is not None and request_hash is not None and self.known != request_hash:
            decision = "conflict"
        elif ended:
            decision = "replay" if self.outcome == "succeeded" else "reclaim"
        else:
            decision = "busy" if self.lease is not None and at_us is not None and self.lease > at_us else "reclaim"
        if self.known is None:
            self.known = request_hash
        if decision in ("execute", "reclaim"):
            self.outcome, self.done_us, self.attempt = outcome, done_us, self.attempt + 1
            self.lease = None if at_us is None else at_us + self.lease_us
        return decision


def decide_requests(requests: DataFrame, lease_seconds: int = 300) -> DataFrame:
    """Requests (request_id, operation, idempotency_key, request_hash, at, outcome, done_at) with decision and attempt.

    In order of time within (operation, key): a null key always executes; the first executes; another
    hash is a conflict; a success replays, or is reclaimed if its outcome was resource_failed; while
    a lease runs the key is busy; anything else is reclaimed.  outcome and done_at are what happens
    if the request does execute (null: it never ends, and its lease runs out).

    Each task reads its sorted requests in Arrow batches and holds one ledger row, however many requests a key has.
    """
    keyed = requests.where("idempotency_key is not null").select("operation", "idempotency_key", "request_id", "request_hash", F.unix_micros("at").alias("at_us"), "outcome", F.unix_micros(F.col("done_at").cast("timestamp")).alias("done_us"))
    ordered = keyed.repartition("operation", "idempotency_key").sortWithinPartitions("operation", "idempotency_key", "at_us", "request_id")
    schema = keyed.select("operation", "idempotency_key", "request_id").schema.add("decision", "string").add("attempt", "integer")
    lease_us = lease_seconds * 1_000_000

    def decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ledger = None, Ledger(lease_us)
        for batch in batches:
            decisions, attempts = [], []
            for op, key, request_hash, at_us, outcome, done_us in zip(*(batch.column(c).to_pylist() for c in ("operation", "idempotency_key", "request_hash", "at_us", "outcome", "done_us"))):
                if (op, key) != at:
                    at, ledger = (op, key), Ledger(lease_us)
                decisions.append(ledger.decide(request_hash, at_us, outcome, done_us))
                attempts.append(ledger.attempt)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("operation", "idempotency_key", "request_id")), pa.array(decisions, pa.string()), pa.array(attempts, pa.int32())], names=schema.names)

    free = requests.where("idempotency_key is null").select("operation", "idempotency_key", "request_id", F.lit("execute").alias("decision"), F.lit(0).alias("attempt"))
    return ordered.mapInArrow(decided, schema).unionByName(free)


def retryable_records(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Records (record_id, resource_type, resource_id) with resource_failed: an async task that failed or is gone."""
    t = tasks.select(F.col("task_id").alias("resource_id"), F.col("status").alias("_s"))
    failed = (F.col("resource_type") == "async_task") & F.col("resource_id").isNotNull() & (F.col("_s").isNull() | (F.col("_s") == "failed"))
    return records.join(t, "resource_id", "left").withColumn("resource_failed", F.coalesce(failed, F.lit(False))).drop("_s")


def task_state(tasks: DataFrame, now: Column) -> DataFrame:
    """Tasks (status, locked_until, ...) with claimable, active, terminal and lease_expired."""
    expired = (F.col("status") == "running") & ~is_future(F.col("locked_until"), now)
    return tasks.withColumn("lease_expired", expired).withColumn("claimable", (F.col("status") == "pending") | expired).withColumn("terminal", F.col("status").isin(*TERMINAL)).withColumn("active", F.col("status").isin("pending", "running"))


def claim_order(tasks: DataFrame, now: Column, *by: str) -> DataFrame:
    """The claimable tasks with claim_rank, the oldest first within ``by``, or of all."""
    ready = task_state(tasks, now).where("claimable")
    if not by:
        return with_rank(ready, "claim_rank", F.col("created_at"), F.col("task_id"))
    return ready.withColumn("claim_rank", F.row_number().over(Window.partitionBy(*by).orderBy("created_at", "task_id")))


def task_table(events: DataFrame, lease_seconds: int = 300) -> DataFrame:
    """The tasks that events (task_id, at, event_id, kind: enqueue, claim or a terminal status) lead to."""
    last = F.max_by(F.struct("kind", "at"), F.struct("at", "event_id"))
    rows = events.groupBy("task_id").agg(last.alias("_l"), F.sum(F.when(F.col("kind") == "claim", 1).otherwise(0)).alias("attempt_count"), F.min("at").alias("created_at"))
    status = F.when(F.col("_l.kind") == "enqueue", "pending").when(F.col("_l.kind") == "claim", "running").otherwise(F.col("_l.kind"))
    return rows.select("task_id", status.alias("status"), "attempt_count", "created_at", F.when(status == "running", F.col("_l.at") + F.make_interval(secs=F.lit(lease_seconds))).alias("locked_until"))


def latest_steps(steps: DataFrame) -> DataFrame:
    """The newest attempt of each (run_id, step_id), with history: the earlier ones that didn't succeed."""
    rows = steps.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", "step_id").orderBy(F.col("attempt").desc())))
    old = rows.where("_n > 1 and status <> 'succeeded'").groupBy("run_id", "step_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "status"))).alias("history"))
    none = F.array().cast("array<struct<attempt:int,status:string>>")
    return rows.where("_n = 1").drop("_n").join(old, ["run_id", "step_id"], "left").withColumn("history", F.coalesce("history", none))


def succeeded_latency(steps: DataFrame) -> DataFrame:
    """(run_id, latency_ms) of the steps whose newest attempt succeeded."""
    return latest_steps(steps).groupBy("run_id").agg(F.coalesce(F.sum(F.when(F.col("status") == "succeeded", F.col("latency_ms"))), F.lit(0)).alias("latency_ms"))


def resume_plan(planned: DataFrame, steps: DataFrame, force: bool = False) -> DataFrame:
    """Planned steps (run_id, step_id, fingerprint) with action and next attempt, given the ledger (run_id, step_id, attempt, status, fingerprint, latency_ms).

    Succeeded steps are skipped, others run again; a changed fingerprint is rejected, or with
    ``force`` goes on with a warning.
    """
    done = latest_steps(steps).select("run_id", "step_id", "attempt", "status", F.col("fingerprint").alias("_old"), F.size("history").alias("history_entries"))
    joined = planned.join(done, ["run_id", "step_id"], "left")
    changed = F.coalesce(F.col("_old") != F.col("fingerprint"), F.lit(False))
    skip = F.coalesce(F.col("status") == "succeeded", F.lit(False))
    action = F.when(changed & F.lit(not force), "reject").when(skip, "skip").otherwise("run")
    return joined.select(
        "run_id", "step_id", action.alias("action"), F.when(action == "run", F.coalesce("attempt", F.lit(0)) + 1).otherwise(F.col("attempt")).alias("next_attempt"),
        (F.coalesce("history_entries", F.lit(0)) + F.when((action == "run") & F.col("attempt").isNotNull(), 1).otherwise(0)).alias("history_entries"), (changed & F.lit(force)).alias("warning"))


def invocation_log(events: DataFrame) -> DataFrame:
    """Started entries (task_id, thread_id, seq, kind, status, error) closed by finish events: a finish closes the newest entry of its thread that still runs.

    A finish event closes the last started one before it that no other finish has closed: pairs are
    matched like brackets, by depth.
    """
    w = Window.partitionBy("task_id", "thread_id").orderBy("seq")
    depth = F.sum(F.when(F.col("kind") == "started", 1).otherwise(-1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    low = F.min("_d").over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = events.withColumn("_d", depth)
    # A finish without anything open is dropped: depth is taken above the lowest so far.
    rows = rows.withColumn("_low", F.least(F.lit(0), low)).withColumn("_level", F.col("_d") - F.col("_low") + F.when(F.col("kind") == "started", 0).otherwise(1))
    idle = (F.col("kind") != "started") & (F.col("_d") == F.col("_low")) & (F.coalesce(F.lag("_low").over(w), F.lit(0)) > F.col("_low"))
    rows = rows.withColumn("_idle", idle).where("not _idle")
    pair = Window.partitionBy("task_id", "thread_id", "_level", "_low").orderBy("seq")
    after = lambda c: F.when(F.lead("kind").over(pair) == "finished", F.lead(c).over(pair))
    rows = rows.withColumn("_status", after("status")).withColumn("_error", after("error")).withColumn("_end", after("seq"))
    return rows.where("kind = 'started'").select("task_id", "thread_id", "seq", F.coalesce("_status", F.lit("running")).alias("status"), F.col("_error").alias("error"), F.col("_end").alias("finished_seq"))
