"""The streams of tasks and invocations against their batch forms, at each watermark, with late events and restarts."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lectern.operators.ledger import invocation_log, task_state, task_table
from lectern.plans.base import Tables
from lectern.plans.ledgers import task_events
from lectern.streaming.jobs import use_rocksdb
from lectern.streaming.tasks import stream_invocations, stream_task_state

ZERO = datetime(1970, 1, 1)


def run(spark, make, parts, folder, schema):
    """Each part as a file, each in a run of its own that goes on where the last one stopped: after each (watermark, rows so far)."""
    use_rocksdb(spark)
    rows = []

    def keep(batch, number):
        rows.extend(tuple(r) for r in batch.collect())

    for i, part in enumerate(parts):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        q = make(stream).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        mark = max(p["eventTime"]["watermark"] for p in q.recentProgress)
        yield datetime.fromisoformat(mark.rstrip("Z")), list(rows)


TASKS = "task_id bigint, at timestamp, event_id bigint, kind string"
STATE = ["task_id", "status", "attempt_count", "created_at", "locked_until", "lease_expired", "claimable", "active", "terminal"]


def newest(rows):
    out = {}
    for r in rows:
        if r[0] not in out or r[1] > out[r[0]][1]:
            out[r[0]] = r
    return sorted((r[0], *r[2:]) for r in out.values())


def hold(parts, marks):
    """The events of the parts so far that weren't behind the watermark when they came."""
    return [r for part, mark in zip(parts, marks, strict=False) for r in part if r[1] > mark]


def test_leases_run_out_without_an_event(spark, tmp_path):
    at = lambda m, s=0: datetime(2024, 1, 1) + timedelta(minutes=m, seconds=s)
    parts = [
        [(1, at(2), 2, "claim"), (1, at(0), 1, "enqueue"), (2, at(3), 3, "claim"), (9, at(4), 4, "enqueue")],
        [(9, at(7, 1), 5, "claim"), (3, at(1), 6, "claim")],  # task 1's lease runs out at 7; 3 is behind the watermark of 4 - 1 = 3
        [(9, at(60), 7, "completed"), (2, at(6, 30), 8, "completed")],
        [(1, at(61), 9, "claim"), (2, at(61), 10, "claim"), (2, at(59, 30), 11, "failed")],
        [(9, at(90), 12, "enqueue")],
    ]
    marks = [ZERO]
    for i, (mark, rows) in enumerate(run(spark, lambda s: stream_task_state(s, 300, "1 minute"), parts, tmp_path, TASKS)):
        known = hold(parts[: i + 1], marks)
        want = task_state(task_table(spark.createDataFrame(known, TASKS)), F.lit(mark)).select(*STATE)
        assert newest(rows) == sorted(map(tuple, want.collect())), i
        marks.append(mark)
    assert not any(r[0] == 3 for r in rows)
    assert [r[6] for r in sorted(rows) if r[0] == 1] == [False, True, False, True]  # claimed, run out, claimed again, run out


def test_task_stream_is_the_batch_for_shuffled_events(spark, sf_dir, tmp_path):
    events = sorted((tuple(r) for r in task_events(Tables(spark, sf_dir)).where("task_id < 40").select("task_id", "at", "event_id", "kind").collect()), key=lambda r: r[1])
    third = len(events) // 3
    parts = [events[i * third : (i + 1) * third + (i == 2) * 3][:: (-1) ** i] for i in range(3)]
    parts[1], parts[2] = parts[1] + parts[2][-20:], parts[2][:-20] + parts[0][:5]  # some come early, some late
    marks = [ZERO]
    for i, (mark, rows) in enumerate(run(spark, lambda s: stream_task_state(s, 7200, "1 day"), parts, tmp_path, TASKS)):
        want = task_state(task_table(spark.createDataFrame(hold(parts[: i + 1], marks), TASKS), 7200), F.lit(mark)).select(*STATE)
        assert newest(rows) == sorted(map(tuple, want.collect()))
        marks.append(mark)


CALLS = "task_id bigint, at timestamp, thread_id string, seq bigint, kind string, status string, error string"


@pytest.mark.parametrize("late", ["1 minute", "10 minutes"])
def test_invocation_stream_is_the_batch(spark, tmp_path, late):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    start = lambda m, thread="a", task=1: (task, at(m), thread, m, "started", None, None)
    end = lambda m, status="success", thread="a", task=1, error=None: (task, at(m), thread, m, "finished", status, error)
    parts = [
        [end(3), start(1), start(2), end(4, "failed", error="broke"), start(2, "b"), start(5, task=2)],
        [end(8), start(6), start(9), end(7, "nothing", "c"), end(6, "late", "b")],
        [start(7), end(30), start(20, "b"), start(2, "c")],
        [end(21, "x", "b"), start(61), end(62, "open", "b")],
        [start(100, task=9)],
    ]
    marks = [ZERO]
    for i, (mark, rows) in enumerate(run(spark, lambda s: stream_invocations(s, late), parts, tmp_path, CALLS)):
        known = [r for r in hold(parts[: i + 1], marks) if r[1] <= mark]
        latest = {r[:3]: r[3:] for r in rows}  # a later row of an invocation takes the place of an earlier one
        want = invocation_log(spark.createDataFrame(known, CALLS)).select("task_id", "thread_id", "seq", "status", "error", "finished_seq") if known else None
        assert sorted((*k, *v) for k, v in latest.items()) == (sorted(map(tuple, want.collect())) if want else [])
        marks.append(mark)
    assert any(r[5] for r in rows)
