"""Operators over whole tables without one task for all: ranks, cascades, metrics by rows, long sections."""

import time

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking as C
from lectern.operators.ledger import claim_order
from lectern.operators.metrics import rank_metrics, retrieval_metrics
from lectern.operators.tables import cascade_all, with_rank


def test_ranks_of_a_whole_table(spark):
    df = spark.range(5000, numPartitions=7).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 3).alias("g"))
    got = {r.k: r.n for r in with_rank(df, "n", F.desc("g"), F.asc("k")).collect()}
    want = sorted(((r.g, r.k) for r in df.collect()), key=lambda x: (-x[0], x[1]))
    assert [got[k] for _, k in want] == list(range(1, 5001))
    assert with_rank(df.limit(0), "n", F.asc("k")).count() == 0
    now = F.to_timestamp(F.lit("2024-01-01"))
    tasks = spark.createDataFrame([(3, "pending", None, 5), (1, "running", None, 4), (2, "completed", None, 1)], "task_id bigint, status string, locked_until timestamp, created_at bigint")
    assert {r.task_id: r.claim_rank for r in claim_order(tasks, now).collect()} == {r.task_id: r.claim_rank for r in claim_order(tasks.withColumn("one", F.lit(1)), now, "one").collect()}


def test_cascade_walks_the_graph(spark):
    rows = lambda *r: spark.createDataFrame(r, "id bigint, up bigint, other bigint")
    tables = {"c": (rows((5, 3, 1), (6, 4, 2), (7, None, None)), "id"), "b": (rows((3, 1, 0), (4, 2, 0), (8, None, 0)), "id"), "a": (rows((1, 0, 0), (2, 0, 0)), "id"), "d": (rows((9, 5, 1), (10, 6, 2)), "id")}
    edges = [("a", "b", "up", "delete"), ("b", "c", "up", "delete"), ("c", "d", "up", "null"), ("a", "d", "other", "null")]
    got = {k: sorted(map(tuple, df.collect()), key=str) for k, df in cascade_all(tables, edges, {"a": rows((1, 0, 0)).select("id"), "b": rows((8, 0, 0)).select("id")}).items()}
    assert got == {"a": [(2, 0, 0)], "b": [(4, 2, 0)], "c": [(6, 4, 2), (7, None, None)], "d": [(10, 6, 2), (9, None, None)]}
    with pytest.raises(ValueError):
        cascade_all(tables, [*edges, ("c", "a", "up", "delete")], {})


def test_metrics_by_rows_are_those_of_lists(spark):
    cases = [(1, ["a", "b", "c"], ["x", "b", "b", "a"]), (2, ["a"], []), (3, [], ["a"]), (4, ["q", "q"], ["q"]), (5, ["n"], ["y", "z"])]
    lists = spark.createDataFrame(cases, "query_id bigint, expected array<string>, retrieved array<string>")
    retrieved = spark.createDataFrame([(q, i, c, c in e) for q, e, r in cases for i, c in enumerate(r, 1)], "query_id bigint, rank int, chunk_id string, hit boolean")
    expected = spark.createDataFrame([(q, len(set(e))) for q, e, _ in cases], "query_id bigint, n_expected bigint")
    assert [round(x, 12) for x in rank_metrics(retrieved, expected).first()] == [round(x, 12) for x in retrieval_metrics(lists).first()]
    assert list(rank_metrics(retrieved.limit(0), expected.limit(0)).first()) == [0.0] * 5


def test_chunks_of_a_section_of_any_length(spark, monkeypatch):
    text = "\n\n".join(("第3章 标题" if i % 50 == 7 else f"1.{i} Heading" if i % 20 == 3 else f"paragraph {i} " + "word " * (i % 60)) for i in range(3000))
    df = spark.createDataFrame([(text, "t"), ("", "t"), (None, None), ("one", None)], "content string, title string")
    chunks = lambda: [[tuple(c) for c in r[0]] for r in df.select(C.chunk_array(F.col("content"), F.col("title"))).collect()]
    want = chunks()
    for piece in (1, 7, 100_000):
        monkeypatch.setattr(C, "PIECE", piece)
        assert chunks() == want
    assert len(want[0]) > 300 and want[1:] == [[], [], [("one", None, None, None)]]


def test_time_grows_with_the_length_of_a_section(spark):
    def seconds(n):
        df = spark.range(1).select(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("word " * 120), i.cast("string"))), "\n\n").alias("content"))
        began = time.time()
        assert df.select(F.size(C.chunk_array(F.col("content"), F.lit(None)))).first()[0] > n / 2
        return time.time() - began

    seconds(1_000)
    short, long = seconds(8_000), seconds(64_000)
    assert long < 20 * max(short, 0.5)
