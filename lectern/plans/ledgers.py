"""Queries on model calls and ledgers; events stand for calls, requests, tasks and steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators import ledger as G
from lectern.operators import usage as U
from lectern.plans.base import Tables, query


def calls(t: Tables) -> DataFrame:
    i = F.col("event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    usage = F.when(i % 4 != 0, F.struct(
        F.when(i % 3 == 0, k).alias("input_tokens"), F.when(i % 3 == 0, F.lit(1).cast("long")).alias("output_tokens"), F.when(i % 3 == 0, k + 1).alias("total_tokens"), F.when(i % 5 != 0, F.lit("provider")).alias("usage_source")))
    attempt = lambda s: F.struct(F.lit(s).alias("status"))
    return t.events.select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("prompt_name"), F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"), (F.col("value") < 10).alias("fallback_used"), (i % 100).alias("latency_ms"),
        F.when(i % 2 == 0, F.array(attempt("failed"), attempt("failed"))).otherwise(F.array(attempt("success"))).alias("attempts"), usage.alias("usage"), i.alias("seq"), F.sha2(F.col("props"), 256).alias("prompt_sha256"))


CALLS_SQL = """c AS (SELECT user_id AS run_id, event_type AS prompt_name, event_type = 'error' AS failed, event_type <> 'error' AND value < 10 AS fb, event_id % 100 AS ms, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS att,
event_id % 4 <> 0 AS has, event_id % 4 <> 0 AND event_id % 3 = 0 AS known, (props->>'$.k')::bigint AS k, event_id % 5 <> 0 AS src, event_id AS seq, sha256(props) AS sha FROM events)"""


@query(f"""WITH {CALLS_SQL}, s AS (SELECT run_id, bool_or(known) AS saw FROM c GROUP BY ALL),
g AS (SELECT run_id, prompt_name, count(*) AS call_count, count(*) FILTER (NOT failed AND NOT fb) AS successful_call_count, count(*) FILTER (failed) AS failed_call_count, sum(att)::bigint AS failed_attempt_count, count(*) FILTER (fb) AS fallback_count, sum(ms)::bigint AS latency_ms,
coalesce(sum(CASE WHEN known THEN k END), 0)::bigint AS input_tokens, coalesce(sum(CASE WHEN known THEN k + 1 END), 0)::bigint AS total_tokens, count(*) FILTER (has AND src) AS n_provider, count(*) FILTER (has AND NOT src) AS n_unknown FROM c GROUP BY GROUPING SETS ((run_id, prompt_name), (run_id)))
SELECT g.* EXCLUDE (input_tokens, total_tokens), CASE WHEN saw THEN input_tokens END AS input_tokens, CASE WHEN saw THEN total_tokens END AS total_tokens FROM g JOIN s USING (run_id)""".replace("FILTER (", "FILTER (WHERE "))
def d17_usage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = U.usage_summary(calls(Tables(spark, sf_dir)))
    n = lambda k: F.coalesce(F.element_at("usage_source_counts", F.lit(k)), F.lit(0)).cast("long")
    return s.select("run_id", "prompt_name", "call_count", "successful_call_count", "failed_call_count", "failed_attempt_count", "fallback_count", "latency_ms", "input_tokens", "total_tokens", n("provider").alias("n_provider"), n("unknown").alias("n_unknown"))


@query(f"""WITH {CALLS_SQL} SELECT run_id, prompt_name, arg_max(sha, seq) AS prompt_sha256, count(*) AS call_count FROM c GROUP BY ALL""")
def d18_merge_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = calls(Tables(spark, sf_dir))
    summary, hashes = U.merge_invocations(c.where("seq % 2 = 0"), c.where("seq % 2 = 1"))
    return hashes.join(summary.where("prompt_name is not null").select("run_id", "prompt_name", "call_count"), ["run_id", "prompt_name"])


def attempts(t: Tables) -> DataFrame:
    i = F.col("event_id")
    raw = F.when(F.col("value") < 5, F.lit(None).cast("string")).when(F.col("event_type") == "view", F.lit('{"k": ')).when(F.col("event_type") == "click", F.lit('{"z": 1}')).otherwise(F.col("props"))
    return t.events.select(F.floor(i / 2).alias("invocation_id"), (i % 2 + 1).alias("attempt"), F.lit("exam/plan").alias("prompt_name"), raw.alias("raw"), F.when(F.col("event_type") == "signup", "length").otherwise("stop").alias("finish_reason"), (i % 50).alias("latency_ms"))


ANSWER = T.StructType([T.StructField("k", T.LongType(), nullable=False)])
ATTEMPTS_SQL = """a AS (SELECT event_id // 2 AS invocation_id, event_id % 2 + 1 AS attempt, (props->>'$.k')::bigint AS k, event_id % 50 AS ms,
CASE WHEN value < 5 THEN 'choices_none' WHEN event_type = 'signup' THEN 'generation_interrupted' WHEN event_type = 'view' THEN 'structured_parse_error' WHEN event_type = 'click' OR (props->>'$.k')::bigint < 20 THEN 'pydantic_validation_error' END AS category FROM events)"""


@query(f"WITH {ATTEMPTS_SQL} SELECT invocation_id, attempt, CASE WHEN category IS NULL THEN 'success' ELSE 'failed' END AS status, category, CASE WHEN category IS NULL THEN k END AS k FROM a")
def k09_parse_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = U.parse_responses(attempts(Tables(spark, sf_dir)), ANSWER, {"k": "_p.k >= 20"})
    return p.select("invocation_id", "attempt", "status", "category", F.col("parsed.k").alias("k"))


@query(f"""WITH {ATTEMPTS_SQL}, g AS (SELECT invocation_id, min(attempt) FILTER (WHERE category IS NULL) AS f, arg_min(k, attempt) FILTER (WHERE category IS NULL) AS k, arg_max(category, attempt) AS last, count(*) AS n FROM a GROUP BY ALL),
l AS (SELECT invocation_id, arg_max(coalesce(category, ''), attempt) AS last FROM a GROUP BY ALL)
SELECT g.invocation_id, CASE WHEN f IS NULL AND g.invocation_id % 3 <> 0 THEN 'failed' ELSE 'success' END AS status, f IS NULL AND g.invocation_id % 3 = 0 AS fallback_used, CASE WHEN f IS NULL THEN l.last END AS error_category, CASE WHEN f IS NOT NULL THEN k WHEN g.invocation_id % 3 = 0 THEN -1 END AS k, coalesce(f, n) AS n_attempts FROM g JOIN l USING (invocation_id)""")
def k10_resolve_invocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = U.parse_responses(attempts(Tables(spark, sf_dir)), ANSWER, {"k": "_p.k >= 20"})
    fallback = p.where("invocation_id % 3 = 0").select("invocation_id", F.struct(F.lit(-1).cast("long").alias("k")).alias("parsed")).distinct()
    r = U.resolve_invocations(p, 1, fallback)
    return r.select("invocation_id", "status", "fallback_used", "error_category", F.col("parsed.k").alias("k"), F.size("attempts").cast("long").alias("n_attempts"))


@query("SELECT event_id, event_type IN ('view', 'click') AS ok, CASE WHEN event_type IN ('view', 'click') THEN '' WHEN event_type = 'error' THEN 'query' ELSE 'top_k' END AS violations FROM events")
def k08_check_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lectern.operators.requests import check_search_request

    kind = F.col("event_type")
    r = check_search_request(Tables(spark, sf_dir).events.select("event_id", F.when(kind == "error", "").otherwise(kind).alias("query"), F.when(kind.isin("signup", "purchase"), 21).otherwise(5).alias("top_k")))
    return r.select("event_id", (F.size("violations") == 0).alias("ok"), F.array_join("violations", ",").alias("violations"))


def requests(t: Tables) -> DataFrame:
    i, at = F.col("event_id"), F.col("ts").cast("timestamp")
    return t.events.select(
        i.alias("request_id"), F.col("event_type").alias("operation"), F.when(i % 13 != 0, F.col("user_id").cast("string")).alias("idempotency_key"), F.when(i % 7 == 0, "b").otherwise("a").alias("request_hash"), at.alias("at"),
        F.when(i % 3 == 0, "failed").otherwise("succeeded").alias("outcome"), F.when(i % 5 != 0, at + F.expr("interval 60 seconds")).alias("done_at"))


@query("""WITH RECURSIVE r AS MATERIALIZED (SELECT event_id AS id, event_type AS op, user_id::varchar AS k, CASE WHEN event_id % 7 = 0 THEN 'b' ELSE 'a' END AS h, ts AS t0, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS outcome, CASE WHEN event_id % 5 <> 0 THEN ts + INTERVAL 60 SECOND END AS done,
row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts, event_id) AS n FROM events WHERE event_id % 13 <> 0),
f AS (SELECT op, k, n, id, 'execute' AS decision, h AS hash, outcome, done, t0 + INTERVAL 10 DAY AS lease, 1 AS attempt FROM r WHERE n = 1
UNION ALL SELECT op, k, n, id, d, hash, CASE WHEN d = 'reclaim' THEN o2 ELSE outcome END, CASE WHEN d = 'reclaim' THEN done2 ELSE done END, CASE WHEN d = 'reclaim' THEN t0 + INTERVAL 10 DAY ELSE lease END, attempt + CASE WHEN d = 'reclaim' THEN 1 ELSE 0 END
FROM (SELECT f.op, f.k, r.n, r.id, r.t0, f.hash, f.outcome, r.outcome AS o2, f.done, r.done AS done2, f.lease, f.attempt,
CASE WHEN f.hash <> r.h THEN 'conflict' WHEN f.done <= r.t0 AND f.outcome = 'succeeded' THEN 'replay' WHEN f.done <= r.t0 THEN 'reclaim' WHEN f.lease > r.t0 THEN 'busy' ELSE 'reclaim' END AS d FROM f JOIN r ON r.op = f.op AND r.k = f.k AND r.n = f.n + 1))
SELECT id AS request_id, op AS operation, k AS idempotency_key, decision, attempt FROM f UNION ALL SELECT event_id, event_type, NULL, 'execute', 0 FROM events WHERE event_id % 13 = 0""")
def l02_decide_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.decide_requests(requests(Tables(spark, sf_dir)), lease_seconds=864000).select("request_id", "operation", "idempotency_key", "decision", "attempt")


@query("""SELECT o_orderkey AS record_id, o_orderkey % 2 = 0 AND o_orderkey % 3 <> 0 AND (c_custkey IS NULL OR c_mktsegment = 'BUILDING') AS resource_failed FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_nationkey <> 5""")
def c12_retryable_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, k = Tables(spark, sf_dir), F.col("o_orderkey")
    records = t.orders.select(k.alias("record_id"), F.when(k % 2 == 0, "async_task").otherwise("file").alias("resource_type"), F.when(k % 3 != 0, F.col("o_custkey")).alias("resource_id"))
    tasks = t.customer.where("c_nationkey <> 5").select(F.col("c_custkey").alias("task_id"), F.when(F.col("c_mktsegment") == "BUILDING", "failed").otherwise("completed").alias("status"))
    return G.retryable_records(records, tasks).select("record_id", "resource_failed")


def task_events(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    return t.events.select(F.col("user_id").alias("task_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", F.when(kind == "signup", "enqueue").when(kind.isin("click", "view"), "claim").when(kind == "error", "failed").otherwise("completed").alias("kind"))


@query("""WITH l AS (SELECT user_id AS task_id, arg_max(event_type, (ts, event_id)) AS k, max(ts) AS t0, count(*) FILTER (WHERE event_type IN ('click', 'view')) AS attempt_count FROM events GROUP BY ALL),
s AS (SELECT *, CASE WHEN k = 'signup' THEN 'pending' WHEN k IN ('click', 'view') THEN 'running' WHEN k = 'error' THEN 'failed' ELSE 'completed' END AS status FROM l), n AS (SELECT max(ts) AS now FROM events)
SELECT task_id, status, attempt_count, status = 'pending' OR (status = 'running' AND t0 + INTERVAL 300 SECOND <= now) AS claimable, status IN ('failed', 'completed') AS terminal FROM s, n""")
def l03_task_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = task_events(Tables(spark, sf_dir))
    tasks = G.task_table(e).crossJoin(e.agg(F.max("at").alias("now")))
    return G.task_state(tasks, F.col("now")).select("task_id", "status", F.col("attempt_count").cast("long").alias("attempt_count"), "claimable", "terminal")


def claims(t: Tables) -> tuple[DataFrame, Column]:
    """Orders as tasks, and the time."""
    k, now = F.col("o_orderkey"), F.to_timestamp(F.lit("2020-01-01"))
    status = F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "O", "running").otherwise("completed")
    return t.orders.select(k.alias("task_id"), "o_orderpriority", F.col("o_orderdate").alias("created_at"), status.alias("status"), F.when(k % 2 == 0, now - F.expr("interval 1 hour")).otherwise(now + F.expr("interval 1 hour")).alias("locked_until")), now


@query("""SELECT o_orderkey AS task_id, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS claim_rank FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)""")
def e04_claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks, now = claims(Tables(spark, sf_dir))
    return G.claim_order(tasks, now, "o_orderpriority").select("task_id", F.col("claim_rank").cast("long").alias("claim_rank"))


@query("""SELECT o_orderkey AS task_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS claim_rank FROM orders WHERE o_orderstatus = 'P' OR (o_orderstatus = 'O' AND o_orderkey % 2 = 0)""")
def e04_claim_order_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One queue of all tasks."""
    return G.claim_order(*claims(Tables(spark, sf_dir))).select("task_id", "claim_rank")


def steps(t: Tables) -> DataFrame:
    from pyspark.sql.window import Window

    kind = F.col("event_type")
    n = F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("event_id"))
    return t.events.select(
        F.col("user_id").alias("run_id"), kind.alias("step_id"), n.alias("attempt"), F.when(F.col("event_id") % 3 == 0, "succeeded").otherwise("failed").alias("status"), F.when(F.col("user_id") % 10 == 0, "x").otherwise("f").alias("fingerprint"), (F.col("event_id") % 100).alias("latency_ms"))


STEPS_SQL = """s AS (SELECT user_id AS run_id, event_type AS step_id, event_id, event_id % 3 = 0 AS ok, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS attempt, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events),
l AS (SELECT run_id, step_id, max(attempt) AS attempt, bool_or(ok) FILTER (WHERE r = 1) AS ok, count(*) FILTER (WHERE r > 1 AND NOT ok) AS h FROM s GROUP BY ALL)"""


@query(f"WITH {STEPS_SQL} SELECT run_id, step_id, attempt::bigint AS attempt, CASE WHEN ok THEN 'succeeded' ELSE 'failed' END AS status, h AS n_history FROM l")
def e03_latest_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = G.latest_steps(steps(Tables(spark, sf_dir)))
    return s.select("run_id", "step_id", F.col("attempt").cast("long").alias("attempt"), "status", F.size("history").cast("long").alias("n_history"))


@query(f"WITH {STEPS_SQL} SELECT run_id, coalesce(sum(CASE WHEN ok AND r = 1 THEN event_id % 100 END), 0)::bigint AS latency_ms FROM s GROUP BY run_id")
def d19_succeeded_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.succeeded_latency(steps(Tables(spark, sf_dir)))


@query(f"""WITH {STEPS_SQL}, p AS (SELECT * FROM (SELECT DISTINCT user_id AS run_id FROM events), (VALUES ('view'), ('click'), ('publish')) AS t(step_id)), j AS (SELECT p.run_id, p.step_id, attempt, ok, h, attempt IS NOT NULL AND p.run_id % 10 = 0 AS changed FROM p LEFT JOIN l USING (run_id, step_id)),
a AS (SELECT *, CASE WHEN changed THEN 'reject' WHEN coalesce(ok, false) THEN 'skip' ELSE 'run' END AS action FROM j)
SELECT run_id, step_id, action, (CASE WHEN action = 'run' THEN coalesce(attempt, 0) + 1 ELSE attempt END)::bigint AS next_attempt, (coalesce(h, 0) + CASE WHEN action = 'run' AND attempt IS NOT NULL THEN 1 ELSE 0 END)::bigint AS history_entries FROM a""")
def l04_resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = steps(Tables(spark, sf_dir))
    planned = done.select("run_id").distinct().withColumn("step_id", F.explode(F.array(F.lit("view"), F.lit("click"), F.lit("publish")))).withColumn("fingerprint", F.lit("f"))
    p = G.resume_plan(planned, done)
    return p.select("run_id", "step_id", "action", F.col("next_attempt").cast("long").alias("next_attempt"), F.col("history_entries").cast("long").alias("history_entries"))


@query("""WITH e AS (SELECT user_id AS task_id, event_id, event_type IN ('click', 'view', 'signup') AS started, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
pairs AS (SELECT s.task_id, s.event_id AS seq, min(f.event_id) AS f FROM (SELECT task_id, event_id, started, n, sum(CASE WHEN started THEN 1 ELSE -1 END) OVER (PARTITION BY task_id ORDER BY n) AS d FROM e) s
LEFT JOIN (SELECT task_id, event_id, started, n, sum(CASE WHEN started THEN 1 ELSE -1 END) OVER (PARTITION BY task_id ORDER BY n) AS d FROM e) f ON f.task_id = s.task_id AND NOT f.started AND f.n > s.n AND f.d = s.d - 1 WHERE s.started GROUP BY ALL)
SELECT task_id, seq, CASE WHEN f IS NULL THEN 'running' ELSE 'done' END AS status, f AS finished_seq FROM pairs""")
def l05_invocation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).events.select(F.col("user_id").alias("task_id"), F.lit("main").alias("thread_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type").isin("click", "view", "signup"), "started").otherwise("finished").alias("kind"), F.lit("done").alias("status"), F.lit(None).cast("string").alias("error"))
    return G.invocation_log(e).select("task_id", "seq", "status", "finished_seq")
