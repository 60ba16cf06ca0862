"""Model calls: responses to attempts, attempts to invocations, usage roll-up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import interrupted

TOKENS = ("input_tokens", "output_tokens", "total_tokens")


def parse_responses(raw: DataFrame, schema: T.StructType, rules: dict[str, str] | None = None) -> DataFrame:
    """Attempts (invocation_id, attempt, raw, finish_reason) with parsed, status and category.

    No raw text: choices_none; cut short: generation_interrupted; no JSON: structured_parse_error; a
    required field that is null, or a rule (SQL over parsed) that fails: pydantic_validation_error.
    """
    kept = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("_corrupt", T.StringType())])
    out = raw.withColumn("_p", F.from_json("raw", kept, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    needed = [F.col(f"_p.{f.name}").isNull() for f in schema if not f.nullable]
    broken = F.lit(False)
    for c in needed:
        broken = broken | c
    out = out.withColumn("parsed", F.struct(*[F.col(f"_p.{f.name}").alias(f.name) for f in schema]))
    for rule in (rules or {}).values():
        broken = broken | ~F.coalesce(F.expr(rule), F.lit(False))
    category = (
        F.when(F.col("raw").isNull(), "choices_none").when(interrupted(F.col("finish_reason")), "generation_interrupted")
        .when(F.col("_p").isNull() | F.col("_p._corrupt").isNotNull(), "structured_parse_error").when(broken, "pydantic_validation_error")
    )
    out = out.withColumn("category", category)
    return out.withColumn("status", F.when(F.col("category").isNull(), "success").otherwise("failed")).withColumn("parsed", F.when(F.col("category").isNull(), F.col("parsed"))).drop("_p")


def resolve_invocations(attempts: DataFrame, max_retries: int = 1, fallback: DataFrame | None = None) -> DataFrame:
    """One row per invocation: its first success within 1 + max_retries attempts, else the fallback's (invocation_id, parsed), else failed.

    The reason of a fallback is the last attempt's category.
    """
    tried = attempts.where(F.col("attempt") <= 1 + max(0, max_retries))
    good = F.col("status") == "success"
    first = F.min(F.when(good, F.col("attempt")))
    out = tried.groupBy("invocation_id", "prompt_name").agg(
        first.alias("_first"), F.min_by(F.when(good, F.col("parsed")), F.when(good, F.col("attempt"))).alias("parsed"), F.max_by("category", "attempt").alias("_last"),
        F.array_sort(F.collect_list(F.struct("attempt", "status", "category"))).alias("attempts"), F.sum("latency_ms").alias("latency_ms"))
    out = out.withColumn("attempts", F.filter("attempts", lambda a: F.col("_first").isNull() | (a["attempt"] <= F.col("_first"))))
    if fallback is not None:
        out = out.join(fallback.select("invocation_id", F.col("parsed").alias("_fallback")), "invocation_id", "left")
    else:
        out = out.withColumn("_fallback", F.lit(None).cast(out.schema["parsed"].dataType))
    failed = F.col("_first").isNull()
    used = failed & F.col("_fallback").isNotNull()
    return (
        out.withColumn("fallback_used", used).withColumn("status", F.when(failed & ~used, "failed").otherwise("success"))
        .withColumn("fallback_reason", F.when(used, F.col("_last"))).withColumn("error_category", F.when(failed, F.col("_last")))
        .withColumn("parsed", F.coalesce("parsed", "_fallback")).drop("_first", "_last", "_fallback")
    )


def usage_summary(invocations: DataFrame, run: str = "run_id") -> DataFrame:
    """Per run, and per run and prompt (prompt_name null: the whole run): counts, latency, tokens and usage_source_counts.

    Invocations: run, prompt_name, status, fallback_used, latency_ms, attempts, usage (tokens and
    usage_source).  A run in which no usage has a count has null tokens; else every prompt of it has
    at least 0.  Usages without a source count as unknown; invocations without usage don't count.
    """
    u = F.col("usage")
    known = u.isNotNull() & F.coalesce(*[u[t] for t in TOKENS]).isNotNull()
    rows = invocations.withColumns({
        "prompt_name": F.coalesce("prompt_name", F.lit("unknown")), "_failed": (F.coalesce("status", F.lit("")) == "failed").cast("int"),
        "_attempts": F.size(F.filter(F.coalesce("attempts", F.array().cast(invocations.schema["attempts"].dataType)), lambda a: a["status"] == "failed")),
        "_known": known.cast("int"), "_source": F.when(u.isNotNull(), F.coalesce(u["usage_source"], F.lit("unknown"))),
        **{f"_{t}": F.when(known, F.coalesce(u[t], F.lit(0))) for t in TOKENS},
    }).withColumn("_fallback", F.when(F.col("_failed") == 0, F.coalesce("fallback_used", F.lit(False)).cast("int")).otherwise(0))
    # One pass to the finest level, then both levels from it.
    fine = rows.groupBy(run, "prompt_name", "_source").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("_failed", "_fallback", "_attempts", "_known", *[f"_{t}" for t in TOKENS])], F.sum(F.coalesce("latency_ms", F.lit(0))).alias("latency_ms"))
    both = fine.select(F.explode(F.array(F.col("prompt_name"), F.lit(None).cast("string"))).alias("prompt"), "*")
    out = both.groupBy(run, "prompt").agg(
        F.sum("n").alias("call_count"), (F.sum("n") - F.sum("_failed") - F.sum("_fallback")).alias("successful_call_count"), F.sum("_failed").alias("failed_call_count"), F.sum("_attempts").alias("failed_attempt_count"),
        F.sum("_fallback").alias("fallback_count"), F.sum("latency_ms").alias("latency_ms"), F.sum("_known").alias("_any"), *[F.sum(f"_{t}").alias(t) for t in TOKENS])
    sources = both.where("_source is not null").groupBy(run, "prompt", "_source").agg(F.sum("n").alias("n")).groupBy(run, "prompt").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_source", "n")))).alias("usage_source_counts"))
    whole = out.where("prompt is null").select(F.col(run), (F.col("_any") > 0).alias("_saw"))
    out = out.join(whole, run).join(sources.withColumnRenamed("prompt", "_p").withColumnRenamed(run, "_r"), (F.col(run) == F.col("_r")) & F.col("prompt").eqNullSafe(F.col("_p")), "left")
    tokens = {t: F.when(F.col("_saw"), F.coalesce(t, F.lit(0))) for t in TOKENS}
    return out.withColumns(tokens).withColumn("usage_source_counts", F.coalesce("usage_source_counts", F.create_map().cast("map<string,bigint>"))).drop("_saw", "_p", "_r", "_any").withColumnRenamed("prompt", "prompt_name")


def merge_invocations(old: DataFrame, new: DataFrame, run: str = "run_id") -> tuple[DataFrame, DataFrame]:
    """(summary of both logs, (run, prompt_name, prompt_sha256) of the last to write each prompt)."""
    both = old.unionByName(new, allowMissingColumns=True)
    return usage_summary(both, run), both.groupBy(run, "prompt_name").agg(F.max_by("prompt_sha256", "seq").alias("prompt_sha256"))
