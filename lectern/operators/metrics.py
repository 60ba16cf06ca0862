"""Retrieval and generation metrics.  Empty inputs give 0.0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import contains_all_terms
from lectern.functions.vectors import let
from lectern.operators.search import embed, search


def mean(value: Column) -> Column:
    return F.coalesce(F.avg(value.cast("double")), F.lit(0.0))


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def recall(expected: Column, retrieved: Column) -> Column:
    e, r = _strings(expected), _strings(retrieved)
    return F.when(F.size(e) > 0, F.size(F.array_intersect(e, r)) / F.size(F.array_distinct(e))).otherwise(0.0)


def hit(expected: Column, retrieved: Column) -> Column:
    return (F.size(F.array_intersect(_strings(expected), _strings(retrieved))) > 0).cast("double")


def reciprocal_rank(expected: Column, retrieved: Column) -> Column:
    e, r = _strings(expected), _strings(retrieved)
    first = F.array_min(F.filter(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), i + 1)), lambda x: x.isNotNull()))
    return F.coalesce(1.0 / first, F.lit(0.0))


def ndcg(expected: Column, retrieved: Column) -> Column:
    """Binary gains; an id that is retrieved twice counts twice, so the value can pass 1."""
    e, r = _strings(expected), _strings(retrieved)
    gains = F.aggregate(F.transform(r, lambda x, i: F.when(F.array_contains(e, x), 1 / F.log2(i + 2.0)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    best = F.least(F.size(F.array_distinct(e)), F.size(r))
    ideal = F.aggregate(F.sequence(F.lit(0), best), F.lit(0.0), lambda a, i: a + F.when(i > 0, 1 / F.log2(i + 1.0)).otherwise(0.0))
    return F.when(best > 0, gains / ideal).otherwise(0.0)


def precision(expected: Column, retrieved: Column) -> Column:
    e, r = _strings(expected), _strings(retrieved)
    return F.when(F.size(r) > 0, F.size(F.array_intersect(e, r)) / F.size(F.array_distinct(r))).otherwise(0.0)


def count_accuracy(expected: Column, actual: Column) -> Column:
    """Share of the types in either map with equal counts."""
    zero = lambda m, k: F.coalesce(F.element_at(m, k), F.lit(0))
    return let(F.array_union(F.map_keys(expected), F.map_keys(actual)), lambda ks: F.when(F.size(ks) > 0, F.size(F.filter(ks, lambda k: zero(expected, k) == zero(actual, k))) / F.size(ks)).otherwise(0.0))


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """One row from cases (expected, retrieved)."""
    e, r = F.col("expected"), F.col("retrieved")
    return cases.agg(mean(recall(e, r)).alias("recall_at_k"), mean(hit(e, r)).alias("hit_at_k"), mean(reciprocal_rank(e, r)).alias("mrr"), mean(ndcg(e, r)).alias("ndcg"), mean(precision(e, r)).alias("context_precision"))


def rank_metrics(retrieved: DataFrame, expected: DataFrame) -> DataFrame:
    """One row, as :func:`retrieval_metrics`, from rows instead of lists.

    ``retrieved``: query_id, rank from 1, chunk_id and whether it is a hit; ``expected``: query_id and
    n_expected, how many distinct ids it expects, however many those are.  A query without results counts 0.
    """
    gain = lambda place: 1 / F.log2(place + 1.0)
    hits = F.col("hit")
    found = retrieved.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("chunk_id").alias("d"), F.count_distinct(F.when(hits, F.col("chunk_id"))).alias("h"), F.min(F.when(hits, F.col("rank"))).alias("first"), F.sum(F.when(hits, gain(F.col("rank"))).otherwise(0.0)).alias("gains"))
    cases = expected.join(found, "query_id", "left").fillna(0, ["n", "d", "h", "gains"])
    best = F.least("n_expected", "n").cast("int")
    ideal = F.aggregate(F.sequence(F.lit(0), best), F.lit(0.0), lambda a, i: a + F.when(i > 0, gain(i)).otherwise(0.0))
    zero = lambda value, over: F.when(over > 0, value).otherwise(0.0)
    return cases.agg(
        mean(zero(F.col("h") / F.col("n_expected"), F.col("n_expected"))).alias("recall_at_k"), mean(F.col("h") > 0).alias("hit_at_k"), mean(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("mrr"),
        mean(zero(F.col("gains") / ideal, best)).alias("ndcg"), mean(zero(F.col("h") / F.col("d"), F.col("d"))).alias("context_precision"))


def share(df: DataFrame, condition: Column, name: str) -> DataFrame:
    """One row: the share of the rows for which the condition holds."""
    return df.agg(mean(F.coalesce(condition, F.lit(False))).alias(name))


def export_success_rate(exports: DataFrame, files: DataFrame) -> DataFrame:
    """One row from exports (file_path) and files (path, length): the share that exist and aren't empty."""
    found = exports.join(files.select(F.col("path").alias("file_path"), "length"), "file_path", "left")
    return share(found, F.col("length") > 0, "export_success_rate")


def evaluate(retrieval: DataFrame, citations: DataFrame, schemas: DataFrame, counts: DataFrame, answers: DataFrame, exports: DataFrame, files: DataFrame, duplicate_rate: float | None = None) -> DataFrame:
    """The report: one row with every metric."""
    parts = [
        retrieval_metrics(retrieval), share(citations, F.size("citation_chunk_ids") > 0, "citation_coverage"), share(schemas, F.col("schema_valid"), "schema_pass_rate"),
        counts.agg(mean(count_accuracy(F.col("expected"), F.col("actual"))).alias("question_count_accuracy")),
        share(answers, F.col("has_answer") & F.col("has_explanation"), "answer_completeness"), export_success_rate(exports, files),
    ]
    report = parts[0]
    for part in parts[1:]:  # one row each
        report = report.crossJoin(part)
    return report.withColumn("duplicate_rate", F.lit(duplicate_rate).cast("double"))


def relevance_labels(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases (query_id, query, terms) with retrieved ids by rank and expected ones: those whose content has all terms, or a placeholder if none has."""
    labelled = results.join(cases.select("query_id", "terms"), "query_id").withColumn("_hit", contains_all_terms(F.col("content"), F.col("terms")))
    ids = labelled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "_hit"))).alias("_r"))
    empty = F.array().cast("array<struct<rank:int,chunk_id:string,_hit:boolean>>")
    r = F.coalesce("_r", empty)
    hits = F.transform(F.filter(r, lambda x: x["_hit"]), lambda x: x["chunk_id"])
    return cases.join(ids, "query_id", "left").select(
        "query_id", "query", F.transform(r, lambda x: x["chunk_id"]).alias("retrieved"),
        F.when(F.size(hits) > 0, hits).otherwise(F.array(F.concat(F.lit("__missing__:"), "query"))).alias("expected"),
    )


def evaluate_results(results: DataFrame, cases: DataFrame) -> DataFrame:
    """Labels and metrics of what was retrieved before: one row."""
    return retrieval_metrics(relevance_labels(results, cases))


def evaluate_retrieval(chunks: DataFrame, cases: DataFrame, k: int = 8, digits: int | None = None) -> DataFrame:
    """One row of metrics: each case (query_id, course_id, query, terms) is embedded and searched among the chunks of its course, what it finds is labelled, and the labels are measured."""
    asked = embed(cases, "query").withColumns({"chapter": F.lit(""), "source_type": F.lit(""), "verified_only": F.lit(None).cast("boolean")})
    return evaluate_results(search(chunks, asked, k, digits=digits), cases)


def eval_cases(lessons: DataFrame, questions: DataFrame, slides: DataFrame, exports: DataFrame) -> DataFrame:
    """Artifacts as (case_kind, item_id, citation_chunk_ids, ok, file_path) rows; title slides don't count, references without a chunk are dropped."""
    ids = lambda refs: F.filter(F.coalesce(F.transform(refs, lambda r: r["chunk_id"]), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    row = lambda df, kind, item, cited=None, ok=None, path=None: df.select(F.lit(kind).alias("case_kind"), item.cast("string").alias("item_id"), (F.lit(None) if cited is None else cited).cast("array<string>").alias("citation_chunk_ids"), (F.lit(None) if ok is None else ok).cast("boolean").alias("ok"), (F.lit(None) if path is None else path).cast("string").alias("file_path"))
    shown = slides.where("slide_type <> 'title'")
    return (
        row(lessons, "citation", F.col("lesson_id"), ids(F.col("references")))
        .unionByName(row(questions, "citation", F.col("question_id"), ids(F.col("references"))))
        .unionByName(row(questions, "answer", F.col("question_id"), ok=(F.coalesce("correct_answer", F.lit("")) != "") & (F.coalesce("explanation", F.lit("")) != "")))
        .unionByName(row(shown, "citation", F.col("slide_id"), ids(F.col("references"))))
        .unionByName(row(exports, "export", F.col("export_id"), path=F.col("file_path")))
    )
