"""Exams at size: what their queries write, the forms by rows and by arrays against each other, and the order of points."""

import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import exams as E
from lectern.operators.lineage import shared_folder
from lectern.plans.base import Tables
from lectern.plans.queries import QUERIES
from lectern.plans.teaching import _damaged, exam_blueprints

GROUP = "struct<question_type:string,count:int,score_each:int,total_score:int,knowledge_points:array<string>,difficulty:string>"
CONTEXT = "struct<rank:int,chunk_id:string,source_type:string,chapter:string,page:int,content:string>"


def shared_bytes(spark):
    top = shared_folder(spark).removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


def written(spark, sf_dir, name):
    """How many rows a query gives, and how many bytes it leaves in the shared folder."""
    before = shared_bytes(spark)
    return QUERIES[name](spark, sf_dir).count(), shared_bytes(spark) - before


def test_repair_loop_writes_little(spark, sf_dir):
    n, size = written(spark, sf_dir, "j11_repair_loop")
    assert size < 700 * n


def test_validation_writes_little(spark, sf_dir):
    n, size = written(spark, sf_dir, "k01_validate_exams")
    assert size < 200 * n


def test_repair_shuffles_counts_only(spark, sf_dir):
    plan = QUERIES["j03_repair_questions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "hashpartitioning(exam_id" in plan
    assert plan.count("Exchange hashpartitioning") <= 9  # three readings of contexts, parts and params; the counts lie where the exams do


def test_points_of_contexts_of_one_rank(spark):
    params = spark.sql("SELECT id AS exam_id, 'chapter' AS chapter_range, array(named_struct('pos', 0, 'question_type', 'judgement', 'count', 1, 'score_each', 1)) AS groups, array(named_struct('pos', 0, 'key', 'easy', 'value', 1D)) AS difficulties FROM range(1, 4)")
    rows = [(1, 5, "p2", "delta alpha omega"), (1, 5, "p1", "alpha beta"), (1, 4, "p3", "first beta2"), (1, 6, "p0", "beta last"), (2, 1, "p1", "one two"), (2, 1, "p1", "one two"), (2, 3, "p2", None), (2, 4, "p3", "three")]
    contexts = spark.createDataFrame(rows, "exam_id bigint, rank int, chunk_id string, content string").selectExpr("*", "'' AS source_type", "'' AS chapter", "0 AS page")
    got = {r.exam_id: r.knowledge_points for r in E.plan_blueprints(params, contexts).collect()}
    assert got == {1: ["first", "beta2", "alpha", "delta", "beta", "omega", "last"], 2: ["one", "two", "three"], 3: ["chapter"]}


@pytest.fixture(scope="module")
def exams(spark, sf_dir):
    """Blueprints that carry questions, some of which are lost or damaged; some exams have none, some far too many."""
    b = exam_blueprints(Tables(spark, sf_dir)).where("exam_id < 300")
    q = _damaged(E.generate_questions(b)).where("not (exam_id % 9 = 4 and question_type = 'judgement') and exam_id % 17 <> 3")
    q = q.withColumn("knowledge_point", F.when((F.col("exam_id") % 6 == 0) & (F.col("pos") == 1), "-").otherwise(F.col("knowledge_point"))).withColumn("options", F.when(F.col("exam_id") % 10 != 7, F.col("options"))).withColumn("score", F.when(F.col("exam_id") % 19 != 2, F.col("score"))).withColumn("correct_answer", F.when(F.col("exam_id") % 23 != 5, F.col("correct_answer")))
    more = q.where("exam_id % 8 = 1").withColumn("pos", F.explode(F.sequence(F.col("pos") + 10, F.col("pos") + 14)))
    gathered = q.unionByName(more).groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct(*q.columns[1:]))).alias("questions"))
    return b.join(gathered, "exam_id", "left").withColumn("questions", F.coalesce("questions", F.filter(F.array(F.struct(*[F.lit(None).cast(q.schema[c].dataType).alias(c) for c in q.columns[1:]])), lambda _: F.lit(False)))).cache()


def by_rows(exams):
    return exams.select("exam_id", F.explode("questions").alias("q")).select("exam_id", "q.*")


@pytest.mark.parametrize("cell", [1024, 4])
def test_reports_by_rows_and_by_arrays_agree(spark, exams, monkeypatch, cell):
    monkeypatch.setattr(E, "CELL", cell)
    b = exams.drop("questions")
    want = E.validate_exams(b, by_rows(exams), 0.7, 0.2)
    got = E.validate_gathered(exams, 0.7, 0.2).select(*want.columns)
    plain = lambda df: sorted(map(repr, df.withColumn("duplicate_rate", F.round("duplicate_rate", 9)).collect()))
    assert plain(got) == plain(want)
    seen = got.selectExpr(*[f"count(distinct {c}) AS {c}" for c in want.columns if c.endswith("_valid") or c == "passed"]).first()
    assert seen.asDict() == dict.fromkeys(seen.asDict(), 2)


def test_repairs_by_rows_and_by_arrays_agree(spark, exams):
    rows = lambda df: sorted(map(repr, df.collect()))
    want = E.repair_questions(exams.drop("questions"), by_rows(exams))
    assert rows(by_rows(E.repair_gathered(exams)).select(*want.columns)) == rows(want)
    made = E.gather_questions(exams.drop("questions"))
    assert rows(by_rows(made)) == rows(E.generate_questions(exams.drop("questions")).select(*by_rows(made).columns))


def test_repair_of_repeated_types(spark):
    group = lambda kind, n: (kind, n, 1, n, ["x", "y"], "easy")
    b = spark.createDataFrame([(1, "ch", [(1, "c1", "", "", 1, ""), (2, "c2", "", "", 1, "")], [group("single_choice", 2), group("judgement", 1), group("single_choice", 3)])], f"exam_id bigint, chapter_range string, contexts array<{CONTEXT}>, question_groups array<{GROUP}>")
    q = E.generate_questions(b).where("pos = 2")
    made = [(r.pos, r.question_type, r.question_text.split(":")[0], r.references[0].chunk_id) for r in E.repair_questions(b, q).collect()]
    new = [(2, "single_choice", "Question 2 about x", "c2"), (3, "single_choice", "Question 3 about y", "c1"), (4, "judgement", "Question 1 about x", "c2"), (5, "single_choice", "Question 2 about x", "c1"), (6, "single_choice", "Question 3 about y", "c2")]
    assert sorted(made) == sorted([(2, "single_choice", "Question 2 about y", "c2"), *new])
    r = E.validate_exams(b.withColumn("knowledge_points", F.array(F.lit("x"), F.lit("y"))).withColumn("total_score", F.lit(6)), E.generate_questions(b)).first()
    assert (r.question_count_valid, r.score_valid) == (False, True)  # five of a type of which the last group wants three
