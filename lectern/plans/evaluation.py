"""Queries on evaluation cases and on single checks of exams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import exams as E
from lectern.operators import lessons as L
from lectern.operators import metrics as M
from lectern.plans.base import Tables, query
from lectern.plans.ingest import KEY, benchmark_chunks, benchmark_search, benchmark_sql
from lectern.plans.relational import LABELLED_SQL, LABELS_SQL, described_search
from lectern.plans.teaching import DAMAGED_SQL, EXAM_SQL, SLIDE_SQL, _damaged, _lessons, exam_blueprints


@query(f"WITH {EXAM_SQL} SELECT exam_id, question_type, count(*) AS n FROM qs GROUP BY ALL")
def d04_question_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.question_type_counts(E.generate_questions(exam_blueprints(Tables(spark, sf_dir))))


@query(f"WITH {DAMAGED_SQL}, t AS (SELECT e AS exam_id, sum(cnt * score)::bigint AS planned FROM groups GROUP BY ALL), s AS (SELECT exam_id, sum(score)::bigint AS s FROM dq GROUP BY ALL) SELECT exam_id, planned, coalesce(s, 0) AS actual, planned = coalesce(s, 0) AS score_valid FROM t LEFT JOIN s USING (exam_id)")
def d05_score_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    return E.score_check(b, _damaged(E.generate_questions(b))).withColumn("planned", F.col("planned").cast("long"))


@query(f"WITH {EXAM_SQL} SELECT exam_id, pos FROM qs WHERE exam_id % 6 = 0 AND pos = 1")
def c07_uncovered_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    q = E.generate_questions(b).withColumn("knowledge_point", F.when((F.col("exam_id") % 6 == 0) & (F.col("pos") == 1), F.lit("-")).otherwise(F.col("knowledge_point")))
    return E.uncovered_points(b, q).select("exam_id", "pos")


@query("""SELECT a.label AS exam_id, a.vec_id AS i, b.vec_id AS j, round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::double * b.embedding[k]::double)), 4) AS similarity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE round(list_sum(list_transform(range(1, 65), lambda k: a.embedding[k]::double * b.embedding[k]::double)), 9) >= 0.3""")
def m04_embedded_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of all vectors of a label whose dot product reaches 0.3, with the vectors as they are given."""
    vectors = Tables(spark, sf_dir).vectors().withColumn("exam_id", F.col("label"))
    return E.duplicate_pairs(vectors, pos="vec_id", threshold=0.3, embeddings="embedding").withColumn("similarity", F.round("similarity", 4))


@query("SELECT l_orderkey AS exam_id, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_extendedprice) AS order_no FROM lineitem")
def f03_questions_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = Tables(spark, sf_dir).lineitem.select(F.col("l_orderkey").alias("exam_id"), "l_partkey", F.col("l_shipdate").alias("created_at"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("pos"))
    return E.questions_in_order(q).select("exam_id", "l_partkey", F.col("order_no").cast("long").alias("order_no"))


@query(f"""WITH {SLIDE_SQL}, {EXAM_SQL.replace("ctx AS", "ctx2 AS").replace("FROM ctx ", "FROM ctx2 ").replace("FROM ctx)", "FROM ctx2)").replace("tok AS", "tok2 AS").replace("FROM tok ", "FROM tok2 ").replace("firsts AS", "firsts2 AS").replace("FROM firsts)", "FROM firsts2)").replace("ranked AS", "ranked2 AS").replace("FROM ranked ", "FROM ranked2 ").replace("pts AS", "pts2 AS").replace("JOIN pts ON pts.", "JOIN pts2 ON pts2.").replace(", refs AS (", ", xrefs AS (").replace("JOIN refs ON refs.e", "JOIN xrefs ON xrefs.e")},
x AS (SELECT 'citation' AS case_kind, true AS cited, NULL::boolean AS ok FROM sessions UNION ALL SELECT 'citation', exam_id % 13 <> 0, NULL FROM qs WHERE NOT (exam_id % 7 = 0 AND pos = 1) UNION ALL SELECT 'answer', NULL, exam_id % 11 <> 0 FROM qs WHERE NOT (exam_id % 7 = 0 AND pos = 1)
UNION ALL SELECT 'citation', n_refs > 0, NULL FROM slides WHERE kind <> 'title' UNION ALL SELECT 'export', NULL, NULL FROM supplier)
SELECT case_kind, count(*) AS n, count(*) FILTER (WHERE cited) AS n_cited, count(*) FILTER (WHERE ok) AS n_ok FROM x GROUP BY ALL""")
def d21_eval_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    lessons, b = _lessons(t), exam_blueprints(t)
    sessions = lessons.select(F.concat_ws(":", F.col("lesson_id").cast("string"), F.col("total_sessions").cast("string")).alias("lesson_id"), F.explode("sessions").alias("s")).select("lesson_id", "s.references")
    questions = _damaged(E.generate_questions(b)).withColumn("question_id", F.concat_ws(":", F.col("exam_id").cast("string"), F.col("pos").cast("string")))
    slides = L.outline_slides(lessons).select("lesson_id", F.explode("slides").alias("s")).select(F.col("lesson_id").alias("slide_id"), "s.slide_type", "s.references")
    cases = M.eval_cases(sessions, questions, slides, t.supplier.select(F.col("s_suppkey").alias("export_id"), F.col("s_name").alias("file_path")))
    return cases.groupBy("case_kind").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.size("citation_chunk_ids") > 0, 1)).alias("n_cited"), F.count(F.when(F.col("ok"), 1)).alias("n_ok"))


METRICS_SQL = """measured AS (SELECT query_id, count(*) AS n, count(*) FILTER (WHERE hit) AS h, coalesce(1 / min(rank) FILTER (WHERE hit), 0) AS rr, sum(CASE WHEN hit THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM hits GROUP BY ALL)
SELECT round(avg((h > 0)::int), 6) AS recall_at_k, round(avg((h > 0)::int), 6) AS hit_at_k, round(avg(rr), 6) AS mrr, round(avg(CASE WHEN h = 0 THEN 0 ELSE dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, h + 1) AS s(i)) END), 6) AS ndcg, round(avg(h / n), 6) AS context_precision FROM measured"""


@query(f"WITH {LABELLED_SQL}, {METRICS_SQL}")
def i05_evaluate_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search of all vectors, labelled by terms of what it found and measured."""
    r = M.evaluate_results(*described_search(Tables(spark, sf_dir)))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


def _benchmark_cases(t: Tables) -> DataFrame:
    """Every benchmark text as a case; its first two keywords are the terms of a relevant chunk."""
    return t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), X.keywords(F.col("text"), 2).alias("terms"))


SEARCHED_SQL = rf"""WITH RECURSIVE {benchmark_sql()}, k AS (SELECT item_id, unnest(regexp_extract_all(text, '{KEY}')) AS w, generate_subscripts(regexp_extract_all(text, '{KEY}'), 1) AS i FROM benchmark),
terms AS (SELECT item_id, list(lower(w) ORDER BY i)[1:2] AS terms FROM (SELECT item_id, w, min(i) AS i FROM k GROUP BY ALL) GROUP BY item_id),
hits AS (SELECT item_id AS query_id, rank, len(list_filter(coalesce(terms, []), lambda w: NOT contains(lower(content), w))) = 0 AS hit FROM found JOIN ids USING (id) LEFT JOIN terms USING (item_id))"""


@query(f"{SEARCHED_SQL} {LABELS_SQL}")
def b07_labels_of_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of what a search over the chunks of all documents retrieves."""
    t = Tables(spark, sf_dir)
    out = M.relevance_labels(benchmark_search(t), _benchmark_cases(t))
    return out.select("query_id", F.size("retrieved").cast("long").alias("n_retrieved"), F.size("expected").cast("long").alias("n_expected"), F.exists("expected", lambda x: x.startswith("__missing__:")).alias("missing"))


@query(f"{SEARCHED_SQL}, {METRICS_SQL}")
def i05_evaluate_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval over the chunks of all documents, labels and metrics."""
    t = Tables(spark, sf_dir)
    r = M.evaluate_retrieval(benchmark_chunks(t), _benchmark_cases(t).withColumn("course_id", F.lit("all")), 8, digits=9)
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])
