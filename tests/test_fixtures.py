"""Hand-made cases with the values they must give."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators import exams as E
from lectern.operators import lessons as L
from lectern.operators import metrics as M
from lectern.operators import tables as T
from lectern.operators.search import embed, search
from lectern.operators.usage import usage_summary


def one(spark, column):
    return spark.range(1).select(column.alias("x")).collect()[0].x


def test_metrics(spark):
    cases = spark.sql("SELECT array('a', 'b') AS expected, array('a', 'c') AS retrieved")
    r = M.retrieval_metrics(cases).collect()[0]
    assert (r.recall_at_k, r.hit_at_k, r.mrr, r.context_precision) == (0.5, 1.0, 1.0, 0.5) and r.ndcg == pytest.approx(0.6131471927654584)
    assert M.retrieval_metrics(cases.limit(0)).collect()[0].asDict() == dict.fromkeys(("recall_at_k", "hit_at_k", "mrr", "ndcg", "context_precision"), 0.0)
    twice = spark.sql("SELECT array('a') AS expected, array('a', 'a') AS retrieved")
    assert M.retrieval_metrics(twice).collect()[0].ndcg == pytest.approx(1.6309, abs=1e-4)
    counts = spark.sql("SELECT map('single_choice', 2, 'short_answer', 1) AS e, map('single_choice', 2, 'short_answer', 0) AS a")
    assert counts.select(M.count_accuracy(F.col("e"), F.col("a"))).collect()[0][0] == 0.5
    share = lambda rows: M.share(spark.createDataFrame(rows, "ok boolean"), F.col("ok"), "s").collect()[0].s
    assert share([(True,), (False,)]) == 0.5 and share([]) == 0.0
    files = spark.createDataFrame([("p", 3), ("q", 0)], "path string, length long")
    assert M.export_success_rate(spark.createDataFrame([("p",), ("missing",)], "file_path string"), files).collect()[0][0] == 0.5


def test_text_functions(spark):
    assert one(spark, X.strip(F.lit("　 a b\n"))) == "a b"
    assert one(spark, X.heading(F.lit("第3章 搜索"))) == "第3章" and one(spark, X.heading(F.lit("plain"))) == "" and one(spark, X.heading(F.lit("2024 was good"))) == "2024"
    assert one(spark, X.normal_judgement(F.lit("True"))) == "true" and one(spark, X.normal_judgement(F.lit("maybe"))) is None
    assert one(spark, X.split_answers(F.lit("A, B,,A"))) == ["A", "B"]
    assert one(spark, X.export_name(F.lit("AI Search"), F.lit(None), F.lit("lesson_design"), F.lit(None), ".docx")) == "AI_Search_lesson_design_export.docx"
    assert [one(spark, X.valid_key(F.lit(k))) for k in ("", "  ", "k", "x" * 256)] == [False, False, True, False]
    same = [one(spark, X.request_hash(F.lit(j))) for j in ('{"b": 1, "a": null}', '{"a":null,"b":1}', '{"a":1,"b":1}')]
    assert same[0] == same[1] != same[2]
    assert [a.minutes for a in one(spark, X.time_allocation(F.lit(15)))] == [5, 0, 5, 5]
    assert one(spark, X.interrupted(F.lit("content_filter"))) and not one(spark, X.interrupted(F.lit("STOP")))
    assert one(spark, X.dominant(F.expr("array(named_struct('pos', 0, 'key', 'easy', 'value', 0.4D), named_struct('pos', 1, 'key', 'hard', 'value', 0.4D))"))) == "easy"


def test_embedding_is_unit_or_zero(spark):
    v = one(spark, V.hashing_embedding(F.lit("state space search")))
    assert len(v) == 256 and sum(x * x for x in v) == pytest.approx(1)
    assert set(one(spark, V.hashing_embedding(F.lit("!!")))) == {0.0}


def test_search_stays_in_the_course(spark):
    rows = [("AI", "d1", "1", "textbook", "state space search and heuristic search"), ("AI", "d1", "2", "textbook", "planning"), ("Math", "d2", "3", "textbook", "linear algebra and matrix factorization")]
    chunks = embed(spark.createDataFrame(rows, "course_id string, document_id string, chunk_id string, source_type string, content string").withColumn("verified", F.lit(False)).withColumn("chapter", F.lit(None).cast("string")))
    query = lambda course: spark.createDataFrame([(1, course, "heuristic search")], "query_id int, course_id string, q string").select("query_id", "course_id", F.lit("").alias("chapter"), F.lit("").alias("source_type"), F.lit(None).cast("boolean").alias("verified_only"), V.hashing_embedding(F.col("q")).alias("embedding"))
    found = search(chunks, query("AI")).orderBy("rank").collect()
    assert [r.chunk_id for r in found] == ["1", "2"] and {r.course_id for r in found} == {"AI"} and found[0].score > found[1].score
    assert search(chunks, query("none")).count() == 0


def test_duplicates(spark):
    q = spark.createDataFrame([(1, 1, "same text here"), (1, 2, "same text here"), (2, 1, "alone")], "exam_id int, pos int, question_text string")
    pairs = E.duplicate_pairs(q, threshold=0.5)
    assert [(r.exam_id, r.i, r.j) for r in pairs.collect()] == [(1, 1, 2)]
    assert {r.exam_id: r.duplicate_rate for r in E.duplicate_rate(q, pairs).collect()} == {1: 1.0, 2: 0.0}


def test_admission(spark):
    up = spark.createDataFrame([("c", f"dir/{n}") for n in ("legacy.doc", "a.PDF", "b.exe", "noext")] + [("other", "a.pdf")], "course_id string, path string")
    got = {r.file_name: r.error_message for r in T.admit_documents(up, spark.createDataFrame([("c",)], "course_id string")).collect()}
    assert set(got) == {"legacy.doc", "a.PDF", "b.exe", "noext"} and "convert to .docx" in got["legacy.doc"] and got["a.PDF"] is None
    assert got["b.exe"] == "Unsupported file type: .exe" and got["noext"] == "Unsupported file type: <none>"


def slide(i, kind, title="t", bullets=("b",), refs=("chunk-1",), session=None):
    return (i, kind, title, list(bullets), None, [(r, None, None, None) for r in refs], session)


SLIDES = "lesson_id int, course_id string, total_sessions int, slide_count int, slides array<struct<slide_index:int,slide_type:string,title:string,bullet_points:array<string>,speaker_notes:string,references:array<struct<chunk_id:string,source_type:string,chapter:string,page:int>>,source_session_index:int>>, sessions array<struct<session_index:int,references:array<struct<chunk_id:string,source_type:string,chapter:string,page:int>>>>"


@pytest.mark.parametrize(("slides", "checks"), [
    ([slide(1, "title", refs=()), slide(2, "content", session=1), slide(3, "references")], {"passed": True, "citation_valid": True}),
    ([slide(1, "title", refs=()), slide(2, "content"), slide(3, "references")], {"source_session_valid": False}),
    ([slide(1, "title", refs=()), slide(2, "content", session=2), slide(3, "references")], {"source_session_valid": False}),
    ([slide(1, "title", refs=()), slide(2, "content", refs=("chunk-2",), session=1), slide(3, "references")], {"citation_present": True, "citation_grounded": False}),
    ([slide(1, "title", refs=()), slide(2, "objectives", refs=(), session=1), slide(3, "references")], {"passed": True}),
    ([slide(1, "title", refs=()), slide(2, "summary", refs=()), slide(3, "references")], {"citation_present": False, "citation_grounded": False}),
])
def test_slides(spark, slides, checks):
    df = spark.createDataFrame([(1, "c", 1, None, slides, [(1, [("chunk-1", None, None, None)])])], SLIDES)
    r = L.validate_slides(df).collect()[0]
    assert {k: r[k] for k in checks} == checks


def test_usage(spark):
    rows = [("a", "ok", False, 10, [("success",)], (5, 0, 5, "provider")), ("a", "ok", True, 20, [("failed",)], (7, 0, 7, "deepseek_v3_tokenizer")), ("b", "ok", True, 5, [], (None, None, None, "unavailable"))]
    df = spark.createDataFrame(rows, "prompt_name string, status string, fallback_used boolean, latency_ms long, attempts array<struct<status:string>>, usage struct<input_tokens:long,output_tokens:long,total_tokens:long,usage_source:string>").withColumn("run_id", F.lit(1))
    got = {r.prompt_name: r for r in usage_summary(df).collect()}
    whole = got[None]
    assert (whole.call_count, whole.failed_attempt_count, whole.fallback_count, whole.total_tokens, whole.latency_ms) == (3, 1, 2, 12, 35)
    assert whole.usage_source_counts == {"provider": 1, "deepseek_v3_tokenizer": 1, "unavailable": 1} and got["b"].total_tokens == 0
    none = usage_summary(df.where("prompt_name = 'b'")).collect()
    assert {r.total_tokens for r in none} == {None}


def test_build_takes_hooks_and_keeps_what_fails(spark):
    from lectern.operators.kb import build_kb

    docs = spark.createDataFrame([("c", "a", "t", "alpha beta", None), ("c", "b", "t", "", None), ("c", "x", "t", "unread", "bad file")], "course_id string, document_id string, source_type string, content string, error string")
    words = lambda content, most: F.slice(F.split(content, " "), 1, most)
    first, _ = build_kb(docs.withColumn("content", F.lit("old")).withColumn("error", F.lit(None).cast("string")))
    chunks, report = build_kb(docs, first.drop("embedding").withColumn("embedding", F.array(F.lit(0.0))), points=1, extractor=words, embedder=lambda text: F.array(F.length(text).cast("double")))
    assert {(r.document_id, r.content): (r.knowledge_points, r.embedding) for r in chunks.collect() if r.document_id == "a"} == {("a", "alpha beta"): (["alpha"], [10.0])}
    assert {r.document_id: r.content for r in chunks.collect()} == {"a": "alpha beta", "b": "old", "x": "old"}
    assert {r.document_id: (r.parse_status, r.chunk_count, r.error_message) for r in report.collect()} == {"a": ("built", 1, None), "b": ("failed", 0, "No text chunks were extracted from this document"), "x": ("failed", 0, "bad file")}


def test_duplicates_of_given_embeddings_are_the_brute_force(spark):
    import numpy as np

    from lectern.operators.exams import duplicate_pairs

    rng = np.random.default_rng(3)
    made = rng.normal(size=(60, 6)) * rng.integers(0, 2, (60, 6)) * rng.uniform(0.3, 1.5, (60, 1))
    rows = [(i % 3, i // 3 + 1, "", [float(x) for x in v]) for i, v in enumerate(made)]
    df = spark.createDataFrame(rows, "exam_id int, pos int, question_text string, vector array<double>")
    want = {(g, a, b) for g, a, _, x in rows for h, b, _, y in rows if g == h and a < b and round(float(np.dot(x, y)), 9) >= 0.85}
    assert {(r.exam_id, r.i, r.j) for r in duplicate_pairs(df, embeddings="vector").collect()} == want and len(want) > 5


def test_written_back_slides(spark):
    from lectern.operators.lessons import write_back

    slide = "struct<slide_index:int,title:string,bullet_points:array<string>,speaker_notes:string>"
    outlines = spark.createDataFrame([("l1", "c", "Course", "Chapter 1", [(1, "Intro", [f"p{i}" for i in range(12)], None), (2, "Core", ["a"], "say it")])], f"lesson_id string, course_id string, course_name string, chapter_range string, slides array<{slide}>")
    session = "struct<session_index:int,session_title:string,teaching_objectives:array<string>,key_points:array<string>,teaching_process:array<struct<content:string>>>"
    lessons = spark.createDataFrame([], f"lesson_id string, course_id string, course_name string, chapter_range string, sessions array<{session}>")
    questions = spark.createDataFrame([], "question_id string, course_id string, question_type string, knowledge_point string, question_text string, correct_answer string, explanation string, options array<struct<key:string,value:string>>")
    reviews = spark.createDataFrame([("r1", "ppt_outline", "l1", "c", "approved"), ("r2", "ppt_outline", "l1", "c", "rejected")], "review_id string, target_type string, target_id string, course_id string, review_status string")
    rows = {r.chunk_id: r for r in write_back(reviews, lessons, outlines, questions).collect()}
    assert set(rows) == {"review-r1-slide-1", "review-r1-slide-2"} and all(r.verified and r.source_type == "reviewed_ppt" for r in rows.values())
    assert rows["review-r1-slide-1"].content == "\n".join(["Course", "Chapter 1", "Intro", *[f"p{i}" for i in range(12)]]) and len(rows["review-r1-slide-1"].knowledge_points) == 10
    assert rows["review-r1-slide-2"].content == "Course\nChapter 1\nCore\na\nsay it"
