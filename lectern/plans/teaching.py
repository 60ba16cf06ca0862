"""Queries on exams, lessons and slides.  An order is an exam with its line items' parts as contexts; a customer is a lesson with its orders as contexts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import exams as E
from lectern.operators import lessons as L
from lectern.operators.lineage import once, stored
from lectern.plans.base import Tables, query
from lectern.plans.ingest import EMBED_SQL, KEY

EXAM_SQL = rf"""ctx AS (SELECT l_orderkey AS e, l_linenumber * 1000000 + l_partkey AS rank, 'p' || l_partkey AS chunk, p_name AS content FROM lineitem JOIN part ON p_partkey = l_partkey),
tok AS (SELECT e, rank, unnest(regexp_extract_all(content, '{KEY}')) AS w, generate_subscripts(regexp_extract_all(content, '{KEY}'), 1) AS i FROM ctx),
firsts AS (SELECT e, w, min(rank * 100 + i) AS o FROM tok GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY o) AS n FROM firsts),
pts AS (SELECT e, list(w ORDER BY o) AS points FROM ranked WHERE n <= 20 GROUP BY e), refs AS (SELECT e, list(chunk ORDER BY rank, chunk) AS refs FROM ctx GROUP BY e),
plan AS (SELECT o_orderkey AS e, o_orderpriority AS ch, coalesce(points, [o_orderpriority]) AS points, coalesce(refs, ['manual-context']) AS refs FROM orders LEFT JOIN pts ON pts.e = o_orderkey LEFT JOIN refs ON refs.e = o_orderkey),
g0 AS (SELECT e, ch, points, refs, 0 AS g, 'single_choice' AS kind, (e % 3)::int AS cnt, 2 AS score FROM plan UNION ALL SELECT e, ch, points, refs, 1, 'multiple_choice', (e % 2)::int, 4 FROM plan
UNION ALL SELECT e, ch, points, refs, 2, 'judgement', 1, 1 FROM plan UNION ALL SELECT e, ch, points, refs, 3, 'short_answer', CASE WHEN e % 4 = 0 THEN 1 ELSE 0 END, 10 FROM plan),
groups AS (SELECT *, points[1:greatest(1, least(len(points), cnt))] AS gp, coalesce(sum(cnt) OVER (PARTITION BY e ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS off FROM g0 WHERE cnt > 0),
idx AS (SELECT *, unnest(range(1, cnt + 1)) AS i FROM groups),
qs AS (SELECT e AS exam_id, (off + i)::int AS pos, kind AS question_type, score, gp[(i - 1) % len(gp) + 1] AS point, refs[(off + i - 1) % len(refs) + 1] AS ref,
'Question ' || i || ' about ' || gp[(i - 1) % len(gp) + 1] || CASE kind WHEN 'single_choice' THEN ': which option best matches this knowledge point?' WHEN 'multiple_choice' THEN ': which statements are related to this knowledge point?'
WHEN 'judgement' THEN ': ' || gp[(i - 1) % len(gp) + 1] || ' can be analyzed with examples from the course materials.' ELSE ': briefly explain the concept and give one course-based example.' END AS question_text FROM idx)"""


def exam_blueprints(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    group = lambda pos, kind, count, score: F.struct(F.lit(pos).alias("pos"), F.lit(kind).alias("question_type"), count.cast("int").alias("count"), F.lit(score).alias("score_each"))
    groups = F.array(group(0, "single_choice", k % 3, 2), group(1, "multiple_choice", k % 2, 4), group(2, "judgement", F.lit(1), 1), group(3, "short_answer", F.when(k % 4 == 0, 1).otherwise(0), 10))
    level = lambda pos, name, v: F.struct(F.lit(pos).alias("pos"), F.lit(name).alias("key"), v.cast("double").alias("value"))
    params = t.orders.select(k.alias("exam_id"), F.col("o_orderpriority").alias("chapter_range"), F.col("o_orderstatus").alias("course_name"), groups.alias("groups"), F.array(level(0, "easy", k % 3), level(1, "medium", k % 2), level(2, "hard", F.lit(1))).alias("difficulties"))
    contexts = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_orderkey").alias("exam_id"), (F.col("l_linenumber").cast("long") * 1000000 + F.col("l_partkey")).alias("rank"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("chunk_id"),
        F.lit("textbook").alias("source_type"), F.lit(None).cast("string").alias("chapter"), F.col("l_linenumber").cast("int").alias("page"), F.col("p_name").alias("content"))
    return E.plan_blueprints(params, contexts.withColumn("rank", F.col("rank").cast("int")))


@query(f"""WITH {EXAM_SQL} SELECT e AS exam_id, array_to_string(any_value(points), ',') AS points, sum(cnt * score)::bigint AS total_score, count(*) AS n_groups, CASE WHEN e % 3 >= 1 AND e % 3 >= e % 2 THEN 'easy' WHEN e % 2 = 1 THEN 'medium' ELSE 'hard' END AS difficulty,
string_agg(array_to_string(gp, '/'), ';' ORDER BY g) AS group_points FROM groups GROUP BY e""")
def j01_plan_blueprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    return b.select(
        "exam_id", F.array_join("knowledge_points", ",").alias("points"), F.col("total_score").cast("long").alias("total_score"), F.size("question_groups").cast("long").alias("n_groups"), F.col("question_groups")[0]["difficulty"].alias("difficulty"),
        F.array_join(F.transform("question_groups", lambda g: F.array_join(g["knowledge_points"], "/")), ";").alias("group_points"))


@query(f"WITH {EXAM_SQL} SELECT * FROM qs")
def j02_generate_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.generate_questions(exam_blueprints(Tables(spark, sf_dir)))
    return q.select("exam_id", "pos", "question_type", "score", F.col("knowledge_point").alias("point"), F.col("references")[0]["chunk_id"].alias("ref"), "question_text")


@query(f"WITH {EXAM_SQL} SELECT e AS exam_id, kind AS question_type, off AS reference_offset FROM groups")
def e02_reference_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = E._groups(exam_blueprints(Tables(spark, sf_dir)))
    return g.select("exam_id", F.col("g.question_type").alias("question_type"), "reference_offset")


def _damaged(q: DataFrame) -> DataFrame:
    """Some exams lose their first question, some an explanation, some a reference."""
    return q.where("not (exam_id % 7 = 0 and pos = 1)").withColumn("explanation", F.when(F.col("exam_id") % 11 == 0, "").otherwise(F.col("explanation"))).withColumn("references", F.when(F.col("exam_id") % 13 == 0, F.slice("references", 1, 0)).otherwise(F.col("references")))


DAMAGED_SQL = EXAM_SQL + """, dq AS (SELECT *, exam_id % 11 = 0 AS no_why, exam_id % 13 = 0 AS no_ref FROM qs WHERE NOT (exam_id % 7 = 0 AND pos = 1)),
want AS (SELECT e AS exam_id, kind AS question_type, cnt FROM groups), have AS (SELECT exam_id, question_type, count(*) AS n FROM dq GROUP BY ALL),
counts AS (SELECT want.exam_id, want.question_type, cnt AS expected, coalesce(n, 0)::int AS actual FROM want LEFT JOIN have USING (exam_id, question_type))"""


@query(f"WITH {DAMAGED_SQL} SELECT *, expected = actual AS valid FROM counts")
def c05_count_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    groups = b.select("exam_id", F.posexplode("question_groups").alias("pos", "g")).select("exam_id", "pos", "g.question_type", "g.count")
    return E.count_mismatch(groups, _damaged(E.generate_questions(b)))


@query(f"""WITH {EXAM_SQL}, src AS (SELECT exam_id || ':' || pos AS id, question_text AS body FROM qs), {EMBED_SQL},
x AS (SELECT split_part(id, ':', 1)::bigint AS exam_id, split_part(id, ':', 2)::int AS pos, slot, weight FROM e)
SELECT a.exam_id, a.pos AS i, b.pos AS j, round(sum(a.weight * b.weight), 5) AS similarity FROM x a JOIN x b ON a.exam_id = b.exam_id AND a.slot = b.slot AND a.pos < b.pos GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 0.7""")
def c02_duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.generate_questions(exam_blueprints(Tables(spark, sf_dir)))
    return E.duplicate_pairs(q, threshold=0.7).withColumn("similarity", F.round("similarity", 5))


@query(f"""WITH {EXAM_SQL}, src AS (SELECT exam_id || ':' || pos AS id, question_text AS body FROM qs), {EMBED_SQL},
x AS (SELECT split_part(id, ':', 1)::bigint AS exam_id, split_part(id, ':', 2)::int AS pos, slot, weight FROM e),
p AS (SELECT a.exam_id, a.pos, b.pos AS j FROM x a JOIN x b ON a.exam_id = b.exam_id AND a.slot = b.slot AND a.pos < b.pos GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 0.7),
n AS (SELECT exam_id, count(*) AS n FROM qs GROUP BY ALL), c AS (SELECT exam_id, count(*) AS n_pairs FROM p GROUP BY ALL)
SELECT exam_id, n, coalesce(n_pairs, 0) AS n_pairs, CASE WHEN n < 2 THEN 0 ELSE round(coalesce(n_pairs, 0) / (n * (n - 1) / 2), 6) END AS duplicate_rate FROM n LEFT JOIN c USING (exam_id)""")
def d06_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = E.generate_questions(exam_blueprints(Tables(spark, sf_dir)))
    return E.duplicate_rate(q, E.duplicate_pairs(q, threshold=0.7)).withColumn("duplicate_rate", F.round("duplicate_rate", 6))


@query(f"""WITH {DAMAGED_SQL}, c AS (SELECT exam_id, bool_and(expected = actual) AS ok FROM counts GROUP BY ALL), t AS (SELECT e AS exam_id, sum(cnt * score) AS total FROM groups GROUP BY ALL),
q AS (SELECT exam_id, sum(score) AS s, bool_and(NOT no_why) AS why, bool_and(NOT no_ref) AS ref FROM dq GROUP BY ALL)
SELECT exam_id, ok AS question_count_valid, total = coalesce(s, 0) AS score_valid, coalesce(why, true) AS explanation_valid, coalesce(ref, true) AS citation_valid, ok AND total = coalesce(s, 0) AND coalesce(why, true) AND coalesce(ref, true) AS passed FROM t JOIN c USING (exam_id) LEFT JOIN q USING (exam_id)""")
def k01_validate_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = stored(exam_blueprints(Tables(spark, sf_dir)))
    r = E.validate_exams(b, _damaged(E.generate_questions(b)), threshold=0.999, max_duplicate_rate=1.0)
    return r.select("exam_id", "question_count_valid", "score_valid", "explanation_valid", "citation_valid", "passed")


@query(f"""WITH {DAMAGED_SQL}, total AS (SELECT exam_id, count(*) AS total FROM dq GROUP BY ALL),
m AS (SELECT g.*, c.actual, expected - actual AS missing, coalesce(sum(expected - actual) OVER (PARTITION BY e ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS before, coalesce(total, 0) AS total FROM groups g JOIN counts c ON c.exam_id = g.e AND c.question_type = g.kind LEFT JOIN total t ON t.exam_id = g.e),
n AS (SELECT *, unnest(range(0, missing)) AS o FROM m WHERE missing > 0)
SELECT exam_id, question_type, question_text, ref FROM (SELECT exam_id, question_type, question_text, CASE WHEN no_ref THEN NULL ELSE ref END AS ref FROM dq)
UNION ALL SELECT e, kind, 'Question ' || (actual + o + 1) || ' about ' || gp[o % len(gp) + 1] || CASE kind WHEN 'single_choice' THEN ': which option best matches this knowledge point?' WHEN 'multiple_choice' THEN ': which statements are related to this knowledge point?'
WHEN 'judgement' THEN ': ' || gp[o % len(gp) + 1] || ' can be analyzed with examples from the course materials.' ELSE ': briefly explain the concept and give one course-based example.' END, refs[(total + before + o) % len(refs) + 1] FROM n""")
def j03_repair_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    q = E.repair_questions(b, _damaged(E.generate_questions(b)))
    return q.select("exam_id", "question_type", "question_text", F.try_element_at("references", F.lit(1))["chunk_id"].alias("ref"))


@query(f"""WITH {DAMAGED_SQL}, n AS (SELECT exam_id, count(*) AS n FROM dq GROUP BY ALL), all_e AS (SELECT DISTINCT e AS exam_id FROM groups), left_q AS (SELECT exam_id, coalesce(n, 0) AS n FROM all_e LEFT JOIN n USING (exam_id))
SELECT exam_id, NOT (n > 0 AND (exam_id % 11 = 0 OR exam_id % 13 = 0)) AS passed, CASE WHEN n > 0 AND (exam_id % 11 = 0 OR exam_id % 13 = 0) THEN 2 WHEN exam_id % 7 = 0 THEN 1 ELSE 0 END AS repair_attempts FROM left_q""")
def j11_repair_loop(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Exams without any question are rows of the report too, so the loop runs over blueprints that carry their questions.
    exams = E.gather_questions(exam_blueprints(Tables(spark, sf_dir)))
    k, names = F.col("exam_id"), exams.schema["questions"].dataType.elementType.names
    kept = F.filter("questions", lambda q: ~((k % 7 == 0) & (q["pos"] == 1)))
    lost = lambda q: {"explanation": F.when(k % 11 == 0, "").otherwise(q["explanation"]), "references": F.when(k % 13 == 0, F.slice(q["references"], 1, 0)).otherwise(q["references"])}
    exams = once(exams, questions=F.transform(kept, lambda q: L._with(q, names, **lost(q))))
    validate = lambda r: E.validate_gathered(r, threshold=0.999, max_duplicate_rate=1.0)
    return E.repair_loop(exams, validate, E.repair_gathered).select("exam_id", "passed", "repair_attempts")


@query(f"""WITH {DAMAGED_SQL} SELECT exam_id, pos, (CASE WHEN no_why THEN 1 ELSE 0 END + CASE WHEN question_type = 'judgement' AND exam_id % 5 = 0 THEN 1 ELSE 0 END)::int AS n_violations, CASE WHEN question_type = 'judgement' THEN CASE WHEN exam_id % 5 = 0 THEN 'maybe' ELSE 'true' END END AS answer FROM dq""")
def k04_check_question_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _damaged(E.generate_questions(exam_blueprints(Tables(spark, sf_dir))))
    said = F.when(F.col("question_type") == "judgement", F.when(F.col("exam_id") % 5 == 0, "maybe").otherwise(" True ")).otherwise(F.col("correct_answer"))
    r = E.check_question_schema(q.withColumn("correct_answer", said))
    return r.select("exam_id", "pos", F.size("violations").alias("n_violations"), F.when(F.col("question_type") == "judgement", F.col("correct_answer")).alias("answer"))


@query("""SELECT o_orderkey AS exam_id, CASE WHEN o_orderkey % 3 = 0 THEN 'no questions' WHEN o_orderkey % 3 = 1 THEN 'negative count' ELSE '' END AS violations FROM orders""")
def k07_check_exam_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    g = lambda pos, count: F.struct(F.lit(pos).alias("pos"), F.lit("judgement").alias("question_type"), count.cast("int").alias("count"), F.lit(2).alias("score_each"))
    params = Tables(spark, sf_dir).orders.select(k.alias("exam_id"), F.array(g(0, F.when(k % 3 == 0, 0).when(k % 3 == 1, -1).otherwise(1)), g(1, F.when(k % 3 == 0, 0).otherwise(2))).alias("groups"))
    return E.check_exam_params(params).select("exam_id", F.array_join("violations", ",").alias("violations"))


@query(f"""WITH {EXAM_SQL}, n AS (SELECT exam_id, count(*) AS n, sum(CASE WHEN question_type IN ('single_choice', 'multiple_choice') THEN 4 ELSE 0 END) AS o FROM qs GROUP BY ALL)
SELECT exam_id, role, (3 + CASE role WHEN 'student_exam' THEN 2 * n + o WHEN 'teacher_answer' THEN 2 * n + o WHEN 'explanation' THEN 4 * n + o ELSE n END)::bigint AS n_lines FROM n, (VALUES ('student_exam'), ('teacher_answer'), ('explanation'), ('answer_sheet')) AS r(role)""")
def j12_render_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = exam_blueprints(Tables(spark, sf_dir))
    return E.render_exams(b, E.generate_questions(b)).groupBy("exam_id", "role").agg(F.count(F.lit(1)).alias("n_lines"))


LESSON_SQL = rf"""ctx AS (SELECT o_custkey AS e, o_orderkey AS rank, 'o' || o_orderkey AS chunk, o_orderpriority AS content FROM orders),
tok AS (SELECT e, rank, unnest(regexp_extract_all(content, '{KEY}')) AS w, generate_subscripts(regexp_extract_all(content, '{KEY}'), 1) AS i FROM ctx),
firsts AS (SELECT e, w, min(rank * 100 + i) AS o FROM tok GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY o) AS n FROM firsts),
pts AS (SELECT e, list(w ORDER BY o) AS points FROM ranked WHERE n <= 12 GROUP BY e), refs AS (SELECT e, list(chunk ORDER BY rank) AS refs FROM ctx GROUP BY e),
lessons AS (SELECT c_custkey AS e, c_name AS course, c_mktsegment AS ch, (2 + c_custkey % 3)::int AS total, (30 + 15 * (c_custkey % 3))::int AS dur, CASE WHEN c_custkey % 2 = 0 THEN 'Focus ' || c_nationkey ELSE '' END AS focus,
coalesce(points, [c_mktsegment]) AS points, coalesce(refs, ['manual-context'])[1:greatest(1, least(coalesce(len(refs), 0), (2 + c_custkey % 3)::int))] AS refs FROM customer LEFT JOIN pts ON pts.e = c_custkey LEFT JOIN refs ON refs.e = c_custkey),
si AS (SELECT *, unnest(range(1, total + 1))::int AS s, greatest(1, len(points) // total) AS b FROM lessons),
sc AS (SELECT *, points[(s - 1) * b + 1 : CASE WHEN s = total THEN len(points) ELSE s * b END][1:5] AS cut FROM si),
sessions AS (SELECT *, CASE WHEN len(cut) > 0 THEN cut ELSE points[1:1] END AS sp, refs[(s - 1) % len(refs) + 1] AS ref FROM sc)"""


def lesson_plans(t: Tables) -> DataFrame:
    k = F.col("c_custkey")
    params = t.customer.select(
        k.alias("lesson_id"), F.lit("course").alias("course_id"), F.col("c_name").alias("course_name"), F.col("c_mktsegment").alias("chapter_range"), (2 + k % 3).cast("int").alias("total_sessions"), (30 + 15 * (k % 3)).cast("int").alias("session_duration"),
        F.when(k % 2 == 0, F.concat(F.lit("Focus "), F.col("c_nationkey").cast("string"))).otherwise("").alias("teaching_focus"), F.when(k % 3 != 0, 4 + k % 6).cast("int").alias("slide_count"), (k % 2 == 0).alias("include_references"))
    contexts = t.orders.select(F.col("o_custkey").alias("lesson_id"), F.col("o_orderkey").cast("int").alias("rank"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"), F.lit(None).cast("string").alias("source_type"), F.lit(None).cast("string").alias("chapter"), F.lit(0).alias("page"), F.col("o_orderpriority").alias("content"))
    return L.plan_sessions(params, contexts)


@query(f"WITH {LESSON_SQL} SELECT e AS lesson_id, array_to_string(points, ',') AS points FROM lessons")
def j00_lesson_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lesson_plans(Tables(spark, sf_dir)).select("lesson_id", F.array_join("knowledge_points", ",").alias("points"))


@query(f"""WITH {LESSON_SQL} SELECT e AS lesson_id, s AS session_index, ch || ' - ' || sp[1] AS title, array_to_string(sp, ',') AS points, CASE WHEN focus <> '' THEN focus ELSE 'Understand ' || sp[1] END AS focus, array_to_string(sp[greatest(len(sp) - 1, 1):], ',') AS difficulty, dur AS duration FROM sessions""")
def j04_plan_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lesson_plans(Tables(spark, sf_dir)).select("lesson_id", F.explode("session_plan").alias("p"))
    return p.select("lesson_id", "p.session_index", F.col("p.session_title").alias("title"), F.array_join("p.knowledge_points", ",").alias("points"), F.col("p.teaching_focus").alias("focus"), F.array_join("p.difficulty_points", ",").alias("difficulty"), "p.duration")


@query(f"""WITH {LESSON_SQL} SELECT e AS lesson_id, s AS session_index, array_to_string(list_transform(sp[1:3], lambda x: 'Explain ' || x), ';') AS objectives, 'Discuss ' || sp[1] || ' in groups.' AS interaction, ref, '核心概念讲解: ' || array_to_string(sp[1:3], ', ') AS lecture FROM sessions""")
def j05_assemble_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.assemble_lessons(lesson_plans(Tables(spark, sf_dir))).select("lesson_id", F.explode("sessions").alias("s"))
    return s.select("lesson_id", "s.session_index", F.array_join("s.teaching_objectives", ";").alias("objectives"), F.col("s.interaction_design")[0].alias("interaction"), F.col("s.references")[0]["chunk_id"].alias("ref"), F.col("s.teaching_process")[1]["content"].alias("lecture"))


def _lessons(t: Tables) -> DataFrame:
    return L.assemble_lessons(lesson_plans(t))


def _bare(lessons: DataFrame) -> DataFrame:
    """Lessons of which every fifth has sessions without references and every seventh without objectives."""
    names, k = lessons.schema["sessions"].dataType.elementType.names, F.col("lesson_id")
    cut = lambda s, n, when: F.when(when, F.slice(s[n], 1, 0)).otherwise(s[n])
    return once(lessons, sessions=F.transform("sessions", lambda s: L._with(s, names, references=cut(s, "references", k % 5 == 0), teaching_objectives=cut(s, "teaching_objectives", k % 7 == 0))))


@query("""SELECT c_custkey AS lesson_id, true AS session_count_valid, true AS time_allocation_valid, c_custkey % 7 <> 0 AS required_fields_valid, c_custkey % 5 <> 0 AS citation_valid, (c_custkey % 7 = 0)::int + (c_custkey % 5 = 0)::int AS n_errors, c_custkey % 7 <> 0 AND c_custkey % 5 <> 0 AS passed FROM customer""")
def k02_validate_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = L.validate_lessons(_bare(_lessons(Tables(spark, sf_dir))))
    return r.select("lesson_id", "session_count_valid", "time_allocation_valid", "required_fields_valid", "citation_valid", F.size("errors").alias("n_errors"), "passed")


@query(f"""WITH {LESSON_SQL} SELECT e AS lesson_id, s AS session_index, CASE WHEN e % 5 = 0 THEN refs[1] ELSE ref END AS ref, CASE WHEN e % 7 = 0 THEN 'Explain ' || ch || ' - ' || sp[1] ELSE 'Explain ' || sp[1] END AS objective FROM sessions""")
def j06_repair_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.repair_lessons(_bare(_lessons(Tables(spark, sf_dir)))).select("lesson_id", F.explode("sessions").alias("s"))
    return s.select("lesson_id", "s.session_index", F.col("s.references")[0]["chunk_id"].alias("ref"), F.col("s.teaching_objectives")[0].alias("objective"))


@query(f"""WITH {LESSON_SQL} SELECT e AS lesson_id, s AS session_index, CASE WHEN s = least(CASE WHEN e % 5 BETWEEN 1 AND total THEN e % 5 ELSE 1 END, total) THEN CASE WHEN e % 2 = 0 THEN 5 ELSE 4 END ELSE 4 END AS n_steps,
CASE WHEN s = CASE WHEN e % 5 BETWEEN 1 AND total THEN e % 5 ELSE 1 END AND e % 2 = 1 THEN 2 ELSE 1 END AS n_interactions, 'Updated session ' || (CASE WHEN e % 5 BETWEEN 1 AND total THEN e % 5 ELSE 1 END) || ': session ' || (e % 5) AS summary FROM sessions""")
def j07_revise_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = _lessons(Tables(spark, sf_dir))
    requests = lessons.select("lesson_id", F.concat(F.lit("session "), (F.col("lesson_id") % 5).cast("string")).alias("target_scope"), F.lit("slower").alias("feedback_text"), (F.col("lesson_id") % 2 == 1).alias("keep_unchanged_parts"))
    s = L.revise_lessons(lessons, requests).select("lesson_id", "modification_summary", F.explode("sessions").alias("s"))
    return s.select("lesson_id", "s.session_index", F.size("s.teaching_process").alias("n_steps"), F.size("s.interaction_design").alias("n_interactions"), F.col("modification_summary").alias("summary"))


SLIDE_SQL = LESSON_SQL + """, dr AS (SELECT e, list(ref ORDER BY s) AS all_refs, list(DISTINCT ref) AS d FROM sessions GROUP BY e), firsts_r AS (SELECT e, ref, min(s) AS s FROM sessions GROUP BY ALL), refl AS (SELECT e, list(ref ORDER BY s) AS refs2 FROM firsts_r GROUP BY e),
raw AS (SELECT e, 0 AS o, 'title' AS kind, course || ': ' || ch AS title, NULL::varchar AS ref, 0 AS n_refs, NULL::int AS s FROM lessons
UNION ALL SELECT e, s * 2, 'objectives', 'Session ' || s || ': Objectives', ref, 1, s FROM sessions UNION ALL SELECT e, s * 2 + 1, 'content', 'Session ' || s || ': Key Points', ref, 1, s FROM sessions
UNION ALL SELECT lessons.e, 1000, 'references', 'Source References', refs2[1], least(8, len(refs2)), NULL FROM lessons JOIN refl USING (e) WHERE lessons.e % 2 = 0),
cnt AS (SELECT e, count(*) AS n, CASE WHEN e % 3 <> 0 THEN 4 + e % 6 END AS want FROM raw GROUP BY e),
num AS (SELECT raw.*, n, want, row_number() OVER (PARTITION BY raw.e ORDER BY o) AS r FROM raw JOIN cnt USING (e)),
kept AS (SELECT e, o, kind, title, ref, n_refs, s FROM num WHERE want IS NULL OR n <= want OR (e % 2 = 0 AND (r < want OR kind = 'references')) OR (e % 2 = 1 AND r <= want)),
act AS (SELECT cnt.e, 900 AS o, 'activity' AS kind, 'Classroom Activity' AS title, refs2[1] AS ref, 1 AS n_refs, NULL::int AS s FROM cnt JOIN refl USING (e), range(0, 20) AS t(i) WHERE want IS NOT NULL AND i < want - n),
slides AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY o)::int AS slide_index FROM (SELECT * FROM kept UNION ALL SELECT * FROM act))"""


@query(f"WITH {SLIDE_SQL} SELECT e AS lesson_id, slide_index, kind AS slide_type, title, ref, n_refs::int AS n_refs, s AS session_index FROM slides")
def j08_outline_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.outline_slides(_lessons(Tables(spark, sf_dir))).select("lesson_id", F.explode("slides").alias("s"))
    return s.select("lesson_id", "s.slide_index", "s.slide_type", "s.title", F.try_element_at("s.references", F.lit(1))["chunk_id"].alias("ref"), F.size("s.references").alias("n_refs"), F.col("s.source_session_index").alias("session_index"))


@query(f"WITH {SLIDE_SQL} SELECT e AS lesson_id, count(*) AS n_slides, count(*) FILTER (WHERE kind = 'activity') AS n_activities, any_value(CASE WHEN e % 3 <> 0 THEN 4 + e % 6 END) AS wanted FROM slides GROUP BY e")
def j09_fit_slide_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = L.outline_slides(_lessons(Tables(spark, sf_dir)))
    return o.select("lesson_id", F.size("slides").cast("long").alias("n_slides"), F.size(F.filter("slides", lambda s: s["slide_type"] == "activity")).cast("long").alias("n_activities"), F.col("slide_count").cast("long").alias("wanted"))


@query(f"WITH {LESSON_SQL}, f AS (SELECT e, ref, min(s) AS s FROM sessions GROUP BY ALL) SELECT e AS lesson_id, string_agg(ref, ',' ORDER BY s) AS refs FROM f GROUP BY e")
def g01_distinct_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lessons(Tables(spark, sf_dir)).select("lesson_id", F.array_join(F.transform(L.distinct_references(F.col("sessions")), lambda r: r["chunk_id"]), ",").alias("refs"))


def _stripped(outlines: DataFrame) -> DataFrame:
    """Outlines whose slides lost their references where the lesson's number divides by 3, and whose bullets went where it divides by 11."""
    k = F.col("lesson_id")
    return once(outlines, slides=F.transform("slides", lambda s: L._with(s, L.SLIDE_FIELDS, references=F.when(k % 3 == 0, F.slice(s["references"], 1, 0)).otherwise(s["references"]), bullet_points=F.when(k % 11 == 0, F.slice(s["bullet_points"], 1, 0)).otherwise(s["bullet_points"]))))


@query(f"WITH {SLIDE_SQL} SELECT e AS lesson_id, slide_index, CASE WHEN e % 3 = 0 AND kind = 'references' THEN 0 ELSE n_refs END::int AS n_refs, CASE WHEN e % 3 = 0 AND kind = 'references' THEN NULL ELSE ref END AS ref FROM slides")
def c03_inherit_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.inherit_references(_stripped(L.outline_slides(_lessons(Tables(spark, sf_dir))))).select("lesson_id", F.explode("slides").alias("s"))
    return s.select("lesson_id", "s.slide_index", F.size("s.references").alias("n_refs"), F.try_element_at("s.references", F.lit(1))["chunk_id"].alias("ref"))


@query(f"WITH {SLIDE_SQL} SELECT slides.e AS lesson_id, slide_index, CASE WHEN kind = 'title' THEN 0 WHEN slides.e % 3 = 0 THEN 1 ELSE n_refs END::int AS n_refs, CASE WHEN slides.e % 3 = 0 AND kind <> 'title' THEN refs2[1] ELSE ref END AS ref FROM slides JOIN refl USING (e)")
def j10_repair_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = L.repair_slides(_stripped(L.outline_slides(_lessons(Tables(spark, sf_dir))))).select("lesson_id", F.explode("slides").alias("s"))
    return s.select("lesson_id", "s.slide_index", F.size("s.references").alias("n_refs"), F.try_element_at("s.references", F.lit(1))["chunk_id"].alias("ref"))


@query(f"""WITH {SLIDE_SQL}, uni AS (SELECT 'o' || o_orderkey AS c FROM orders WHERE o_orderkey % 9 <> 0),
u AS (SELECT e, unnest(refs2[1:8]) AS c, 1000 AS o FROM refl UNION ALL SELECT e, ref, o FROM slides WHERE ref IS NOT NULL AND kind <> 'references'),
bad AS (SELECT DISTINCT u.e FROM u WHERE c NOT IN (FROM uni) AND (o <> 1000 OR EXISTS (SELECT 1 FROM slides s WHERE s.e = u.e AND s.kind = 'references')) AND NOT (u.e % 3 = 0 AND o = 1000))
SELECT lessons.e AS lesson_id, true AS source_session_valid, lessons.e % 11 <> 0 AS content_not_empty, NOT (lessons.e % 3 = 0 AND lessons.e % 2 = 0) AS citation_present, NOT (lessons.e % 3 = 0 AND lessons.e % 2 = 0) AND bad.e IS NULL AS citation_grounded FROM lessons LEFT JOIN bad ON bad.e = lessons.e""")
def k03_validate_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    chunks = t.orders.where("o_orderkey % 9 <> 0").select(F.lit("course").alias("course_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    r = L.validate_slides(_stripped(L.outline_slides(_lessons(t))), chunks)
    return r.select("lesson_id", "source_session_valid", "content_not_empty", "citation_present", "citation_grounded")


@query(f"""WITH {SLIDE_SQL}, cited AS (SELECT e, ref FROM slides WHERE ref IS NOT NULL AND kind <> 'references' UNION ALL SELECT slides.e, unnest(refs2[1:8]) FROM slides JOIN refl USING (e) WHERE kind = 'references')
SELECT DISTINCT e AS lesson_id FROM cited WHERE ref NOT IN (SELECT 'o' || o_orderkey FROM orders WHERE o_orderkey % 9 <> 0)""")
def c04_ungrounded_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    chunks = t.orders.where("o_orderkey % 9 <> 0").select(F.lit("course").alias("course_id"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("chunk_id"))
    return L.ungrounded_citations(L.outline_slides(_lessons(t)), chunks)


@query("SELECT c_custkey AS lesson_id, c_custkey % 3 = 0 AND c_custkey % 2 = 0 OR c_custkey % 11 = 0 AS failed, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 OR c_custkey % 11 = 0 THEN 'needs_review' ELSE 'draft' END AS status FROM customer")
def b16_export_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _stripped(L.outline_slides(_lessons(Tables(spark, sf_dir)))).withColumn("status", F.lit("needs_review"))
    return L.export_gate(o).select("lesson_id", (~F.col("exportable")).alias("failed"), "status")


@query("SELECT c_custkey AS lesson_id, CASE WHEN c_custkey % 4 = 0 THEN 'minutes,time allocation sum' ELSE '' END AS violations FROM customer")
def k05_check_lesson_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = _lessons(Tables(spark, sf_dir))
    names = lessons.schema["session_plan"].dataType.elementType.names
    none = lambda p: F.transform(p["time_allocation"], lambda a: F.struct(a["activity"].alias("activity"), F.when(F.col("lesson_id") % 4 == 0, 0).otherwise(a["minutes"]).cast("int").alias("minutes")))
    broken = lessons.withColumn("session_plan", F.transform("session_plan", lambda p: L._with(p, names, time_allocation=none(p))))
    return L.check_lesson_schema(broken).select("lesson_id", F.array_join("violations", ",").alias("violations"))


@query("SELECT c_custkey AS lesson_id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 0 THEN 'references slide' ELSE '' END AS violations FROM customer")
def k06_check_slide_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.check_slide_schema(_stripped(L.outline_slides(_lessons(Tables(spark, sf_dir))))).select("lesson_id", F.array_join("violations", ",").alias("violations"))


@query(f"WITH {LESSON_SQL} SELECT e AS lesson_id, (4 + any_value(len(points)) + sum(1 + 7 + least(3, len(sp)) + len(sp) + least(2, len(sp)) + 4 + 1 + 1 + 1))::bigint AS n_lines FROM sessions GROUP BY e")
def j12_render_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.render_lessons(_lessons(Tables(spark, sf_dir))).groupBy("lesson_id").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {SLIDE_SQL}, t AS (SELECT slides.*, CASE kind WHEN 'title' THEN 1 WHEN 'activity' THEN 2 WHEN 'references' THEN n_refs WHEN 'objectives' THEN least(3, len(sp)) ELSE len(sp) END AS bullets FROM slides LEFT JOIN sessions ON sessions.e = slides.e AND sessions.s = slides.s)
SELECT e AS lesson_id, slide_index, (1 + bullets + n_refs)::bigint AS n_lines FROM t""")
def j12_render_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.render_slides(L.outline_slides(_lessons(Tables(spark, sf_dir)))).groupBy("lesson_id", "slide_index").agg(F.count(F.lit(1)).alias("n_lines"))


@query(f"""WITH {LESSON_SQL} SELECT 'review-' || e || '-lesson-session-' || s AS chunk_id, 'reviewed_lesson' AS source_type, 'session-' || s AS section, course || chr(10) || ch || chr(10) || ch || ' - ' || sp[1] || chr(10) || array_to_string(list_transform(sp[1:3], lambda x: 'Explain ' || x), chr(10)) || chr(10) || array_to_string(sp, chr(10)) || chr(10) ||
array_to_string(list_transform(['导入与目标说明', '核心概念讲解', '课堂练习与互动', '总结与作业说明'], lambda a: a || ': ' || array_to_string(sp[1:3], ', ')), chr(10)) AS content FROM sessions WHERE e % 2 = 0""")
def i06_write_back_lessons(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    lessons = _lessons(t)
    reviews = lessons.select(F.col("lesson_id").alias("review_id"), F.lit("lesson_design").alias("target_type"), F.col("lesson_id").alias("target_id"), "course_id", F.when(F.col("lesson_id") % 2 == 0, "approved").otherwise("rejected").alias("review_status"))
    questions = spark.createDataFrame([], "question_id string, course_id string, question_type string, knowledge_point string, question_text string, correct_answer string, explanation string, options array<struct<key:string,value:string>>")
    return L.write_back(reviews, lessons, L.outline_slides(lessons), questions).select("chunk_id", "source_type", "section", "content")


@query(f"""WITH {EXAM_SQL}, o AS (SELECT *, CASE question_type WHEN 'single_choice' THEN chr(10) || 'A. Core meaning of ' || point || chr(10) || 'B. Unrelated concept' || chr(10) || 'C. Random guess' || chr(10) || 'D. Incorrect statement' WHEN 'multiple_choice' THEN chr(10) || 'A. Understand ' || point || chr(10) || 'B. Apply ' || point || chr(10) || 'C. Unrelated' || chr(10) || 'D. Clearly wrong' ELSE '' END AS options,
CASE question_type WHEN 'single_choice' THEN 'A' WHEN 'multiple_choice' THEN 'A,B' WHEN 'judgement' THEN 'true' ELSE 'A complete answer should define ' || point || ', describe its use, and include one course example.' END AS answer,
CASE question_type WHEN 'single_choice' THEN 'The course context identifies ' || point || ' as the assessed knowledge point.' WHEN 'multiple_choice' THEN 'A and B cover understanding and application of ' || point || '.' WHEN 'judgement' THEN 'The retrieved course context provides material related to ' || point || '.' ELSE 'The answer should cover definition, application scenario, and source-grounded example.' END AS why FROM qs)
SELECT 'review-' || exam_id || '.' || pos || '-question-' || exam_id || '.' || pos AS chunk_id, question_type AS section, point AS title, question_text || chr(10) || 'Answer: ' || answer || chr(10) || 'Explanation: ' || why || options AS content FROM o""")
def i06_write_back_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    q = E.generate_questions(exam_blueprints(t)).withColumn("question_id", F.concat_ws(".", F.col("exam_id").cast("string"), F.col("pos").cast("string"))).withColumn("course_id", F.lit("c"))
    reviews = q.select(F.col("question_id").alias("review_id"), F.lit("question").alias("target_type"), F.col("question_id").alias("target_id"), "course_id", F.lit("approved").alias("review_status"))
    lessons = _lessons(t).where("false")
    w = L.write_back(reviews, lessons, L.outline_slides(lessons), q)
    return w.select("chunk_id", "section", "title", "content")


@query(f"""WITH {SLIDE_SQL} SELECT 'review-' || slides.e || '-slide-' || slide_index AS chunk_id, 'reviewed_ppt' AS source_type, 'slide-' || slide_index AS section, slides.title,
l.course || chr(10) || l.ch || chr(10) || slides.title || chr(10) || array_to_string(CASE kind WHEN 'title' THEN [l.total || ' sessions'] WHEN 'activity' THEN ['Discuss a course example.', 'Summarize source-backed reasoning.'] WHEN 'references' THEN list_transform(refs2[1:8], lambda r: 'source chunk=' || r)
WHEN 'objectives' THEN list_transform(sp[1:3], lambda x: 'Explain ' || x) ELSE sp END, chr(10)) AS content
FROM slides JOIN lessons l ON l.e = slides.e JOIN refl ON refl.e = slides.e LEFT JOIN sessions ON sessions.e = slides.e AND sessions.s = slides.s WHERE slides.e % 2 = 0""")
def i06_write_back_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    lessons = _lessons(Tables(spark, sf_dir))
    reviews = lessons.select(F.col("lesson_id").alias("review_id"), F.lit("ppt_outline").alias("target_type"), F.col("lesson_id").alias("target_id"), "course_id", F.when(F.col("lesson_id") % 2 == 0, "approved").otherwise("rejected").alias("review_status"))
    questions = spark.createDataFrame([], "question_id string, course_id string, question_type string, knowledge_point string, question_text string, correct_answer string, explanation string, options array<struct<key:string,value:string>>")
    return L.write_back(reviews, lessons, L.outline_slides(lessons), questions).select("chunk_id", "source_type", "section", "title", "content")
