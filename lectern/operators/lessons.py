"""Lessons and slides: planning, assembly, validation, repair, revision, rendering, write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import filled, keywords, slice_points, target_session, time_allocation
from lectern.operators.lineage import once, settled
from lectern.operators.exams import gather_contexts, line, no_reference, numbered, reference_line, references_of, with_errors

# Fixed values.
SLIDE_TYPES = ("title", "objectives", "content", "activity", "summary", "references")
BOUND = ("objectives", "content", "activity")
_CONTEXTS = "array<struct<rank:int,chunk_id:string,source_type:string,chapter:string,page:int,content:string>>"
_REFS = "array<struct<chunk_id:string,source_type:string,chapter:string,page:int>>"


def lesson_points(contexts: Column, most: int = 12) -> Column:
    """The first distinct keywords of contexts in rank order."""
    return keywords(F.array_join(F.transform(contexts, lambda c: c["content"]), "\n\n"), most)


def plan_sessions(params: DataFrame, contexts: DataFrame) -> DataFrame:
    """Lessons (lesson_id, course_name, chapter_range, total_sessions, session_duration, teaching_focus) with contexts, knowledge_points and session_plan."""
    got = once(params.join(gather_contexts(contexts, "lesson_id"), "lesson_id", "left"), contexts=F.coalesce("contexts", F.array().cast(_CONTEXTS)))
    got = once(got, knowledge_points=lesson_points(F.col("contexts")))
    got = once(got, knowledge_points=F.when(F.size("knowledge_points") > 0, F.col("knowledge_points")).otherwise(F.array("chapter_range")))

    def plan(i: Column) -> Column:
        mine = slice_points(F.col("knowledge_points"), i, F.col("total_sessions"))
        return F.struct(
            i.alias("session_index"), F.concat("chapter_range", F.lit(" - "), mine[0]).alias("session_title"), F.col("session_duration").alias("duration"), mine.alias("knowledge_points"),
            F.coalesce(filled(F.col("teaching_focus")), F.concat(F.lit("Understand "), mine[0])).alias("teaching_focus"), F.slice(mine, F.greatest(F.size(mine) - 1, F.lit(1)), 2).alias("difficulty_points"),
            time_allocation(F.col("session_duration")).alias("time_allocation"),
        )

    return once(got, session_plan=F.transform(F.sequence(F.lit(1), "total_sessions"), plan))


def assemble_lessons(plans: DataFrame) -> DataFrame:
    """Add sessions to plans: objectives, process, fixed suggestions, and one reference each, in turn."""
    n = F.greatest(F.lit(1), F.least(F.size("contexts"), F.col("total_sessions")))
    out = once(plans, _refs=F.slice(references_of(F.col("contexts")), 1, n))

    def session(p: Column) -> Column:
        points = F.slice(p["knowledge_points"], 1, 3)
        one = lambda *parts: F.array(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
        return F.struct(
            p["session_index"].alias("session_index"), p["session_title"].alias("session_title"), F.transform(points, lambda x: F.concat(F.lit("Explain "), x)).alias("teaching_objectives"),
            p["knowledge_points"].alias("key_points"), p["difficulty_points"].alias("difficult_points"),
            F.transform(p["time_allocation"], lambda a: F.struct(a["activity"].alias("stage"), a["minutes"].alias("minutes"), F.concat(a["activity"], F.lit(": "), F.array_join(points, ", ")).alias("content"))).alias("teaching_process"),
            one("Discuss ", p["knowledge_points"][0], " in groups.").alias("interaction_design"), one("Draw a concept map for ", p["session_title"], ".").alias("blackboard_or_slide_suggestions"),
            one("Summarize ", p["knowledge_points"][0], " with an example.").alias("homework_suggestion"),
            F.array(F.element_at("_refs", F.pmod(p["session_index"] - 1, F.size("_refs")).cast("int") + 1)).alias("references"),
        )

    return once(out, sessions=F.transform("session_plan", session)).drop("_refs")


def _with(session: Column, names: list[str], **changes: Column) -> Column:
    return F.struct(*[changes.get(n, session[n]).alias(n) for n in names])


def _fields(df: DataFrame, column: str) -> list[str]:
    return df.schema[column].dataType.elementType.names


def repair_lessons(lessons: DataFrame) -> DataFrame:
    """Sessions without references, objectives or key points get the first context, their title, and the lesson's first point."""
    names, ref = _fields(lessons, "sessions"), F.slice(references_of(F.col("contexts")), 1, 1)
    point = F.when(F.size("knowledge_points") > 0, F.slice("knowledge_points", 1, 1)).otherwise(F.array("chapter_range"))
    or_else = lambda a, b: F.when(F.size(a) > 0, a).otherwise(b)
    return once(lessons, sessions=F.transform("sessions", lambda s: _with(
        s, names, references=or_else(s["references"], ref), teaching_objectives=or_else(s["teaching_objectives"], F.array(F.concat(F.lit("Explain "), s["session_title"]))), key_points=or_else(s["key_points"], point))))


# The texts of a revision.
REVISION = {"note": "Revision for ", "stage": "Revision", "emphasis": "Update emphasis according to teacher feedback: ", "summary": "Updated session "}


def revise_lessons(lessons: DataFrame, requests: DataFrame) -> DataFrame:
    """Lessons changed by requests (lesson_id, target_scope, feedback_text, keep_unchanged_parts): the named session gets a note or a revision step, and an emphasis line."""
    names = _fields(lessons, "sessions")
    joined = once(lessons.join(requests, "lesson_id"), target_index=target_session(F.col("target_scope"), F.size("sessions")))
    note = F.concat(F.lit(REVISION["note"]), "target_scope", F.lit(": "), "feedback_text")
    step = F.struct(F.lit(REVISION["stage"]).alias("stage"), F.lit(5).alias("minutes"), note.alias("content"))
    add = lambda a, x: F.concat(a, F.array(x))

    def change(s: Column, i: Column) -> Column:
        new = _with(
            s, names, interaction_design=F.when(F.col("keep_unchanged_parts"), add(s["interaction_design"], note)).otherwise(s["interaction_design"]),
            teaching_process=F.when(F.col("keep_unchanged_parts"), s["teaching_process"]).otherwise(add(s["teaching_process"], step)),
            blackboard_or_slide_suggestions=add(s["blackboard_or_slide_suggestions"], F.concat(F.lit(REVISION["emphasis"]), "feedback_text")))
        return F.when(i == F.col("target_index"), new).otherwise(s)

    return once(joined, sessions=F.transform("sessions", change)).withColumn("modification_summary", F.concat(F.lit(REVISION["summary"]), (F.col("target_index") + 1).cast("string"), F.lit(": "), "target_scope"))


def validate_lessons(lessons: DataFrame) -> DataFrame:
    """One row per lesson with its checks, errors in order, and passed."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    minutes = lambda p: F.aggregate(p["time_allocation"], F.lit(0), lambda a, t: a + t["minutes"])
    wrong = F.filter("session_plan", lambda p: (p["duration"] != F.col("session_duration")) | (minutes(p) != F.col("session_duration")))
    count, plans = F.size("sessions") == F.col("total_sessions"), F.size("session_plan") == F.col("total_sessions")
    required = F.forall("sessions", lambda s: some(s["teaching_objectives"]) & some(s["key_points"]) & some(s["teaching_process"]))
    covered = some("knowledge_points") & F.forall("sessions", lambda s: some(s["key_points"]))
    cited = F.forall("sessions", lambda s: some(s["references"]))
    message = lambda ok, m: F.when(~ok, F.array(F.lit(m))).otherwise(F.array().cast("array<string>"))
    # The messages of the checks.
    errors = F.concat(
        message(count, "session_count_valid failed"), message(plans, "session_plan count does not match expected sessions"),
        F.transform(wrong, lambda p: F.concat(F.lit("time allocation invalid for session "), p["session_index"].cast("string"))),
        message(required, "required fields missing"), message(covered, "knowledge coverage missing"), message(cited, "references missing"))
    return lessons.select(
        "lesson_id", (count & plans).alias("session_count_valid"), (F.size(wrong) == 0).alias("time_allocation_valid"), required.alias("required_fields_valid"), covered.alias("knowledge_coverage_valid"), cited.alias("citation_valid"), errors.alias("errors"),
    ).withColumn("passed", F.size("errors") == 0)


def check_lesson_schema(lessons: DataFrame) -> DataFrame:
    """Add violations of ranges and lengths; an activity of no minutes is one."""
    minutes = lambda p: F.aggregate(p["time_allocation"], F.lit(0), lambda a, t: a + t["minutes"])
    rules = [
        (F.col("total_sessions") < 1, "total_sessions"), (F.col("session_duration") < 1, "session_duration"), (F.length(F.coalesce("chapter_range", F.lit(""))) < 1, "chapter"),
        (F.exists("session_plan", lambda p: F.exists(p["time_allocation"], lambda t: t["minutes"] < 1)), "minutes"),
        (F.exists("session_plan", lambda p: minutes(p) != p["duration"]), "time allocation sum"), (F.exists("sessions", lambda s: F.length(s["session_title"]) < 1), "session_title"),
    ]
    return lessons.withColumn("violations", F.filter(F.array(*[F.when(r, F.lit(m)) for r, m in rules]), lambda x: x.isNotNull()))


def distinct_references(sessions: Column) -> Column:
    """References of all sessions, the first of each chunk, in order; a placeholder if there is none."""
    refs = F.flatten(F.transform(sessions, lambda s: s["references"]))
    ids = F.transform(refs, lambda r: r["chunk_id"])
    kept = F.filter(refs, lambda r, i: F.array_position(ids, r["chunk_id"]) == i + 1)
    return F.when(F.size(refs) > 0, kept).otherwise(no_reference())


def _slide(kind: str, title: Column, bullets: Column, refs: Column | None = None, session: Column | None = None) -> Column:
    return F.struct(
        F.lit(0).alias("slide_index"), F.lit(kind).alias("slide_type"), title.alias("title"), bullets.alias("bullet_points"), F.lit(None).cast("string").alias("speaker_notes"),
        (F.array().cast(_REFS) if refs is None else refs).alias("references"), (F.lit(None) if session is None else session).cast("int").alias("source_session_index"))


def number_slides(slides: Column, names: list[str]) -> Column:
    return F.transform(slides, lambda s, i: F.struct(*[(i + 1).alias(n) if n == "slide_index" else s[n].alias(n) for n in names]))


# The texts of slides that are made.
ACTIVITY = ("Classroom Activity", "Discuss a course example.", "Summarize source-backed reasoning.")
EMPTY_SLIDE = "Review the source-grounded teaching point."
SLIDE_FIELDS = ["slide_index", "slide_type", "title", "bullet_points", "speaker_notes", "references", "source_session_index"]


def fit_slide_count(slides: Column, wanted: Column, first_reference: Column) -> Column:
    """``wanted`` slides: the first ones, with a references slide at the end if there was one, or with activity slides put in; null: as they are."""
    n, last = F.size(slides), F.element_at(slides, -1)
    has_refs = last["slide_type"] == "references"
    fewer = F.when(has_refs & (wanted >= 3), F.concat(F.slice(slides, 1, F.greatest(wanted - 1, F.lit(0))), F.array(last))).otherwise(F.slice(slides, 1, F.greatest(wanted, F.lit(0))))
    activity = _slide("activity", F.lit(ACTIVITY[0]), F.array(*map(F.lit, ACTIVITY[1:])), F.array(first_reference))
    fill = F.array_repeat(activity, F.greatest(wanted - n, F.lit(0)))
    more = F.when(has_refs, F.concat(F.slice(slides, 1, n - 1), fill, F.array(last))).otherwise(F.concat(slides, fill))
    return F.when(wanted.isNull(), slides).when(n > wanted, fewer).otherwise(more)


def outline_slides(lessons: DataFrame) -> DataFrame:
    """Add slides to lessons with slide_count (null: as many as come) and include_references."""
    out = once(lessons, _refs=distinct_references(F.col("sessions")))
    title = _slide("title", F.concat("course_name", F.lit(": "), "chapter_range"), F.array(F.concat(F.col("total_sessions").cast("string"), F.lit(" sessions"))))

    def pair(s: Column) -> Column:
        ref = F.array(F.when(F.size(s["references"]) > 0, s["references"][0]).otherwise(F.col("_refs")[0]))
        name = lambda what: F.concat(F.lit("Session "), s["session_index"].cast("string"), F.lit(f": {what}"))
        return F.array(_slide("objectives", name("Objectives"), F.slice(s["teaching_objectives"], 1, 5), ref, s["session_index"]), _slide("content", name("Key Points"), F.slice(s["key_points"], 1, 6), ref, s["session_index"]))

    some = F.slice("_refs", 1, 8)
    sources = _slide("references", F.lit("Source References"), F.transform(some, lambda r: F.concat(F.coalesce(filled(r["source_type"]), F.lit("source")), F.lit(" chunk="), r["chunk_id"])), some)
    slides = F.concat(F.array(title), F.flatten(F.transform("sessions", pair)), F.when(F.col("include_references"), F.array(sources)).otherwise(F.filter(F.array(sources), lambda _: F.lit(False))))
    out = once(once(out, slides=slides), slides=fit_slide_count(F.col("slides"), F.col("slide_count"), F.col("_refs")[0]))
    return once(out, slides=number_slides(F.col("slides"), SLIDE_FIELDS)).drop("_refs")


def inherit_references(outlines: DataFrame) -> DataFrame:
    """Slides other than the title that have no references take those of their session."""
    mine = lambda s: F.flatten(F.transform(F.filter("sessions", lambda x: x["session_index"] == s["source_session_index"]), lambda x: x["references"]))
    take = lambda s: F.when((s["slide_type"] != "title") & (F.size(s["references"]) == 0), mine(s)).otherwise(s["references"])
    return once(outlines, slides=F.transform("slides", lambda s: _with(s, SLIDE_FIELDS, references=take(s))))


def repair_slides(outlines: DataFrame) -> DataFrame:
    """Slides other than the title without references get the lesson's first one, slides without bullets a fixed one."""
    first = F.slice(distinct_references(F.col("sessions")), 1, 1)
    return once(outlines, slides=F.transform("slides", lambda s: _with(
        s, SLIDE_FIELDS, references=F.when((s["slide_type"] != "title") & (F.size(s["references"]) == 0), first).otherwise(s["references"]),
        bullet_points=F.when(F.size(s["bullet_points"]) == 0, F.array(F.lit(EMPTY_SLIDE))).otherwise(s["bullet_points"]))))


def ungrounded_citations(outlines: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """(lesson_id) of the outlines with a slide that cites an unknown chunk, or nothing of the session it names.

    chunk_ids (course_id, chunk_id) is the course's universe; it is anti-joined, not gathered.  Only
    the distinct ids of an outline leave its row.
    """
    ids = lambda references: F.coalesce(F.transform(references, lambda r: r["chunk_id"]), F.array().cast("array<string>"))
    cited = outlines.select("lesson_id", "course_id", F.explode(F.array_distinct(F.flatten(F.transform("slides", lambda s: ids(s["references"]))))).alias("chunk_id"))
    unknown = cited.join(chunk_ids, ["course_id", "chunk_id"], "left_anti").select("lesson_id")
    own = lambda s: F.flatten(F.transform(F.filter("sessions", lambda x: x["session_index"] == s["source_session_index"]), lambda x: ids(x["references"])))
    foreign = lambda s: s["source_session_index"].isNotNull() & ~F.coalesce(F.arrays_overlap(ids(s["references"]), own(s)), F.lit(False))
    return unknown.union(outlines.where(F.exists("slides", foreign)).select("lesson_id")).distinct()


def validate_slides(outlines: DataFrame, chunk_ids: DataFrame | None = None) -> DataFrame:
    """One row per outline with its checks, errors in order, and passed.  References are inherited first; without chunk_ids the lesson's own references are the universe."""
    outlines = settled(inherit_references(outlines))  # the citations and the checks read them
    universe = chunk_ids if chunk_ids is not None else outlines.select("course_id", F.explode(F.flatten(F.transform("sessions", lambda s: F.transform(s["references"], lambda r: r["chunk_id"])))).alias("chunk_id")).distinct()
    bad = ungrounded_citations(outlines, universe).withColumn("_bad", F.lit(True))
    known = F.transform("sessions", lambda s: s["session_index"])
    index = lambda s: s["source_session_index"]
    owned = lambda s: F.when(index(s).isNull(), ~s["slide_type"].isin(*BOUND)).otherwise(F.array_contains(known, index(s)) & index(s).between(1, F.col("total_sessions")))
    present = F.forall("slides", lambda s: (s["slide_type"] == "title") | (F.size(s["references"]) > 0))
    out = outlines.join(bad, "lesson_id", "left").select(
        "lesson_id", F.coalesce(F.size("slides") == F.col("slide_count"), F.size("slides") >= 3).alias("slide_count_valid"), F.forall("slides", lambda s: s["slide_type"].isin(*SLIDE_TYPES)).alias("slide_type_valid"),
        F.forall("slides", lambda s: (F.coalesce(s["title"], F.lit("")) != "") & (F.size(s["bullet_points"]) > 0)).alias("content_not_empty"), F.forall("slides", owned).alias("source_session_valid"),
        present.alias("citation_present"), (present & F.col("_bad").isNull()).alias("citation_grounded"))
    flags = [(c, f"{c} failed") for c in out.columns[1:]]
    return with_errors(out.withColumn("citation_valid", F.col("citation_present") & F.col("citation_grounded")), flags)


def check_slide_schema(outlines: DataFrame) -> DataFrame:
    """Add violations: slides numbered otherwise than from 1, references slides without references, no slides."""
    rules = [
        (F.size("slides") < 1, "no slides"), (F.exists("slides", lambda s: (s["slide_type"] == "references") & (F.size(s["references"]) == 0)), "references slide"),
        (F.col("slides.slide_index") != F.transform("slides", lambda s, i: i + 1), "slide_index"), (F.exists("slides", lambda s: s["source_session_index"] < 1), "source_session_index"),
    ]
    return outlines.withColumn("violations", F.filter(F.array(*[F.when(r, F.lit(m)) for r, m in rules]), lambda x: x.isNotNull()))


def export_gate(outlines: DataFrame, chunk_ids: DataFrame | None = None) -> DataFrame:
    """(lesson_id, exportable, status, errors): outlines are checked again with the slides they have; one that passes returns from needs_review to draft."""
    checked = validate_slides(outlines.withColumn("slide_count", F.size("slides")), chunk_ids).select("lesson_id", "passed", "errors")
    status = F.when(~F.col("passed"), "needs_review").when(F.col("status") == "needs_review", "draft").otherwise(F.col("status"))
    return outlines.select("lesson_id", "status").join(checked, "lesson_id").select("lesson_id", F.col("passed").alias("exportable"), status.alias("status"), "errors")


def render_lessons(lessons: DataFrame) -> DataFrame:
    """(lesson_id, line_no, style, text)."""
    bullets = lambda a: F.transform(a, lambda x: line("bullet", x))
    head = lambda level, text: F.array(line(level, F.lit(text) if isinstance(text, str) else text))
    optional = lambda title, a: F.when(F.size(a) > 0, F.concat(head("heading2", title), bullets(a))).otherwise(bullets(a))

    def session(s: Column) -> Column:
        return F.concat(
            head("heading1", F.concat(F.lit("Session "), s["session_index"].cast("string"), F.lit(": "), s["session_title"])), head("heading2", "Objectives"), bullets(s["teaching_objectives"]), head("heading2", "Key Points"), bullets(s["key_points"]),
            head("heading2", "Difficult Points"), bullets(s["difficult_points"]), head("heading2", "Teaching Process"),
            F.transform(s["teaching_process"], lambda p: line("text", F.concat(p["stage"], F.lit(" ("), p["minutes"].cast("string"), F.lit(" min): "), p["content"]))),
            optional("Interaction Design", s["interaction_design"]), optional("Homework", s["homework_suggestion"]), head("heading2", "References"), F.transform(s["references"], lambda r: line("text", reference_line(r))))

    top = F.array(line("title", F.concat("course_name", F.lit(" - "), "chapter_range")), line("text", F.concat(F.lit("Total sessions: "), F.col("total_sessions").cast("string"))), line("text", F.concat(F.lit("Session duration: "), F.col("session_duration").cast("string"), F.lit(" minutes"))), line("heading1", F.lit("Knowledge Points")))
    return numbered(lessons.withColumn("lines", F.concat(top, bullets(F.col("knowledge_points")), F.flatten(F.transform("sessions", session)))), "lesson_id")


def render_slides(outlines: DataFrame) -> DataFrame:
    """(lesson_id, slide_index, line_no, style, text): title, bullets, notes."""
    rows = outlines.select("lesson_id", F.explode("slides").alias("s"))
    notes = F.concat(F.filter(F.array(F.when(F.coalesce(F.col("s.speaker_notes"), F.lit("")) != "", line("note", F.col("s.speaker_notes")))), lambda x: x.isNotNull()), F.transform("s.references", lambda r: line("note", F.concat(F.lit("Reference: "), reference_line(r)))))
    lines = F.concat(F.array(line("title", F.col("s.title"))), F.transform("s.bullet_points", lambda b: line("bullet", b)), notes)
    return numbered(rows.select("lesson_id", F.col("s.slide_index").alias("slide_index"), lines.alias("lines")), "lesson_id", "slide_index")


_OUT = ("chunk_id", "document_id", "course_id", "source_type", "chapter", "section", "title", "content", "knowledge_points")


def write_back(reviews: DataFrame, lessons: DataFrame, outlines: DataFrame, questions: DataFrame) -> DataFrame:
    """Verified chunks of what approved reviews (review_id, target_type, target_id, course_id, review_status) name, by slide, session and question.

    Written again they have the same chunk ids, so a rebuild by document replaces them.
    """
    approved = reviews.where("review_status = 'approved'").withColumn("document_id", F.concat(F.lit("review-"), F.col("review_id").cast("string")))
    of = lambda kind, df, key: approved.where(F.col("target_type") == kind).join(df.withColumn("_target", F.col(key).cast("string")), F.col("target_id").cast("string") == F.col("_target")).drop("_target")
    name = lambda kind, tail: F.concat(F.col("document_id"), F.lit(kind), tail.cast("string")).alias("chunk_id")
    ten = lambda a: F.slice(a, 1, 10).alias("knowledge_points")
    common = ["document_id", "course_id"]
    slides = of("ppt_outline", outlines.drop("course_id"), "lesson_id").withColumn("s", F.explode("slides")).select(
        name("-slide-", F.col("s.slide_index")), *common, F.lit("reviewed_ppt").alias("source_type"), F.col("chapter_range").alias("chapter"), F.concat(F.lit("slide-"), F.col("s.slide_index").cast("string")).alias("section"), F.col("s.title").alias("title"),
        F.concat_ws("\n", "course_name", "chapter_range", "s.title", "s.bullet_points", filled(F.col("s.speaker_notes"))).alias("content"), ten(F.col("s.bullet_points")))
    sessions = of("lesson_design", lessons.drop("course_id"), "lesson_id").withColumn("s", F.explode("sessions")).select(
        name("-lesson-session-", F.col("s.session_index")), *common, F.lit("reviewed_lesson").alias("source_type"), F.col("chapter_range").alias("chapter"), F.concat(F.lit("session-"), F.col("s.session_index").cast("string")).alias("section"), F.col("s.session_title").alias("title"),
        F.concat_ws("\n", "course_name", "chapter_range", "s.session_title", "s.teaching_objectives", "s.key_points", "s.teaching_process.content").alias("content"), ten(F.col("s.key_points")))
    asked = of("question", questions.drop("course_id"), "question_id").select(
        name("-question-", F.col("question_id")), *common, F.lit("reviewed_question").alias("source_type"), F.lit(None).cast("string").alias("chapter"), F.col("question_type").alias("section"), F.col("knowledge_point").alias("title"),
        F.concat_ws("\n", "question_text", F.concat(F.lit("Answer: "), "correct_answer"), F.concat(F.lit("Explanation: "), "explanation"), F.transform("options", lambda o: F.concat(o["key"], F.lit(". "), o["value"]))).alias("content"), F.array("knowledge_point").alias("knowledge_points"))
    return slides.unionByName(sessions).unionByName(asked).select(*_OUT).withColumn("verified", F.lit(True))
