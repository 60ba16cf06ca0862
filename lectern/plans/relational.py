"""Queries on the relational tables and on metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.operators import metrics as M
from lectern.operators import tables as T
from lectern.operators.search import search
from lectern.plans.base import Tables, query


@query("""SELECT o_orderkey, file_name, CASE WHEN k IN (1, 2, 3) THEN '' ELSE NULL END AS error_message, k IN (1, 2, 3) AS accepted FROM (SELECT o_orderkey, o_orderkey % 5 AS k, 'File' || o_orderkey || (['.DOC', '.pdf', '.Md', '.xlsx', ''])[o_orderkey % 5 + 1] AS file_name FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""".replace("CASE WHEN k IN (1, 2, 3) THEN '' ELSE NULL END", "CASE k WHEN 0 THEN 'Legacy .doc files are not supported. Please convert to .docx' WHEN 4 THEN 'Unsupported file type: <none>' END"))
def a02_admit_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, key = Tables(spark, sf_dir), F.col("o_orderkey")
    ext = F.element_at(F.array(*[F.lit(x) for x in (".DOC", ".pdf", ".Md", ".xlsx", "")]), (key % 5 + 1).cast("int"))
    uploads = t.orders.select(F.col("o_custkey").alias("course_id"), "o_orderkey", F.concat(F.lit("in/a/File"), key.cast("string"), ext).alias("path"))
    courses = t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("course_id"))
    return T.admit_documents(uploads, courses).select("o_orderkey", "file_name", "error_message", "accepted")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, concat_ws(' | ', l_linestatus, CASE WHEN l_quantity > 25 THEN l_returnflag END, l_partkey::varchar) AS line FROM lineitem)
SELECT l_orderkey AS document_id, string_agg(line, chr(10) ORDER BY l_linenumber, l_partkey, l_extendedprice) AS content FROM r GROUP BY ALL""")
def a05_flatten_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = Tables(spark, sf_dir).lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.lit("Sheet1").alias("sheet"), F.struct("l_linenumber", "l_partkey", "l_extendedprice").alias("row"),
        F.posexplode(F.array("l_linestatus", F.when(F.col("l_quantity") > 25, F.col("l_returnflag")), F.col("l_partkey").cast("string"))).alias("col", "value"),
    )
    return T.flatten_cells(cells, "document_id").select("document_id", "content")


@query(r"""SELECT doc_id, i AS page, regexp_replace(p, '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, unnest(string_split(text, '. ')) AS p, generate_subscripts(string_split(text, '. '), 1) AS i FROM documents) WHERE regexp_replace(p, '^\s+|\s+$', '', 'g') <> ''""")
def a06_paginate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = Tables(spark, sf_dir).documents.select("doc_id", F.split("text", r"\. ").alias("pages"))
    return T.paginate_sections(pages).withColumn("page", F.col("page").cast("long"))


@query("""SELECT doc_id AS document_id, left(text, 1000) AS content_preview FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT doc_id, left('new ' || text, 1000) FROM documents WHERE doc_id % 3 = 0""")
def a08_replace_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("document_id"), F.col("text").alias("content"))
    new = docs.where("document_id % 3 = 0").withColumn("content", F.concat(F.lit("new "), "content"))
    return T.with_preview(T.replace_by_document(docs, new)).select("document_id", "content_preview")


@query("""WITH c AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 30 GROUP BY ALL)
SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus <> 'P' AND coalesce(n, 0) > 0 THEN 'built' ELSE 'failed' END AS parse_status, CASE WHEN o_orderstatus <> 'P' THEN coalesce(n, 0) ELSE 0 END AS chunk_count,
CASE WHEN o_orderstatus = 'P' THEN 'unreadable' WHEN n IS NULL THEN 'No text chunks were extracted from this document' END AS error_message FROM orders LEFT JOIN c ON l_orderkey = o_orderkey""")
def a09_build_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    docs = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "P", "unreadable").alias("error"))
    return T.build_report(docs, t.lineitem.where("l_quantity > 30").select(F.col("l_orderkey").alias("document_id"))).withColumn("chunk_count", F.col("chunk_count").cast("long"))


@query("SELECT lang AS suffix, count(*) AS files, count(DISTINCT sha256(text)) AS distinct_files, round(sum(octet_length(encode(text))) / 1048576, 2) AS size_mb FROM documents GROUP BY lang")
def a10_corpus_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.corpus_card(Tables(spark, sf_dir).documents.select(F.col("lang").alias("suffix"), F.octet_length("text").alias("size"), X.text_sha256(F.col("text")).alias("digest")))


@query("""SELECT c_custkey AS artifact_id, role, ext AS file_type, lower(c_mktsegment) || '_' || 'Unit_' || c_nationkey || '_' || role || '_' || left(c_custkey::varchar, 8) || '.' || ext AS file_name FROM customer, (VALUES ('student_exam', 'docx'), ('teacher_answer', 'docx'), ('explanation', 'docx'), ('answer_sheet', 'docx')) AS r(role, ext)""")
def a13_export_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    roles = tuple((r, "docx") for r in ("student_exam", "teacher_answer", "explanation", "answer_sheet"))
    artifacts = Tables(spark, sf_dir).customer.select(F.col("c_custkey").alias("artifact_id"), F.lower("c_mktsegment").alias("course_name"), F.concat(F.lit("Unit "), F.col("c_nationkey").cast("string")).alias("topic"))
    return T.export_ledger(artifacts, roles).drop("file_path")


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'knowledge_graph' WHEN 1 THEN 'textbook' ELSE 'unknown' END AS source_type, (['.xlsx', '.docx', '.html'])[page_id % 3 + 1] AS suffix FROM pages")
def b01_source_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(F.lit("a.b/f"), F.col("page_id").cast("string"), F.element_at(F.array(F.lit(".XLSX"), F.lit(".docx"), F.lit(".html")), (F.col("page_id") % 3 + 1).cast("int")))
    return Tables(spark, sf_dir).pages.select("page_id", X.source_type_for(path).alias("source_type"), X.suffix(path).alias("suffix"))


@query("""SELECT l_orderkey, l_linenumber, 4 + (l_returnflag <> 'N')::int + (l_linenumber > 1)::int AS n_keys, 2 + (l_tax > 0.04)::int AS n_verified, CASE WHEN l_linestatus = 'O' THEN 'own' ELSE 'true' END AS verified FROM lineitem""")
def b03_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).lineitem.select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).otherwise("").alias("chapter"), F.lit("").alias("section"), F.when(F.col("l_linenumber") > 1, "t").alias("title"), F.lit(0).alias("page"),
        F.lit("c").alias("course_id"), F.lit("d").alias("document_id"), F.lit("s").alias("source_type"), "l_tax", "l_linestatus",
    )
    given = F.map_from_arrays(F.array(F.lit("collection"), F.lit("mode"), F.lit("verified")), F.array(F.lit(None).cast("string"), F.when(F.col("l_tax") > 0.04, F.lit("m")), F.when(F.col("l_linestatus") == "O", "own").otherwise("true")))
    v = T.verified_metadata(given, F.lit("c"), F.lit("k"))
    return T.chunk_metadata(rows).select("l_orderkey", "l_linenumber", F.size("metadata").alias("n_keys"), F.size(v).alias("n_verified"), v["verified"].alias("verified"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN c_custkey % 4 = 1 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment, c_custkey % 4 < 2 AS patched FROM customer")
def b11_patch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = Tables(spark, sf_dir).customer.select("c_custkey", "c_mktsegment", F.lit(0).alias("updated_at"))
    key = F.col("c_custkey")
    patches = base.where(key % 4 < 3).select("c_custkey", F.when(key % 4 < 2, F.array(F.lit("c_mktsegment"))).otherwise(F.array().cast("array<string>")).alias("set_fields"), F.when(key % 4 == 1, "NEW").alias("c_mktsegment"), F.when(key % 4 < 2, 1).otherwise(0).alias("updated_at"))
    return T.patch_rows(base, patches, "c_custkey", ("c_mktsegment",)).select("c_custkey", "c_mktsegment", (F.col("updated_at") == 1).alias("patched"))


@query("""WITH gone AS (SELECT c_custkey FROM customer WHERE c_nationkey = 3)
SELECT 'customer' AS tbl, count(*) AS n, sum(c_custkey)::bigint AS s FROM customer WHERE c_custkey NOT IN (FROM gone)
UNION ALL SELECT 'orders', count(*), sum(o_orderkey)::bigint FROM orders WHERE o_custkey NOT IN (FROM gone)
UNION ALL SELECT 'lineitem', count(*), sum(l_orderkey)::bigint FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (FROM gone))
UNION ALL SELECT 'nulled', count(*), count(CASE WHEN o_custkey NOT IN (FROM gone) THEN 1 END) FROM orders""")
def b12_delete_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    tables = {"customer": (t.customer, "c_custkey"), "orders": (t.orders, "o_orderkey"), "lineitem": (t.lineitem, "l_orderkey"), "nulled": (t.orders, "o_orderkey")}
    edges = [("orders", "lineitem", "l_orderkey", "delete"), ("customer", "orders", "o_custkey", "delete"), ("customer", "nulled", "o_custkey", "null")]
    left = T.cascade_all(tables, edges, {"customer": t.customer.where("c_nationkey = 3").select("c_custkey")})
    total = lambda name, how: left[name].agg(F.lit(name).alias("tbl"), F.count(F.lit(1)).alias("n"), how.alias("s"))
    return total("customer", F.sum("c_custkey")).union(total("orders", F.sum("o_orderkey"))).union(total("lineitem", F.sum("l_orderkey"))).union(total("nulled", F.count("o_custkey")))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderstatus = 'F' THEN 'questions_generated' ELSE 'needs_review' END ELSE CASE WHEN o_orderstatus = 'F' THEN 'draft' ELSE 'needs_review' END END AS status FROM orders""")
def b13_artifact_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).orders.select("o_orderkey", T.artifact_status(F.col("o_orderstatus") == "F", F.when(F.col("o_orderkey") % 2 == 0, "exam").otherwise("lesson")).alias("status"))


@query("""SELECT user_id AS target_id, event_id AS review_id, event_type AS review_status, CASE WHEN event_type = 'purchase' THEN 'pending' ELSE 'not_written' END AS write_back_status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1""")
def b14_review_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    reviews = Tables(spark, sf_dir).events.select(F.lit("question").alias("target_type"), F.col("user_id").alias("target_id"), F.col("event_id").alias("review_id"), F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "approved").otherwise(F.col("event_type")).alias("review_status"), "event_type")
    return T.latest_reviews(reviews).select("target_id", "review_id", F.col("event_type").alias("review_status"), "write_back_status")


@query("""SELECT o_orderkey AS task_id, CASE WHEN count(*) OVER () > 0 THEN 'completed_with_fallback_violations' END AS run_status FROM orders WHERE o_shippriority > 0 OR o_orderkey % 10 = 3""".replace("o_shippriority > 0 OR ", ""))
def b15_fallback_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = Tables(spark, sf_dir).orders.select(F.col("o_orderkey").alias("task_id"), F.when(F.col("o_orderkey") % 10 == 3, 2).alias("fallback_count"))
    bad, status = T.fallback_violations(tasks)
    return bad.select("task_id").crossJoin(status)


@query("""SELECT o_orderkey, o_orderstatus = 'F' AS confirmed, CASE WHEN o_orderstatus <> 'F' THEN 'Exam blueprint must be confirmed first' END AS error FROM orders""")
def b10_confirmed_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = Tables(spark, sf_dir).orders.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "confirmed").otherwise("draft").alias("status"))
    good, bad = T.confirmed_only(plans)
    return good.select("o_orderkey", F.lit(True).alias("confirmed"), F.lit(None).cast("string").alias("error")).union(bad.select("o_orderkey", F.lit(False), "error"))


@query("""SELECT o_orderkey AS id, true AS found FROM orders WHERE o_orderkey IN (SELECT l_partkey FROM lineitem) UNION ALL SELECT DISTINCT l_partkey, false FROM lineitem WHERE l_partkey NOT IN (SELECT o_orderkey FROM orders)""")
def b17_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ids = t.lineitem.select(F.col("l_partkey").alias("id")).distinct()
    found, missing = T.by_id(t.orders.select(F.col("o_orderkey").alias("id")), ids, "id")
    return found.withColumn("found", F.lit(True)).union(missing.withColumn("found", F.lit(False)))


@query("""WITH r AS (SELECT event_id, (['lesson', 'exam', 'other'])[event_id % 3 + 1] AS target_type, user_id FROM events), t AS (SELECT 'lesson' AS target_type, c_custkey AS id, c_nationkey AS course FROM customer UNION ALL SELECT 'exam', s_suppkey, s_nationkey FROM supplier)
SELECT event_id, course AS target_course, course IS NOT NULL AS found FROM r LEFT JOIN t ON t.target_type = r.target_type AND t.id = user_id""")
def c08_resolve_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    reviews = t.events.select("event_id", F.element_at(F.array(F.lit("lesson"), F.lit("exam"), F.lit("other")), (F.col("event_id") % 3 + 1).cast("int")).alias("target_type"), F.col("user_id").cast("string").alias("target_id"))
    targets = {"lesson": t.customer.select(F.col("c_custkey").alias("target_id"), F.col("c_nationkey").alias("course_id")), "exam": t.supplier.select(F.col("s_suppkey").alias("target_id"), F.col("s_nationkey").alias("course_id"))}
    return T.resolve_targets(reviews, targets).select("event_id", "target_course", "found")


@query("""SELECT n_nationkey AS collection_id, count(CASE WHEN c_custkey % 2 = 0 THEN o_orderkey END) AS entry_count FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def c09_vector_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    segments = t.customer.select(F.col("c_custkey").alias("segment_id"), F.col("c_nationkey").alias("collection_id"), F.when(F.col("c_custkey") % 2 == 0, "METADATA").otherwise("VECTOR").alias("scope"))
    return T.vector_stats(t.nation.select(F.col("n_nationkey").alias("collection_id"), F.lit(256).alias("dimension")), segments, t.orders.select(F.col("o_custkey").alias("segment_id"))).drop("dimension")


@query("SELECT conv_id || '.' || turn AS entry_id, text FROM conversations WHERE role = 'user'")
def c10_eav_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all turns, kept as entries with metadata, those that the user says."""
    turns = Tables(spark, sf_dir).conversations.select(F.concat_ws(".", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("entry_id"), "role", "text")
    meta = turns.select("entry_id", F.explode(F.create_map(F.lit("role"), F.col("role"), F.lit("document"), F.col("text"))).alias("key", "string_value"))
    return T.eav_to_rows(turns, meta, "role", "document", "user")


@query("SELECT doc_id AS entry_id, text FROM documents")
def c10_eav_to_rows_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of the entries of every course."""
    docs = Tables(spark, sf_dir).documents.select(F.col("doc_id").alias("entry_id"), "source", "text")
    meta = docs.select("entry_id", F.explode(F.create_map(F.lit("course_id"), F.col("source"), F.lit("document"), F.col("text"))).alias("key", "string_value"))
    return T.eav_to_rows(docs, meta, "course_id", "document")


@query("""WITH a AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY ALL), b AS (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS course_id, coalesce(a.n, 0) AS left_count, coalesce(b.n, 0) AS right_count, coalesce(a.n, 0) = coalesce(b.n, 0) AS matches FROM a FULL JOIN b ON a.k = b.k""")
def c11_count_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return T.count_match(t.customer.select(F.col("c_nationkey").alias("course_id")), t.supplier.select(F.col("s_nationkey").alias("course_id")), "course_id")


@query("""SELECT source AS course_id, count(DISTINCT doc_id) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY ALL""")
def c13_course_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return T.by_id(t.documents, t.labels, "doc_id")[0].groupBy(F.col("source").alias("course_id")).agg(F.countDistinct("doc_id").alias("n"))


@query("""SELECT event_id AS task_id, ((epoch_us(ts + INTERVAL 1 SECOND * value) - epoch_us(ts)) // 1000)::bigint // 1000 AS latency_s FROM events WHERE event_id IN (SELECT o_orderkey FROM orders)""")
def c14_read_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    at = F.col("ts").cast("timestamp")
    tasks = t.events.select(F.col("event_id").alias("task_id"), at.alias("created_at"), at.alias("started_at"), F.timestamp_micros(F.unix_micros(at) + F.round(F.col("value") * 1e6).cast("long")).alias("completed_at"))
    return T.read_tasks(tasks, t.orders.select(F.col("o_orderkey").alias("task_id"))).select("task_id", F.floor(F.col("latency_ms") / 1000).alias("latency_s"))


@query("SELECT source AS course_id, lang AS source_type, count(*) AS chunk_count FROM documents GROUP BY ALL")
def d02_chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counts_by(Tables(spark, sf_dir).documents.select(F.col("source").alias("course_id"), F.col("lang").alias("source_type")), "course_id", "source_type")


@query("SELECT source AS course_id, count(*) AS chunk_count FROM documents GROUP BY ALL")
def d01_chunk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.counts_by(Tables(spark, sf_dir).documents.select(F.col("source").alias("course_id")), "course_id")


@query("SELECT source AS course_id, round(avg(length(text)), 2) AS avg_chars, round(avg(greatest(1, length(text) // 2)), 2) AS avg_tokens FROM documents WHERE trim(text) <> '' GROUP BY ALL")
def d03_chunk_size_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.chunk_size_stats(Tables(spark, sf_dir).documents.select(F.col("source").alias("course_id"), F.col("text").alias("content")))


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders")
def f02_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders with their place: each sorted partition numbers its own rows, behind the counts of those before it."""
    orders = Tables(spark, sf_dir).orders.select("o_orderkey", "o_orderdate")
    return T.with_rank(orders, "pos", F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_orderkey", "pos")


RETRIEVAL_SQL = """q AS (SELECT vec_id AS query_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.query_id, q.label AS want, e.vec_id, e.label, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) AS distance FROM q, embeddings e),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id::varchar) AS rank FROM d),
top AS (SELECT * FROM r WHERE rank <= 8), n AS (SELECT label, count(*) AS n FROM embeddings GROUP BY label),
m AS (SELECT query_id, count(*) FILTER (label = want) AS h, any_value(n.n) AS n, coalesce(1 / min(rank) FILTER (label = want), 0) AS rr, sum(CASE WHEN top.label = want THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top JOIN n ON n.label = want GROUP BY query_id)"""
RETRIEVAL_SQL = RETRIEVAL_SQL.replace("(label = want)", "(WHERE top.label = want)")


@query(f"""WITH {RETRIEVAL_SQL} SELECT round(avg(h / n), 6) AS recall_at_k, avg((h > 0)::int) AS hit_at_k, round(avg(rr), 6) AS mrr, round(avg(dcg / (SELECT sum(1 / log2(i + 1)) FROM range(1, least(n, 8) + 1) AS t(i))), 6) AS ndcg, round(avg(h / 8), 6) AS context_precision FROM m""")
def d07_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = Tables(spark, sf_dir).vectors().withColumn("course_id", F.lit("all"))
    queries = chunks.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "course_id", F.lit("").alias("chapter"), F.lit("").alias("source_type"), F.lit(None).cast("boolean").alias("verified_only"), "embedding", F.col("label").alias("want"))
    asked = queries.select("query_id", "want")
    retrieved = search(chunks, queries, 8).join(asked, "query_id").withColumn("hit", F.col("label") == F.col("want"))
    n_expected = chunks.groupBy("label").agg(F.count_distinct("chunk_id").alias("n_expected"))
    r = M.rank_metrics(retrieved, asked.join(n_expected, F.col("want") == F.col("label")))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


LABELLED_SQL = f"{RETRIEVAL_SQL}, hits AS (SELECT query_id, rank, contains('label ' || label || '.', 'label ' || want || '.') AND vec_id % 2 = 1 AS hit FROM top)"
LABELS_SQL = "SELECT query_id, count(*) AS n_retrieved, greatest(1, count(*) FILTER (WHERE hit)) AS n_expected, count(*) FILTER (WHERE hit) = 0 AS missing FROM hits GROUP BY ALL"


def described_search(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(results, cases): the 8 nearest of all vectors to every 50th, each described by its label and kind; a relevant one has the query's label and is odd."""
    chunks = t.vectors().withColumn("course_id", F.lit("all")).withColumn("content", F.concat(F.lit("Label "), F.col("label").cast("string"), F.lit(". "), "source_type"))
    asked = chunks.where("vec_id % 50 = 0").withColumn("query_id", F.col("vec_id"))
    queries = asked.select("query_id", "course_id", F.lit("").alias("chapter"), F.lit("").alias("source_type"), F.lit(None).cast("boolean").alias("verified_only"), "embedding")
    return search(chunks, queries, 8), asked.select("query_id", F.col("content").alias("query"), F.array(F.concat(F.lit("LABEL "), F.col("label").cast("string"), F.lit(".")), F.lit("Odd")).alias("terms"))


@query(f"WITH {LABELLED_SQL} {LABELS_SQL}")
def b07_relevance_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of what a search of all vectors finds."""
    out = M.relevance_labels(*described_search(Tables(spark, sf_dir)))
    return out.select("query_id", F.size("retrieved").cast("long").alias("n_retrieved"), F.size("expected").cast("long").alias("n_expected"), F.exists("expected", lambda x: x.startswith("__missing__:")).alias("missing"))


@query("""SELECT round(avg((l_discount > 0.05)::int), 6) AS citation_coverage, round(avg((l_tax > 0.02)::int), 6) AS schema_pass_rate, round(avg((l_returnflag <> 'N' AND l_linestatus = 'F')::int), 6) AS answer_completeness,
(SELECT round(avg((s.s_suppkey IS NOT NULL AND s.s_acctbal > 0)::int), 6) FROM customer LEFT JOIN supplier s ON s_suppkey = c_custkey) AS export_success_rate,
(SELECT round(avg(a), 6) FROM (SELECT l_orderkey, avg((CASE WHEN l_returnflag = 'R' THEN n + 1 ELSE n END = n)::int) AS a FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY ALL)) AS question_count_accuracy FROM lineitem""")
def d16_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    line = t.lineitem
    counts = line.groupBy("l_orderkey", "l_returnflag").agg(F.count(F.lit(1)).cast("int").alias("n")).groupBy("l_orderkey").agg(
        F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("actual"), F.map_from_entries(F.collect_list(F.struct("l_returnflag", F.when(F.col("l_returnflag") == "R", F.col("n") + 1).otherwise(F.col("n"))))).alias("expected"))
    report = M.evaluate(
        spark.sql("SELECT array('a') AS expected, array('a') AS retrieved"), line.select(F.when(F.col("l_discount") > 0.05, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("citation_chunk_ids")),
        line.select((F.col("l_tax") > 0.02).alias("schema_valid")), counts, line.select((F.col("l_returnflag") != "N").alias("has_answer"), (F.col("l_linestatus") == "F").alias("has_explanation")),
        t.customer.select(F.col("c_custkey").cast("string").alias("file_path")), t.supplier.select(F.col("s_suppkey").cast("string").alias("path"), F.when(F.col("s_acctbal") > 0, 1).otherwise(0).alias("length")),
    )
    return report.select(*[F.round(c, 6).alias(c) for c in ("citation_coverage", "schema_pass_rate", "answer_completeness", "export_success_rate", "question_count_accuracy")])
