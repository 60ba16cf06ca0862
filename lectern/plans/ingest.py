"""Queries on chunking, scalar functions, embeddings and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as X
from lectern.functions import vectors as V
from lectern.operators.chunking import chunk_documents, chunk_sections
from lectern.operators.kb import build_kb, refresh_kb
from lectern.operators.lineage import settled
from lectern.operators.search import context_query, embed, require_context, search, search_result, sparse_embeddings
from lectern.plans.base import CHUNKS_SQL, Tables, query

TOK = r"[\x{4e00}-\x{9fff}A-Za-z0-9_]+"
KEY = r"[\x{4e00}-\x{9fff}A-Za-z][\x{4e00}-\x{9fff}A-Za-z0-9_-]{2,20}"


@query(rf"""WITH RECURSIVE {CHUNKS_SQL}
SELECT source AS course_id, doc_id AS document_id, lang AS source_type, chunk_pos, content, length(content) AS n_chars FROM chunks""")
def i01_chunk_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = chunk_sections(Tables(spark, sf_dir).sections())
    return chunks.select("course_id", "document_id", "source_type", F.col("chunk_pos").cast("long").alias("chunk_pos"), "content", F.length("content").cast("long").alias("n_chars"))


@query(rf"""WITH RECURSIVE {CHUNKS_SQL}
SELECT source AS course_id, lang AS source_type, count(*) AS chunk_count, sum(length(content))::bigint AS n_chars, max(length(content))::bigint AS longest FROM chunks GROUP BY ALL""")
def i02_chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = Tables(spark, sf_dir).sections().select("course_id", "document_id", "source_type", "content")
    return chunk_documents(docs).groupBy("course_id", "source_type").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum(F.length("content")).alias("n_chars"), F.max(F.length("content")).cast("long").alias("longest"))


@query(r"""SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS stripped, left(text, 1000) AS preview, length(text) AS n_chars FROM documents""")
def h01_strip_and_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", X.strip(F.col("text")).alias("stripped"), F.left("text", F.lit(1000)).alias("preview"), F.length("text").cast("long").alias("n_chars"))


@query(r"""WITH parts AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS p FROM documents)
SELECT doc_id, CASE WHEN length(p) <= 400 THEN p ELSE substr(p, w, 400) END AS paragraph FROM parts, unnest(CASE WHEN length(p) <= 400 THEN [1] ELSE range(1, length(p) + 1, 340) END) AS t(w)""")
def h02_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).sections().select(F.col("document_id").alias("doc_id"), F.explode(X.paragraphs(F.col("content"), 400, 60)).alias("paragraph"))


@query(r"""SELECT p_partkey, regexp_extract(h, '^\s*((第[一二三四五六七八九十百\d]+[章节篇])|(\d+(?:\.\d+){0,3})|(chapter\s+\d+))[\s:：、.-]*(.*)$', 1, 'i') AS token
FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'Chapter ' || p_size || ': ' || p_name WHEN 1 THEN '第' || p_size || '章 ' || p_name WHEN 2 THEN p_size || '.' || (p_partkey % 9) || ' ' || p_name ELSE p_name END AS h FROM part)""")
def h03_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(n % 4 == 0, F.concat(F.lit("Chapter "), size, F.lit(": "), "p_name")).when(n % 4 == 1, F.concat(F.lit("第"), size, F.lit("章 "), "p_name")).when(n % 4 == 2, F.concat(size, F.lit("."), (n % 9).cast("string"), F.lit(" "), "p_name")).otherwise(F.col("p_name"))
    return Tables(spark, sf_dir).part.select("p_partkey", X.heading(text).alias("token"))


@query(rf"""WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '{KEY}')) AS w, generate_subscripts(regexp_extract_all(text, '{KEY}'), 1) AS i FROM documents),
f AS (SELECT doc_id, w, min(i) AS i FROM k GROUP BY ALL),
r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM f)
SELECT doc_id, n AS rank, w AS keyword FROM r WHERE n <= 10""")
def h04_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).documents.select("doc_id", F.posexplode(X.keywords(F.col("text"))).alias("rank", "keyword")).select("doc_id", (F.col("rank") + 1).cast("long").alias("rank"), "keyword")


@query(rf"SELECT doc_id, len(regexp_extract_all(lower(text), '{TOK}')) AS n_tokens, len(list_distinct(regexp_extract_all(lower(text), '{TOK}'))) AS n_distinct FROM documents")
def h05_hash_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = X.hash_tokens(F.col("text"))
    return Tables(spark, sf_dir).documents.select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"))


EMBED_SQL = rf"""e AS (SELECT id, slot, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM (
    SELECT id, (('0x' || substr(h, 1, 8))::ubigint % 256)::int AS slot, sum(CASE WHEN ('0x' || substr(h, 9, 2))::ubigint % 2 = 0 THEN 1.0::double ELSE -1.0::double END) AS w
    FROM (SELECT id, sha256(t) AS h FROM (SELECT id, unnest(regexp_extract_all(lower(body), '{TOK}')) AS t FROM src)) GROUP BY ALL HAVING w <> 0))"""


@query(rf"WITH src AS (SELECT item_id AS id, text AS body FROM benchmark), {EMBED_SQL} SELECT id AS item_id, slot, round(weight, 6) AS weight FROM e")
def h06_hashing_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).benchmark.select("item_id", F.posexplode(V.hashing_embedding(F.col("text"))).alias("slot", "weight"))
    return rows.where("weight <> 0").select("item_id", "slot", F.round("weight", 6).alias("weight"))


@query(rf"WITH src AS (SELECT doc_id AS id, text AS body FROM documents), {EMBED_SQL} SELECT id AS doc_id, count(*) AS n_slots, round(sum(abs(weight)), 5) AS l1 FROM e GROUP BY ALL")
def h06_sparse_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sparse_embeddings(Tables(spark, sf_dir).documents, "doc_id", "text")
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_slots"), F.round(F.sum(F.abs("weight")), 5).alias("l1"))


@query("""SELECT a.vec_id, round(list_sum(list_transform(range(1, 65), lambda i: a.embedding[i]::double * b.embedding[i]::double)), 5) AS dot,
round(list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2)), 5) AS l2,
round(1 / (1 + list_sum(list_transform(range(1, 65), lambda i: (a.embedding[i]::double - b.embedding[i]::double) ** 2))), 6) AS score
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def h07_vector_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = Tables(spark, sf_dir).embeddings
    a, b = e.alias("a"), e.alias("b")
    x, y = F.col("a.embedding"), F.col("b.embedding")
    return a.join(b, F.col("b.vec_id") == F.col("a.vec_id") + 1).select("a.vec_id", F.round(V.dot(x, y), 5).alias("dot"), F.round(V.l2_squared(x, y), 5).alias("l2"), F.round(V.distance_to_score(V.l2_squared(x, y)), 6).alias("score"))


@query(r"""SELECT c_custkey, left('course_' || regexp_replace(c_name, '[^A-Za-z0-9_-]', '_', 'g'), 63) AS collection, sha256(c_name) AS digest,
sha256(regexp_replace(c_name, '^\s+|\s+$', '', 'g') || chr(10) || chr(10) || 'Answer in English.') AS prompt_digest, 'eval:' || c_mktsegment || ':' || left(sha256(c_name), 32) AS step_key,
length(regexp_replace(c_name, '^\s+|\s+$', '', 'g')) BETWEEN 1 AND 255 AS valid,
trim(regexp_replace(regexp_replace(c_name, '[^\w-]+', '_', 'g'), '_+', '_', 'g'), '_') || '_' || lower(c_mktsegment) || '_quiz_' || left(sha256(c_name), 8) || '.docx' AS export_name FROM customer""")
def h10_names_and_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("c_name")
    return Tables(spark, sf_dir).customer.select(
        "c_custkey", X.collection_name(name).alias("collection"), X.text_sha256(name).alias("digest"), X.prompt_hash(name, "Answer in English.").alias("prompt_digest"),
        X.step_key(F.col("c_mktsegment"), name).alias("step_key"), X.valid_key(name).alias("valid"),
        X.export_name(name, F.lower("c_mktsegment"), F.lit("quiz"), X.text_sha256(name), ".docx").alias("export_name"),
    )


@query("""SELECT event_id, sha256('{"k":' || (props ->> 'k') || '}') AS request_hash, sha256('{"k":"' || (props ->> 'k') || '"}') AS fingerprint FROM events""")
def h12_request_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).events.select("event_id", X.request_hash(F.col("props")).alias("request_hash"), X.fingerprint(F.col("props"), ("timeout",)).alias("fingerprint"))


@query("""SELECT o_orderkey, CASE WHEN n BETWEEN 0 AND 4 THEN n ELSE 0 END AS target FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE (o_orderkey % 8)::int - 1 END AS n FROM orders)""")
def h18_target_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    scope = F.when(key % 3 == 0, F.lit("the introduction")).otherwise(F.concat(F.lit("第 "), (key % 8).cast("string"), F.lit(" 课时")))
    return Tables(spark, sf_dir).orders.select("o_orderkey", X.target_session(scope, F.lit(5)).alias("target"))


@query("""SELECT p_partkey, a.activity, a.minutes FROM (SELECT p_partkey, unnest([
{'activity': '导入与目标说明', 'minutes': greatest(5, p_size // 9)}, {'activity': '核心概念讲解', 'minutes': p_size - greatest(5, p_size // 9) - greatest(5, p_size // 4) - 5},
{'activity': '课堂练习与互动', 'minutes': greatest(5, p_size // 4)}, {'activity': '总结与作业说明', 'minutes': 5}]) AS a FROM part)""")
def h19_time_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tables(spark, sf_dir).part.select("p_partkey", F.explode(X.time_allocation(F.col("p_size"))).alias("a")).select("p_partkey", "a.activity", "a.minutes")


@query("""WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS words FROM part), i AS (SELECT p_partkey, words, unnest(range(1, 4)) AS i FROM w),
s AS (SELECT p_partkey, i, words, greatest(1, len(words) // 3) AS b FROM i), c AS (SELECT p_partkey, i, words, words[(i - 1) * b + 1 : CASE WHEN i = 3 THEN len(words) ELSE i * b END][1:5] AS cut FROM s)
SELECT p_partkey, i AS session_index, array_to_string(CASE WHEN len(cut) > 0 THEN cut ELSE words[1:1] END, ',') AS points FROM c""")
def h20_slice_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Tables(spark, sf_dir).part.select("p_partkey", F.split("p_name", " ").alias("w"), F.explode(F.expr("sequence(1, 3)")).alias("i"))
    return rows.select("p_partkey", F.col("i").cast("long").alias("session_index"), F.array_join(X.slice_points(F.col("w"), F.col("i"), F.lit(3)), ",").alias("points"))


@query("""WITH t AS (SELECT user_id, event_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events)
SELECT event_id, ((epoch_us(next) - epoch_us(ts)) // 1000)::bigint AS latency_ms, epoch_us(ts + INTERVAL 300 SECOND) AS deadline_us, coalesce(ts + INTERVAL 300 SECOND > next, false) AS busy FROM t""")
def h21_latency_and_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    at = F.col("ts").cast("timestamp")
    rows = Tables(spark, sf_dir).events.select("event_id", at.alias("ts"), F.lead(at).over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("next"))
    lease = X.lease_deadline(F.col("ts"), 300)
    return rows.select("event_id", X.latency_ms(F.col("ts"), F.col("next")).alias("latency_ms"), F.unix_micros(lease).alias("deadline_us"), X.is_future(lease, F.col("next")).alias("busy"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN '正确' END AS judgement, o_orderkey % 2 + 1 AS n_answers FROM orders""")
def h23_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    said = F.when(key % 4 == 0, F.lit(" TRUE ")).when(key % 4 == 1, F.lit("False")).when(key % 4 == 2, F.lit(" 正确")).otherwise(F.lit("maybe"))
    several = F.when(key % 2 == 0, F.lit("A, A,, ")).otherwise(F.lit("A , B,A"))
    return Tables(spark, sf_dir).orders.select("o_orderkey", X.normal_judgement(said).alias("judgement"), F.size(X.split_answers(several)).cast("long").alias("n_answers"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'timeout' WHEN event_type = 'view' THEN 'structured_parse_error' WHEN event_type = 'purchase' THEN 'llm_provider_error' ELSE 'unknown_llm_error' END AS category, event_type NOT IN ('click', 'view') AS interrupted FROM events""")
def h25_error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    name = F.when(kind == "click", "ReadTimeout").when(kind == "purchase", "RateLimitError").otherwise("ValueError")
    message = F.when(kind == "view", "could not parse reply").otherwise(kind)
    reason = F.when(kind == "click", "stop").when(kind == "view", "").otherwise("length")
    return Tables(spark, sf_dir).events.select("event_id", X.error_category(name, F.lit("app"), message).alias("category"), X.interrupted(reason).alias("interrupted"))


@query("""SELECT conv_id, turn, greatest(1, length(role || ': ' || text) // 2) AS input_tokens, greatest(1, length(text) // 2) AS output_tokens, greatest(1, length(role || ': ' || text) // 2) + greatest(1, length(text) // 2) AS total_tokens, 'estimate' AS usage_source FROM conversations WHERE turn % 2 = 0
UNION ALL SELECT conv_id, turn, turn, conv_id, turn + conv_id, 'provider' FROM conversations WHERE turn % 2 = 1""")
def h27_resolve_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("turn") % 2 == 1, F.concat(F.lit('{"prompt_tokens": '), F.col("turn").cast("string"), F.lit(', "completion_tokens": '), F.col("conv_id").cast("string"), F.lit("}")))
    u = X.resolve_usage(said, F.concat("role", F.lit(": "), "text"), F.col("text"))
    return Tables(spark, sf_dir).conversations.withColumn("u", u).select("conv_id", "turn", "u.*")


@query("SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS body, count(*) AS n_turns FROM conversations GROUP BY conv_id")
def h28_message_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = Tables(spark, sf_dir).conversations.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))).alias("t"), F.count(F.lit(1)).alias("n_turns"))
    return turns.select("conv_id", X.message_text(F.col("t")).alias("body"), "n_turns")


VECTOR_SQL = """WITH q AS (SELECT vec_id AS query_id, 'c' || label AS course_id, embedding, label FROM embeddings WHERE vec_id % 50 = 0),
d AS (SELECT q.query_id, q.label AS q_label, e.vec_id, e.label, list_sum(list_transform(range(1, 65), lambda i: (e.embedding[i]::double - q.embedding[i]::double) ** 2)) AS distance FROM q JOIN embeddings e ON {on}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id::varchar) AS rank FROM d)"""


@query(VECTOR_SQL.format(on="e.label = q.label AND (q.query_id % 100 <> 0 OR e.vec_id % 3 = 0)") + " SELECT query_id, rank, vec_id::varchar AS chunk_id, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= 5")
def f01_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    chunks = t.vectors()
    queries = chunks.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "course_id", F.lit("").alias("chapter"), F.lit(None).cast("string").alias("source_type"), F.when(F.col("vec_id") % 100 == 0, F.lit(True)).alias("verified_only"), "embedding")
    return search(chunks, queries).select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 6).alias("score"))


@query(VECTOR_SQL.format(on="e.label = q.label AND e.vec_id % 2 = 1 AND e.vec_id % 3 <> 0") + " SELECT query_id, rank, vec_id::varchar AS chunk_id, '' AS document_id, 'c' || label AS course_id, 'odd' AS source_type, false AS verified, round(1 / (1 + distance), 6) AS score FROM r WHERE rank <= (query_id % 20) + 1")
def i04_retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = Tables(spark, sf_dir).vectors().withColumns({c: F.lit(None).cast("string") for c in ("document_id", "section", "title", "content")} | {"page": F.lit(None).cast("int")})
    queries = chunks.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "course_id", "chapter", F.lit("odd").alias("source_type"), F.lit(False).alias("verified_only"), "embedding", (F.col("vec_id") % 20 + 1).cast("int").alias("top_k"))
    found = search_result(search(chunks, queries))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", "document_id", "course_id", "source_type", "verified", F.round("score", 6).alias("score"))


@query(rf"""WITH RECURSIVE {CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS n, sum(length(content))::bigint AS n_chars FROM chunks WHERE doc_id % 17 <> 0 GROUP BY ALL)
SELECT doc_id AS document_id, source AS course_id, CASE WHEN n IS NULL THEN 'failed' ELSE 'built' END AS parse_status, coalesce(n, 0) AS chunk_count,
CASE WHEN doc_id % 17 = 0 THEN 'unreadable' WHEN n IS NULL THEN 'No text chunks were extracted from this document' END AS error_message, coalesce(n.n_chars, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 0 END) AS n_chars
FROM documents LEFT JOIN n USING (doc_id)""")
def i03_build_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents built into a base that holds an old chunk of each second one; every 17th can't be read and keeps it."""
    sections = Tables(spark, sf_dir).sections().withColumn("error", F.when(F.col("document_id") % 17 == 0, "unreadable"))
    first, _ = build_kb(sections.limit(0))
    old = sections.where("document_id % 2 = 0").select(*[(F.col(c) if c in ("course_id", "document_id") else F.lit("old").alias(c) if c == "content" else F.lit(None).cast(k).alias(c)) for c, k in first.dtypes])
    chunks, report = build_kb(sections, old)
    n_chars = chunks.groupBy("document_id").agg(F.sum(F.length("content")).alias("n_chars"))
    return report.join(n_chars, "document_id", "left").select("document_id", "course_id", "parse_status", F.col("chunk_count").cast("long").alias("chunk_count"), "error_message", F.coalesce("n_chars", F.lit(0)).cast("long").alias("n_chars"))


@query(rf"""WITH RECURSIVE {CHUNKS_SQL}, n AS (SELECT doc_id, count(*) AS n, sum(length(content))::bigint AS n_chars FROM chunks GROUP BY ALL),
d AS (SELECT doc_id, source, coalesce(n, 0) AS n, coalesce(n.n_chars, 0) AS n_chars, doc_id % 17 = 0 AS bad, doc_id % 7 <> 0 AS known, doc_id % 5 = 0 AS changed FROM documents LEFT JOIN n USING (doc_id))
SELECT doc_id AS document_id, source AS course_id, CASE WHEN bad OR n = 0 THEN 'failed' ELSE 'built' END AS parse_status, CASE WHEN bad THEN 0 ELSE n END AS chunk_count,
CASE WHEN bad THEN 'unreadable' WHEN n = 0 THEN 'No text chunks were extracted from this document' END AS error_message, CASE WHEN NOT bad THEN n_chars WHEN known THEN 3 ELSE 0 END AS n_chars,
CASE WHEN bad THEN known::bigint WHEN known AND NOT changed THEN n ELSE 0 END AS n_kept FROM d""")
def i03_refresh_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A base of six in seven documents, some with an old text, and of copies that are gone, brought up to date with all documents; every 17th can't be read any more.  What is kept is known by its verification."""
    sections = Tables(spark, sf_dir).sections()
    before = sections.where("document_id % 7 <> 0").withColumn("content", F.when((F.col("document_id") % 5 == 0) | (F.col("document_id") % 17 == 0), "old").otherwise(F.col("content")))
    gone = sections.where("document_id % 11 = 1").withColumn("document_id", -F.col("document_id"))
    chunks, report = refresh_kb(before.unionByName(gone))
    now = sections.withColumn("error", F.when(F.col("document_id") % 17 == 0, "unreadable"))
    chunks, report = refresh_kb(now, chunks.withColumn("verified", F.lit(True)), settled(report))
    sums = chunks.groupBy("document_id").agg(F.sum(F.length("content")).alias("n_chars"), F.count_if("verified").alias("n_kept"))
    n = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return report.join(sums, "document_id", "left").select("document_id", "course_id", "parse_status", n("chunk_count"), "error_message", n("n_chars"), n("n_kept"))


@query(rf"WITH RECURSIVE {CHUNKS_SQL} SELECT source AS course_id, doc_id AS document_id, chunk_pos, '#' || left(content, 7) AS points FROM chunks")
def m05_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all documents with knowledge points of another making."""
    chunks = chunk_sections(Tables(spark, sf_dir).sections(), extractor=lambda content, most: F.slice(F.array(F.concat(F.lit("#"), F.left(content, F.lit(7))), F.lit("-")), 1, most))
    return chunks.select("course_id", "document_id", F.col("chunk_pos").cast("long").alias("chunk_pos"), F.col("knowledge_points")[0].alias("points"))


def benchmark_chunks(t: Tables) -> DataFrame:
    """The chunks of every document with vectors, all in one course."""
    chunks = chunk_sections(t.sections()).withColumn("verified", F.lit(False)).withColumn("course_id", F.lit("all"))
    return embed(chunks.withColumn("chunk_id", F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_pos").cast("string"))))


def benchmark_search(t: Tables, k: int = 8, source_type: Column | None = None) -> DataFrame:
    """Every benchmark text as a query against the chunks of all documents (of its ``source_type``, if it has one): the k nearest of each."""
    wanted = F.lit("") if source_type is None else source_type
    queries = embed(t.benchmark, "text").select(F.col("item_id").alias("query_id"), F.lit("all").alias("course_id"), F.lit("").alias("chapter"), wanted.alias("source_type"), F.lit(None).cast("boolean").alias("verified_only"), "embedding")
    return search(benchmark_chunks(t), queries, k, digits=9)


def benchmark_sql(on: str = "true") -> str:
    """SQL of :func:`benchmark_search`: the pairs (item, chunk) that are compared hold ``on``."""
    return rf"""{CHUNKS_SQL}, ids AS MATERIALIZED (SELECT doc_id || ':' || chunk_pos AS id, lang, content FROM chunks), src AS (SELECT id, content AS body FROM ids UNION ALL SELECT 'q' || item_id, text FROM benchmark), {EMBED_SQL},
known AS (SELECT DISTINCT id FROM e),
dots AS (SELECT a.id, b.id AS qid, sum(a.weight * b.weight) AS dot FROM e a JOIN e b ON a.slot = b.slot WHERE b.id LIKE 'q%' AND a.id NOT LIKE 'q%' GROUP BY ALL),
x AS (SELECT item_id, ids.id, round((c.id IS NOT NULL)::int + (s.id IS NOT NULL)::int - 2 * coalesce(dot, 0), 9) AS distance
FROM ids JOIN benchmark ON {on} LEFT JOIN dots ON dots.id = ids.id AND dots.qid = 'q' || item_id LEFT JOIN known c ON c.id = ids.id LEFT JOIN known s ON s.id = 'q' || item_id),
found AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY distance, id) AS rank FROM x) WHERE rank <= 8)"""


@query(f"WITH RECURSIVE {benchmark_sql("item_id % 2 = 1 OR lang = 'en'")} SELECT item_id AS query_id, rank, id AS chunk_id, round(1 / (1 + greatest(distance, 0)), 5) AS score FROM found")
def i03_knowledge_base_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to chunks to vectors; every second benchmark text asks all chunks, the others those of English documents."""
    found = benchmark_search(Tables(spark, sf_dir), source_type=F.when(F.col("item_id") % 2 == 0, "en").otherwise(""))
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), "chunk_id", F.round("score", 5).alias("score"))


@query(f"WITH RECURSIVE {benchmark_sql()} SELECT item_id AS query_id, rank, round(1 / (1 + greatest(distance, 0)), 5) AS score FROM found")
def i03_search_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: the chunks of all documents, searched by every benchmark text."""
    return benchmark_search(Tables(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), F.round("score", 5).alias("score"))


@query("""WITH r AS (SELECT o_orderkey AS request_id, CASE o_orderkey % 3 WHEN 0 THEN 'lesson' WHEN 1 THEN 'exam' ELSE 'other' END AS kind, o_orderpriority AS a, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE '' END AS b FROM orders)
SELECT request_id, CASE kind WHEN 'lesson' THEN trim(a || ' ' || b) WHEN 'exam' THEN a ELSE 'find ' || request_id END AS query, CASE kind WHEN 'other' THEN 5 ELSE 8 END AS k FROM r""")
def b08_context_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 3 == 0, "lesson").when(key % 3 == 1, "exam").otherwise("other")
    c = context_query(kind, F.col("o_orderpriority"), F.when(key % 2 == 0, F.col("o_orderstatus")).otherwise(""), F.concat(F.lit("find "), key.cast("string")))
    return Tables(spark, sf_dir).orders.select(key.alias("request_id"), c["query"].alias("query"), c["k"].alias("k"))


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_quantity > 40 GROUP BY ALL)
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE coalesce(n, 0) END AS n_contexts, o_orderkey % 3 < 2 AND o_orderkey % 5 <> 0 AND coalesce(n, 0) = 0 AS failed FROM orders LEFT JOIN g ON l_orderkey = o_orderkey""")
def b09_require_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, key = Tables(spark, sf_dir), F.col("o_orderkey")
    requests = t.orders.select(key.alias("request_id"), F.when(key % 3 == 0, "lesson").when(key % 3 == 1, "exam").otherwise("other").alias("kind"), F.when(key % 5 == 0, F.array(F.lit("given"))).alias("supplied"))
    found = t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("request_id"), F.col("l_linenumber").cast("int").alias("rank"), F.col("l_partkey").cast("string").alias("chunk_id"))
    return require_context(requests, found).select("request_id", F.col("n_contexts").cast("long").alias("n_contexts"), "failed")
