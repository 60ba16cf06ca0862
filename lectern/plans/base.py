"""The registry of queries over the driver's tables, and how those tables stand for the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.lineage import spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name, with DuckDB SQL for the same rows if SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


class Tables:
    """The tables of a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sections(self) -> DataFrame:
        """Documents as one section each: source is the course, lang the source type; lines are paragraphs."""
        return spread(self.documents.select("source", "doc_id", "lang", "text")).select(
            F.col("source").alias("course_id"), F.col("doc_id").alias("document_id"), F.col("lang").alias("source_type"), F.lit(0).alias("section_pos"),
            F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("title"), F.regexp_replace("text", "\n", "\n\n").alias("content"),
        )

    def vectors(self) -> DataFrame:
        """Embeddings as chunks: the label is the course; every third one is verified."""
        return self.embeddings.select(
            F.concat(F.lit("c"), F.col("label").cast("string")).alias("course_id"), F.col("vec_id").cast("string").alias("chunk_id"), F.lit(None).cast("string").alias("chapter"),
            F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("source_type"), (F.col("vec_id") % 3 == 0).alias("verified"), F.col("embedding").cast("array<double>").alias("embedding"), "label", "vec_id",
        )


CHUNKS_SQL = r"""
    parts AS (
        SELECT doc_id, source, lang, unnest(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> '')) AS p,
               generate_subscripts(list_filter(list_transform(regexp_split_to_array(replace(text, chr(10), chr(10) || chr(10)), '\n\s*\n'), lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')), lambda p: p <> ''), 1) AS i
        FROM documents),
    windows AS (SELECT doc_id, source, lang, i, CASE WHEN length(p) <= 1000 THEN p ELSE substr(p, w, 1000) END AS p, w
        FROM parts, unnest(CASE WHEN length(p) <= 1000 THEN [1] ELSE range(1, length(p) + 1, 850) END) AS t(w)),
    paras AS MATERIALIZED (SELECT doc_id, source, lang, p, row_number() OVER (PARTITION BY doc_id ORDER BY i, w) AS n FROM windows),
    fold(doc_id, source, lang, n, buffer, flushed) AS (
        SELECT doc_id, source, lang, 1::bigint, regexp_replace(p, '^\s+|\s+$', '', 'g'), NULL::varchar FROM paras WHERE n = 1
        UNION ALL
        SELECT f.doc_id, f.source, f.lang, p.n,
               regexp_replace(CASE WHEN length(f.buffer) + length(p.p) + 2 > 1000 AND f.buffer <> '' THEN right(f.buffer, 150) ELSE f.buffer END || chr(10) || chr(10) || p.p, '^\s+|\s+$', '', 'g'),
               CASE WHEN length(f.buffer) + length(p.p) + 2 > 1000 AND f.buffer <> '' THEN f.buffer END
        FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.n = f.n + 1),
    ends AS (SELECT doc_id, max(n) AS last FROM fold GROUP BY doc_id),
    emitted AS (
        SELECT doc_id, source, lang, n, flushed AS content FROM fold WHERE flushed IS NOT NULL
        UNION ALL
        SELECT f.doc_id, f.source, f.lang, f.n + 1, f.buffer FROM fold f JOIN ends e ON e.doc_id = f.doc_id AND e.last = f.n WHERE f.buffer <> ''),
    chunks AS MATERIALIZED (SELECT doc_id, source, lang, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS chunk_pos FROM emitted)
"""
