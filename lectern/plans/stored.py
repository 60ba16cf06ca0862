"""Queries on what the library writes and reads: files, chunk tables, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.chunking import chunk_sections
from lectern.operators.lineage import shared_folder
from lectern.operators.tables import write_chunks
from lectern.plans.base import CHUNKS_SQL, Tables, query
from lectern.sources.files import scan_files, scan_markdown, scan_sections, write_report


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _text_files(spark: SparkSession, sf_dir: str) -> str:
    """A glob of the benchmark texts, one file each in a folder of its number."""
    path = _place(spark, "texts")
    Tables(spark, sf_dir).benchmark.select("item_id", "text").repartition("item_id").write.partitionBy("item_id").text(path)
    return f"{path}/*/*.txt"


def _item() -> Column:
    return F.regexp_extract("path", "item_id=([0-9]+)", 1).cast("long").alias("item_id")


@query("SELECT item_id, '.txt' AS suffix, strlen(text) + 1 AS length, sha256(text || chr(10)) AS digest, NULL::varchar AS error FROM benchmark")
def a01_scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_files(spark, _text_files(spark, sf_dir)).select(_item(), "suffix", "length", F.sha2("content", 256).alias("digest"), "error")


@query(r"SELECT item_id, 0 AS section_pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM benchmark")
def a03_scan_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_sections(spark, _text_files(spark, sf_dir))[0].select(_item(), "section_pos", "content")


@query(r"SELECT item_id, 0 AS section_pos, regexp_replace(text, '^\s+|\s+$', '', 'g') AS content FROM benchmark")
def a04_scan_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files of the benchmark texts, taken as markdown."""
    sections, failed = scan_markdown(scan_files(spark, _text_files(spark, sf_dir)).withColumn("suffix", F.lit(".md")))
    return sections.select(_item(), "section_pos", "content").unionByName(failed.select(_item(), F.lit(-1).alias("section_pos"), F.col("error").alias("content")))


@query(rf"WITH RECURSIVE {CHUNKS_SQL} SELECT source AS course_id, doc_id AS document_id, chunk_pos, content, left(content, 1000) AS content_preview FROM chunks")
def a07_write_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of all courses written twice, the second time in place of the first."""
    path = _place(spark, "chunks")
    chunks = chunk_sections(Tables(spark, sf_dir).sections())
    write_chunks(chunks.withColumn("content", F.lit("old")), path)
    write_chunks(chunks, path)
    return spark.read.schema(chunks.select("course_id", "document_id", "chunk_pos", "content").schema.add("content_preview", "string")).parquet(path).withColumn("chunk_pos", F.col("chunk_pos").cast("long"))


@query("""SELECT '{"balance":' || s_acctbal::decimal(18, 2) || ',"name":"' || s_name || '","supplier":' || s_suppkey || '}' AS value FROM supplier""")
def a12_write_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "report")
    write_report(Tables(spark, sf_dir).supplier.select(F.col("s_suppkey").alias("supplier"), F.col("s_name").alias("name"), F.col("s_acctbal").cast("decimal(18,2)").alias("balance")), path)
    return spark.read.text(path)
