"""Readers of course files: binary listing, routing by suffix, text decoding, tables, pages."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import source_type_for, strip, suffix
from lectern.operators.lineage import settled

Reader = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]
SECTION = "path string, section_pos int, page int, title string, content string"
READERS: dict[str, Reader] = {}


def register_reader(ending: str, reader: Reader) -> None:
    """Read files with this suffix by ``reader``: batches (path, content bytes) to batches of SECTION."""
    READERS[ending.lower()] = reader


def scan_files(spark: SparkSession, glob: str) -> DataFrame:
    """(path, suffix, length, modified, content, error): unknown suffixes have an error."""
    known = [".txt", ".md", ".markdown", *READERS]
    files = spark.read.format("binaryFile").load(glob).select("path", suffix(F.col("path")).alias("suffix"), "length", F.col("modificationTime").alias("modified"), "content")
    return files.withColumn("error", F.when(~F.col("suffix").isin(*known), F.concat(F.lit("Unsupported parser for file type: "), "suffix")))


def _gb18030(content: Column) -> Column:
    @F.pandas_udf("string")
    def decode(parts: pd.Series) -> pd.Series:
        def one(b: bytes | None) -> str | None:
            try:
                return None if b is None else b.decode("gb18030")
            except UnicodeDecodeError:
                return None

        return parts.map(one)

    return decode(content)


def scan_text(files: DataFrame) -> DataFrame:
    """Sections of text files: UTF-8, else GB18030; line ends become \\n; empty files have none.

    Only files that aren't UTF-8 go through Python.
    """
    rows = files.where("suffix = '.txt' and error is null").withColumn("_raw", F.col("content").cast("string")).withColumn("_ok", F.is_valid_utf8("_raw"))
    utf8 = rows.where("_ok").select("path", F.col("_raw").alias("_text"))
    other = rows.where("not _ok").select("path", _gb18030(F.col("content")).alias("_text"))
    return _sections(utf8.unionByName(other))


def scan_markdown(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sections, failures (path, error)) of markdown files: UTF-8 only, one section each."""
    rows = files.where("suffix in ('.md', '.markdown') and error is null").withColumn("_text", F.col("content").cast("string")).withColumn("_ok", F.is_valid_utf8("_text"))
    return _sections(rows.where("_ok").select("path", "_text")), rows.where("not _ok").select("path", F.lit("file is not UTF-8").alias("error"))


def _sections(texts: DataFrame) -> DataFrame:
    body = strip(F.regexp_replace(F.regexp_replace("_text", "^﻿", ""), "\r\n?", "\n"))
    return texts.select("path", F.lit(0).alias("section_pos"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("string").alias("title"), body.alias("content")).where("content <> ''")


def scan_long_text(spark: SparkSession, glob: str, paragraphs: int = 256) -> tuple[DataFrame, DataFrame]:
    """(sections, failures) of UTF-8 text files of any length: each is read by as many tasks as it has splits.

    Files are cut at blank lines by Spark's text source.  A split's pieces are numbered behind the
    counts of the splits before it, so section_pos is the same however a file is split; it takes the
    next ``paragraphs`` pieces, and only these are brought together.  The sections of a file, joined
    by a blank line, are what :func:`scan_text` gives as its one section, but for white space around
    them; a file with \\r\\n line ends has no place to be cut.  Files that aren't UTF-8 are failures.
    """
    split = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("_block")]
    pieces = spark.read.option("lineSep", "\n\n").text(glob).select(*split, F.monotonically_increasing_id().alias("_at"), F.col("value").alias("_text"))
    counts = pieces.groupBy("path", "_block").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"), F.bool_and(F.is_valid_utf8("_text")).alias("_ok"))
    whole = F.bool_and("_ok").over(Window.partitionBy("path"))
    before = F.sum("_n").over(Window.partitionBy("path").orderBy("_block")) - F.col("_n")
    counts = settled(counts.select("path", "_block", "_first", before.alias("_before"), whole.alias("_ok")))  # a row for each split
    placed = pieces.join(counts.where("_ok"), ["path", "_block"]).withColumn("_place", F.col("_before") + F.col("_at") - F.col("_first"))
    gathered = placed.groupBy("path", F.floor(F.col("_place") / paragraphs).cast("int").alias("section_pos")).agg(F.array_sort(F.collect_list(F.struct("_place", "_text"))).alias("_pieces"))
    body = F.array_join(F.transform("_pieces", lambda x: x["_text"]), "\n\n")
    sections = _sections(gathered.select(F.struct("path", "section_pos").alias("path"), body.alias("_text"))).select("path.*", "page", "title", "content")
    return sections, counts.where("not _ok").select("path", F.lit("file is not UTF-8").alias("error")).distinct()


def scan_registered(files: DataFrame) -> DataFrame | None:
    """Sections of the files that registered readers read; null if there is no reader."""
    out = None
    for ending, reader in READERS.items():
        part = files.where((F.col("suffix") == ending) & F.col("error").isNull()).select("path", "content").mapInPandas(reader, SECTION)
        out = part if out is None else out.unionByName(part)
    return out


def scan_sections(spark: SparkSession, glob: str) -> tuple[DataFrame, DataFrame]:
    """(sections, failures) of every file under a glob, each by its reader."""
    files = scan_files(spark, glob)
    markdown, failed = scan_markdown(files)
    sections = scan_text(files).unionByName(markdown)
    extra = scan_registered(files)
    if extra is not None:
        sections = sections.unionByName(extra)
    return sections, files.where("error is not null").select("path", "error").unionByName(failed)


def file_manifest(files: DataFrame) -> DataFrame:
    """(path, suffix, source_type, size_mb, sha256)."""
    return files.select("path", "suffix", source_type_for(F.col("path")).alias("source_type"), F.round(F.col("length") / 1048576, 2).alias("size_mb"), F.sha2("content", 256).alias("sha256"))


def write_report(report: DataFrame, path: str) -> None:
    """Rows as JSON objects with sorted keys."""
    report.select(F.to_json(F.struct(*sorted(report.columns))).alias("value")).write.mode("overwrite").text(path)
