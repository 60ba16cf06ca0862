"""Sections to overlapping chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import heading, keywords, paragraphs, strip
from lectern.functions.vectors import let

#: Paragraphs that are folded into one array of chunks.
PIECE = 1024
_CHUNK = "struct<content:string,chapter:string,section:string,title:string>"


def chunk_array(content: Column, title: Column, size: int = 1000, overlap: int = 150) -> Column:
    """Array of (content, chapter, section, title) chunks of one section.

    A fold over the paragraphs: a buffer that would pass ``size`` becomes a chunk under the headings
    seen so far and leaves its last ``overlap`` characters; then the paragraph is tried as a heading
    and joined to the buffer.
    """
    none = F.lit(None).cast("string")
    state = lambda b, t, c, s, o: F.struct(b.alias("b"), t.alias("t"), c.alias("c"), s.alias("s"), o.alias("o"))
    chunk = lambda a: F.array(F.struct(a["b"].alias("content"), a["c"].alias("chapter"), a["s"].alias("section"), a["t"].alias("title")))

    def step(a: Column, x: Column) -> Column:
        p, token = x["p"], x["token"]
        full = (F.length(a["b"]) + F.length(p) + 2 > size) & (a["b"] != "")
        left = F.when(full, F.right(a["b"], F.lit(overlap)) if overlap else F.lit("")).otherwise(a["b"])
        is_chapter = token.startswith("第") & (F.contains(token, F.lit("章")) | F.contains(token, F.lit("篇")))
        return state(
            strip(F.concat(left, F.lit("\n\n"), p)),
            F.when(token != "", F.left(p, F.lit(512))).otherwise(a["t"]),
            F.when((token != "") & is_chapter, F.left(p, F.lit(255))).otherwise(a["c"]),
            F.when(token == "", a["s"]).when(is_chapter, none).otherwise(F.left(p, F.lit(255))),
            F.when(full, F.concat(a["o"], chunk(a))).otherwise(a["o"]),
        )

    empty = F.array().cast(f"array<{_CHUNK}>")
    found = F.transform(F.coalesce(paragraphs(content, size, overlap), F.array().cast("array<string>")), lambda p: F.struct(p.alias("p"), heading(p).alias("token")))
    # Appending copies the array, so pieces of the paragraphs are folded each into an array of its own, and those are joined at the end.
    pieces = let(found, lambda xs: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(xs) - 1) / PIECE)).cast("int")), lambda i: F.slice(xs, i * PIECE + 1, F.lit(PIECE))))
    whole = F.aggregate(
        pieces, state(F.lit(""), title.cast("string"), none, none, F.array().cast(f"array<array<{_CHUNK}>>")),
        lambda a, piece: F.aggregate(piece, state(a["b"], a["t"], a["c"], a["s"], empty), step, lambda x: state(x["b"], x["t"], x["c"], x["s"], F.concat(a["o"], F.array(x["o"])))),
        lambda a: F.concat(a["o"], F.array(F.when(a["b"] != "", chunk(a)).otherwise(empty))),
    )
    return F.flatten(whole)


def chunk_sections(df: DataFrame, size: int = 1000, overlap: int = 150, points: int = 10, extractor: Callable[[Column, int], Column] = keywords) -> DataFrame:
    """Chunks of sections (course_id, document_id, source_type, section_pos, content, page, title, ...).

    Adds chunk_pos, chapter, section, title, content, knowledge_points and chunk_id, a digest of
    the chunk's place, so that a task that runs again gives the same ids.  ``extractor`` makes at most
    ``points`` knowledge points of a chunk's content.  Other columns pass through.
    """
    others = [c for c in df.columns if c not in ("content", "title")]
    chunks = df.select(*others, F.posexplode(chunk_array(F.col("content"), F.col("title"), size, overlap)).alias("chunk_pos", "_c"))
    return chunks.select(
        *others, "chunk_pos",
        F.sha2(F.concat_ws(":", F.col("document_id").cast("string"), F.col("section_pos").cast("string"), F.col("chunk_pos").cast("string")), 256).alias("chunk_id"),
        "_c.chapter", "_c.section", "_c.title", "_c.content", extractor(F.col("_c.content"), points).alias("knowledge_points"),
    )


def chunk_documents(documents: DataFrame, size: int = 1000, overlap: int = 150) -> DataFrame:
    """Chunks of documents that are one section each (course_id, document_id, source_type, content)."""
    return chunk_sections(documents.withColumn("section_pos", F.lit(0)).withColumn("page", F.lit(None).cast("int")).withColumn("title", F.lit(None).cast("string")), size, overlap)
