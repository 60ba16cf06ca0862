"""The knowledge base: built as one batch, or brought up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import keywords
from lectern.operators.chunking import chunk_sections
from lectern.operators.lineage import settled
from lectern.operators.search import embed
from lectern.operators.tables import build_report, replace_by_document


def build_kb(
    documents: DataFrame, existing: DataFrame | None = None, size: int = 1000, overlap: int = 150, points: int = 10, extractor: Callable[[Column, int], Column] = keywords, embedder: Callable[[Column], Column] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of documents (course_id, document_id, source_type, content, error, ...).

    One row for each document, or for each section if there are also section_pos, page and title;
    ``error`` says why a document couldn't be read, null if it could.  The chunks have knowledge
    points, an embedding and verified false; with ``existing``, those of documents that were built
    replace theirs, while a document that fails keeps what it had.  The report has a row for each
    document: parse_status, chunk_count, error_message.  No document stops the others.
    """
    missing = {"section_pos": F.lit(0), "page": F.lit(None).cast("int"), "title": F.lit(None).cast("string")}
    sections = documents.withColumns({c: v for c, v in missing.items() if c not in documents.columns})
    errors = documents.groupBy("course_id", "document_id").agg(F.max("error").alias("error"))
    read = sections.join(errors.where("error is not null").select("document_id"), "document_id", "left_anti").drop("error")
    chunks = settled(embed(chunk_sections(read, size, overlap, points, extractor).withColumn("verified", F.lit(False)), embedder=embedder))  # both results read them
    report = errors.select("document_id", "course_id").join(build_report(errors, chunks), "document_id")
    return (chunks if existing is None else replace_by_document(existing, chunks)), report


def document_digests(documents: DataFrame, recipe: str = "") -> DataFrame:
    """(course_id, document_id, error, content_digest) of each document.

    The digest is of all that its chunks are made from: the multiset of its sections' digests, summed
    so that no document's sections are gathered, its error, and ``recipe``, which says how chunks are made.
    """
    made_from = [c for c in ("source_type", "section_pos", "page", "title", "content", "error") if c in documents.columns]
    digest = F.sha2(F.to_json(F.struct(*made_from), {"ignoreNullFields": "false"}), 256)
    half = lambda at: F.sum(F.conv(F.substring("_d", at, 15), 16, 10).cast("decimal(38,0)")).cast("string")
    sums = documents.withColumn("_d", digest).groupBy("course_id", "document_id").agg(F.max("error").alias("error"), F.sha2(F.concat_ws(":", F.count(F.lit(1)).cast("string"), half(1), half(16), F.lit(recipe)), 256).alias("content_digest"))
    return sums


def refresh_kb(
    documents: DataFrame, chunks: DataFrame | None = None, report: DataFrame | None = None, size: int = 1000, overlap: int = 150, points: int = 10, extractor: Callable[[Column, int], Column] = keywords, embedder: Callable[[Column], Column] | None = None, recipe: str = ""
) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) of the whole base ``documents``, given those that an earlier call returned.

    The report has content_digest besides the columns of :func:`build_kb`, so it says what each
    document was built from.  Documents that it has with the same digest keep their rows: they are
    neither chunked nor embedded again.  Documents that changed or are new are built, those that are
    gone lose their rows, and one that can't be read any more keeps its chunks.  ``recipe`` names the
    extractor and embedder; another one, or other sizes, builds everything again.
    """
    documents = documents if "error" in documents.columns else documents.withColumn("error", F.lit(None).cast("string"))
    found = settled(document_digests(documents, f"{size}/{overlap}/{points}/{recipe}"))
    todo = found if report is None else settled(found.join(report.select("document_id", "content_digest"), ["document_id", "content_digest"], "left_anti"))
    built, new = build_kb(documents.join(todo.select("document_id"), "document_id", "left_semi").select(*documents.columns), None, size, overlap, points, extractor, embedder)
    new = new.join(todo.select("document_id", "content_digest"), "document_id")
    if chunks is None or report is None:
        return built, new
    same = found.select("document_id").join(todo.select("document_id"), "document_id", "left_anti")
    kept = chunks.join(same.unionByName(todo.where("error is not null").select("document_id")), "document_id", "left_semi")
    return kept.select(*built.columns).unionByName(built), report.join(same, "document_id", "left_semi").select(*new.columns).unionByName(new)
