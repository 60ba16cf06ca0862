"""Operators on the relational tables: admission, rebuilds, patches, cascades, reconciliation, reports."""

from __future__ import annotations

from functools import reduce
from graphlib import TopologicalSorter
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.functions.text import export_name, suffix, token_estimate
from lectern.operators.lineage import settled

# Fixed values.
ALLOWED = (".pdf", ".docx", ".txt", ".md", ".markdown", ".xlsx")
LEGACY = "Legacy .doc files are not supported. Please convert to .docx"


def admit_documents(uploads: DataFrame, courses: DataFrame) -> DataFrame:
    """Uploads (course_id, path) of existing courses with file_name, file_type, accepted, status and error_message; others vanish."""
    kind = suffix(F.col("path"))
    error = F.when(kind == ".doc", F.lit(LEGACY)).when(~kind.isin(*ALLOWED), F.concat(F.lit("Unsupported file type: "), F.coalesce(F.nullif(kind, F.lit("")), F.lit("<none>"))))
    return (
        uploads.join(courses.select("course_id"), "course_id", "left_semi")
        .withColumn("file_name", F.element_at(F.split("path", "[/\\\\]"), -1)).withColumn("file_type", F.ltrim(kind, F.lit(".")))
        .withColumn("error_message", error).withColumn("accepted", F.col("error_message").isNull()).withColumn("status", F.when(F.col("accepted"), F.lit("uploaded")))
    )


def flatten_cells(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, sheet, content) of cells (keys, sheet, row, col, value): values of a row joined by a bar, rows by lines; null cells and rows without others are dropped."""
    kept = cells.where(F.col("value").isNotNull()).withColumn("value", F.regexp_replace(F.col("value").cast("string"), r"(?U)^\s+|\s+\z", ""))
    ordered = lambda *c: F.transform(F.array_sort(F.collect_list(F.struct(*c))), lambda x: x[c[-1]])
    rows = kept.groupBy(*keys, "sheet", "row").agg(F.array_join(ordered("col", "value"), " | ").alias("line"))
    return rows.groupBy(*keys, "sheet").agg(F.array_join(ordered("row", "line"), "\n").alias("content")).withColumn("title", F.col("sheet"))


def paginate_sections(df: DataFrame, pages: str = "pages") -> DataFrame:
    """One row per page that isn't blank, numbered from 1 as in the file."""
    others = [c for c in df.columns if c != pages]
    return df.select(*others, F.posexplode(pages).alias("_at", "_text")).select(*others, (F.col("_at") + 1).alias("page"), F.regexp_replace("_text", r"(?U)^\s+|\s+\z", "").alias("content")).where("content <> ''")


def with_preview(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("content_preview", F.left("content", F.lit(1000)))


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Write chunks by course; the partitions of the courses that occur are replaced.  An empty batch is an error."""
    if chunks.isEmpty():
        raise ValueError("no chunks to write")
    with_preview(chunks).write.partitionBy("course_id").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def replace_by_document(existing: DataFrame, new: DataFrame, key: str = "document_id") -> DataFrame:
    """The existing rows without those of documents that the new ones have, and the new ones."""
    return existing.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def build_report(documents: DataFrame, chunks: DataFrame, key: str = "document_id") -> DataFrame:
    """documents (key, error) with parse_status, chunk_count and error_message; a document without chunks has failed."""
    counts = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    joined = documents.join(counts, key, "left")
    ok = F.col("error").isNull() & (F.coalesce("_n", F.lit(0)) > 0)
    return joined.select(
        key, F.when(ok, "built").otherwise("failed").alias("parse_status"), F.when(ok, F.col("_n")).otherwise(0).alias("chunk_count"),
        F.when(~ok, F.coalesce("error", F.lit("No text chunks were extracted from this document"))).alias("error_message"),
    )


def corpus_card(files: DataFrame) -> DataFrame:
    """Per suffix of files (suffix, size, digest): how many, how many distinct, MB."""
    return files.groupBy("suffix").agg(F.count(F.lit(1)).alias("files"), F.countDistinct("digest").alias("distinct_files"), F.round(F.sum("size") / 1048576, 2).alias("size_mb"))


def export_ledger(artifacts: DataFrame, roles: tuple[tuple[str, str], ...]) -> DataFrame:
    """A row for each artifact (artifact_id, course_name, topic) and role with its type and readable name."""
    made = [F.struct(F.lit(r).alias("role"), F.lit(x).alias("file_type"), export_name(F.col("course_name"), F.col("topic"), F.lit(r), F.col("artifact_id").cast("string"), x).alias("file_name")) for r, x in roles]
    return artifacts.withColumn("_r", F.explode(F.array(*made))).select("artifact_id", "_r.*").withColumn("file_path", F.concat(F.lit("exports/"), "file_name"))


def chunk_metadata(df: DataFrame) -> DataFrame:
    """Add metadata: a map of what a chunk says of itself; empty chapter, section and title and null page are left out, page 0 stays."""
    pairs = [("chapter", F.nullif("chapter", F.lit(""))), ("section", F.nullif("section", F.lit(""))), ("title", F.nullif("title", F.lit(""))), ("page", F.col("page").cast("string")), ("course_id", F.col("course_id")), ("document_id", F.col("document_id").cast("string")), ("source_type", F.col("source_type"))]
    return df.withColumn("metadata", F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k, _ in pairs]), F.array(*[v for _, v in pairs])), lambda _, v: v.isNotNull()))


def verified_metadata(given: Column, course: Column, collection: Column) -> Column:
    """Defaults for verified text, overridden by the given map; nulls are dropped."""
    defaults = F.create_map(F.lit("course_id"), course, F.lit("verified"), F.lit("true"), F.lit("collection"), collection)
    mine = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k))
    return F.map_filter(F.map_concat(mine, given), lambda _, v: v.isNotNull())


def patch_rows(base: DataFrame, patches: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """Rows with the fields that a patch sets (its set_fields names them; null overwrites too); a patched row's updated_at is the patch's."""
    p = patches.select(F.col(key), "set_fields", F.col("updated_at").alias("_at"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = base.join(p, key, "left")
    for f in fields:
        joined = joined.withColumn(f, F.when(F.array_contains("set_fields", f), F.col(f"_{f}")).otherwise(F.col(f)))
    return joined.withColumn("updated_at", F.coalesce("_at", "updated_at")).select(*base.columns)


def cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], ids: DataFrame, key: str) -> dict[str, DataFrame]:
    """The tables without the parents in ``ids`` and without children of theirs; each child table comes with its parent column."""
    gone = ids.select(F.col(key).alias("_gone")).distinct()
    out = {"": parents.join(gone, parents[key] == F.col("_gone"), "left_anti")}
    return out | {name: df.join(gone, df[c] == F.col("_gone"), "left_anti") for name, (df, c) in children.items()}


def cascade_all(tables: dict[str, tuple[DataFrame, str]], edges: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables (each with its key column) after the rows in ``gone`` (key sets by table) are deleted.

    Edges are foreign keys (parent, child, the child's column, "delete" or "null"): rows of the child
    that name a deleted row are deleted too, with all that hangs on them, or keep a null.  Tables are
    taken parents first, so each one's keys are collected once, in a saved set that all its children
    use.  Deletes in a circle are refused.
    """
    parents = {name: [] for name in tables}
    for parent, child, column, action in edges:
        if action not in ("delete", "null"):
            raise ValueError("an edge deletes or nulls")
        parents[child].append((parent, column, action))
    order = list(TopologicalSorter({name: [p for p, _, action in found if action == "delete"] for name, found in parents.items()}).static_order())
    keys: dict[str, DataFrame] = {}
    for name in order:
        df, key = tables[name]
        lost = [ids.select(F.col(ids.columns[0]).alias("_gone")) for table, ids in gone.items() if table == name]
        lost += [df.join(keys[p], df[column] == F.col("_gone"), "left_semi").select(F.col(key).alias("_gone")) for p, column, action in parents[name] if action == "delete" and p in keys]
        if lost:
            keys[name] = settled(reduce(DataFrame.unionByName, lost).distinct())
    out = {}
    for name, (df, key) in tables.items():
        out[name] = df.join(keys[name], df[key] == F.col("_gone"), "left_anti") if name in keys else df
        for p, column, action in parents[name]:
            if action == "null" and p in keys:
                out[name] = set_null(out[name], column, keys[p], "_gone")
    return out


def set_null(df: DataFrame, column: str, gone: DataFrame, key: str) -> DataFrame:
    """Rows with ``column`` null where it names a row that is gone."""
    g = gone.select(F.col(key).alias("_gone")).distinct()
    return df.join(g, df[column] == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def by_id(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows that the ids name, and the ids that name none."""
    return df.join(ids.select(key).distinct(), key, "left_semi"), ids.join(df.select(key), key, "left_anti")


def newest_first(df: DataFrame, at: str, key: str) -> DataFrame:
    return df.orderBy(F.col(at).desc(), F.col(key))


def with_rank(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """Add ``name``: each row's place from 1 in ``order`` over the whole table.

    Range partitions are sorted and number their own rows, behind the counts of those before them;
    only a number for each partition meets in one place.  Rows that tie are in any order.
    """
    rows = settled(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    counts = sorted(map(tuple, rows.groupBy(part.alias("_part")).agg(F.count(F.lit(1))).collect()))  # one row for each partition
    before = list(accumulate((n for _, n in counts), initial=0))
    begins = df.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(counts, before, strict=False)], "_part bigint, _before bigint")
    placed = rows.withColumn("_part", part).join(F.broadcast(begins), "_part")
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_before", "_at")


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("chunk_count"))


def chunk_size_stats(chunks: DataFrame, course: str = "course_id", text: str = "content") -> DataFrame:
    """Average characters and estimated tokens of the chunks that aren't blank, by course."""
    filled = chunks.where(F.trim(F.col(text)) != "")
    return filled.groupBy(course).agg(F.round(F.avg(F.length(text)), 2).alias("avg_chars"), F.round(F.avg(token_estimate(F.col(text))), 2).alias("avg_tokens"))


def vector_stats(collections: DataFrame, segments: DataFrame, entries: DataFrame) -> DataFrame:
    """Entries and dimension of each collection, over its metadata segments; 0 if it has none."""
    meta = segments.where("scope = 'METADATA'").select("segment_id", "collection_id")
    n = meta.join(entries, "segment_id").groupBy("collection_id").agg(F.count(F.lit(1)).alias("_n"))
    return collections.join(n, "collection_id", "left").select("collection_id", "dimension", F.coalesce("_n", F.lit(0)).alias("entry_count"))


def eav_to_rows(entries: DataFrame, metadata: DataFrame, key: str, value: str, wanted: str | None = None) -> DataFrame:
    """(entry_id, text) of the entries whose metadata has ``wanted``, or anything if it is None, under ``key``; the text is under ``value``."""
    pick = lambda k, name: metadata.where(F.col("key") == k).select("entry_id", F.col("string_value").alias(name))
    named = pick(key, "_k") if wanted is None else pick(key, "_k").where(F.col("_k") == wanted)
    return entries.select("entry_id").join(named, "entry_id").join(pick(value, "text"), "entry_id").select("entry_id", "text")


def count_match(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of two tables by key, side by side, and whether they are as many."""
    x, y = a.groupBy(key).agg(F.count(F.lit(1)).alias("left_count")), b.groupBy(key).agg(F.count(F.lit(1)).alias("right_count"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return x.join(y, key, "full_outer").select(key, zero("left_count"), zero("right_count")).withColumn("matches", F.col("left_count") == F.col("right_count"))


def read_tasks(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """The tasks of the ids, oldest first, with their latency."""
    from lectern.functions.text import latency_ms

    return tasks.join(ids.select("task_id").distinct(), "task_id", "left_semi").withColumn("latency_ms", latency_ms(F.col("started_at"), F.col("completed_at"))).orderBy("created_at", "task_id")


def artifact_status(passed: Column, kind: Column) -> Column:
    return F.when(kind == "exam", F.when(passed, "questions_generated").otherwise("needs_review")).otherwise(F.when(passed, "draft").otherwise("needs_review"))


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """The latest review of each target with its write-back status."""
    newest = F.row_number().over(Window.partitionBy("target_type", "target_id").orderBy(F.col("created_at").desc(), F.col("review_id").desc()))
    return reviews.withColumn("_n", newest).where("_n = 1").drop("_n").withColumn("write_back_status", F.when(F.col("review_status") == "approved", "pending").otherwise("not_written"))


def confirmed_only(blueprints: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Confirmed blueprints, and the others with an error."""
    ok = F.coalesce(F.col("status") == "confirmed", F.lit(False))
    return blueprints.where(ok), blueprints.where(~ok).withColumn("error", F.lit("Exam blueprint must be confirmed first"))


def fallback_violations(tasks: DataFrame, allowed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tasks with fallbacks, and one row with the run's status."""
    bad = tasks.where(F.coalesce("fallback_count", F.lit(0)) > 0)
    status = bad.agg(F.when((F.count(F.lit(1)) > 0) & F.lit(not allowed), "completed_with_fallback_violations").otherwise("completed").alias("run_status"))
    return bad, status


def resolve_targets(reviews: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Reviews with the course of what they review: targets maps each target type to (target_id, course_id)."""
    tagged = None
    for kind, df in targets.items():
        part = df.select(F.lit(kind).alias("target_type"), F.col("target_id").cast("string").alias("target_id"), F.col("course_id").alias("target_course"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return reviews.join(tagged, ["target_type", "target_id"], "left").withColumn("found", F.col("target_course").isNotNull())
