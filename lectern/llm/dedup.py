"""Exact deduplication by progressive refinement: length, then a hash of the beginning, then a hash of all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import maybe_among, saved, text_digest, without_dropped

PREFIX_CHARS = 256


def _refined(df: DataFrame, key: str, text: str, prefix_chars: int, digests: bool) -> tuple[DataFrame, DataFrame]:
    """(rows, groups): doc_id, _row and digest of each row, and _size and _keep of each digest that several rows have.

    Without ``digests`` a row has one only if another has its length and beginning (or seems to, by
    the filter that is sent for them).  Texts are read and hashed where they lie: of a row, only key
    and hashes are shuffled.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = df.select(F.col(key).alias("doc_id"), F.octet_length(body).alias("_length"), F.xxhash64(F.octet_length(body), F.left(body, F.lit(prefix_chars))).alias("_begins"), (text_digest(F.col(text)) if digests else body).alias("_text"))
    if digests:
        rows = saved(rows)
    # A length or a beginning is one row by the time that it is shuffled, however many rows share it.
    counted = rows.groupBy("_length", "_begins").agg(F.count(F.lit(1)).alias("_n"))
    lengths = counted.groupBy("_length").agg(F.sum("_n").alias("_n")).where("_n > 1").select("_length")
    begins = saved(counted.where("_n > 1").join(lengths, "_length", "left_semi").select("_begins"))
    hashed = (
        maybe_among(rows, "_begins", begins)
        .select("doc_id", F.monotonically_increasing_id().alias("_row"), F.col("_maybe").alias("_candidate"), *([F.col("_text").alias("digest")] if digests else [F.when(F.col("_maybe"), F.sha2("_text", 256)).alias("digest")]))
    )
    hashed = saved(hashed)
    # Saved, so that a join to it deals both sides out itself and can split a digest that many rows share.
    groups = saved(
        hashed.where("_candidate").groupBy("digest")
        .agg(F.count(F.lit(1)).alias("_size"), F.max(F.struct("doc_id", "_row")).alias("_keep"))
        .where("_size > 1")
    )
    return hashed, groups


def exact_copies(df: DataFrame, key: str = "doc_id", text: str = "text", prefix_chars: int = PREFIX_CHARS, digests: bool = False) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, digest (null where nothing is like the row, unless ``digests``).

    Texts are equal when identical; null counts as empty.  Of equal texts the row with the largest
    key stays (null keys lose to any other; of rows that repeat both key and text one stays).
    Whole texts are hashed only where another row has the same length and the same beginning, or
    where ``digests`` asks for each; no text is shuffled.  Other columns are not read.  An empty
    table gives none.
    """
    hashed, groups = _refined(df, key, text, prefix_chars, digests)
    alone = hashed.where("not _candidate").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    others = hashed.where("_candidate").join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("_size").isNull(), F.col("doc_id")).otherwise(F.col("_keep.doc_id")).alias("keep_id"),
        F.coalesce("_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("_keep._row") == F.col("_row"), F.lit(True)).alias("kept"),
        "digest",
    )
    return alone.unionByName(others)


def without_copies(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` that :func:`exact_copies` keeps, with all their columns, whatever their names.

    Of rows that share key and text, that whose other columns hash lowest stays.  Only texts whose
    key may be that of a dropped row are shuffled.  An empty table gives none.
    """
    found = exact_copies(df, key, text)
    return without_dropped(df, found.where("group_size > 1").select("doc_id", "digest", "kept"), key, text)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the row that stays of their copies; null text: empty, of repeated rows one stays, no rows of an empty table."""
    return exact_copies(spark.read.parquet(f"{sf_dir}/documents.parquet"), digests=True).select("doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP9_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
