"""Helpers that several training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a temporary one, but only if all runs in one process (tests)."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = tempfile.mkdtemp(prefix="lectern-checkpoint-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(where)
    return where


def shared_table(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, readable after an executor is lost, and of known size where it is joined.

    (A checkpoint keeps the size that was estimated for its plan, which grows with each join of a loop.)
    """
    path = shared_table(df.sparkSession, "saved")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def unit_hash(*parts: Column) -> Column:
    """A stable number in (0, 1) from the parts."""
    return (F.shiftrightunsigned(F.xxhash64(*parts), 11) + F.lit(0.5)) / F.lit(float(2**53))


def gapless(df: DataFrame, group: str, order: list[str], name: str, buckets: int = 256, by: list[str] | None = None, weight: str | None = None) -> DataFrame:
    """Add ``name``: each row's position from 0 within its group, without gaps; with ``weight``, the sum of it over the rows before.

    A group may hold any share of the rows: it is sorted in ``buckets`` parts, dealt by a hash of the
    order columns, or of ``by``, the first of them, whose equal rows so stay together; a running sum
    over the parts says where each begins.
    ``group`` must not be null.  ``df`` is read twice, so it should be cheap or saved.
    """
    bucket = F.pmod(F.xxhash64(*(by or order)), F.lit(buckets)).alias("_bucket")
    each = F.col(weight) if weight else F.lit(1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = (
        df.select(group, bucket, each.alias("_n")).groupBy(group, "_bucket").agg(F.sum("_n").alias("_n"))
        .withColumn("_begin", before(F.col("_n"), Window.partitionBy(group).orderBy("_bucket"))).drop("_n")
    )
    within = before(each, Window.partitionBy(group, "_bucket").orderBy(*order))
    return df.withColumn("_bucket", bucket).withColumn("_within", within).join(begins, [group, "_bucket"]).withColumn(name, (F.col("_begin") + F.col("_within")).cast("long")).drop("_bucket", "_within", "_begin")


def bands_for(threshold: float, recall: float, most: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band can have so that pairs at ``threshold`` share a band with probability ``recall`` within ``most`` hashes."""
    if not 0 < threshold <= 1 or not 0 < recall < 1:
        raise ValueError("threshold must be above 0 and at most 1, recall between 0 and 1")
    best = None
    for rows in range(1, most + 1):
        miss = math.log1p(-(threshold**rows)) if threshold < 1 else -math.inf  # of one band
        bands = max(1, math.ceil(math.log(1 - recall) / miss)) if miss else math.inf
        if bands * rows > most:
            break
        best = (bands, rows)
    if best is None:
        raise ValueError(f"{most} hashes can't reach a recall of {recall} at {threshold}")
    return best


#: Bits of the largest filter that is sent to every executor (32 MB), and of a filter for each key.
FILTER_BITS, BITS_A_KEY = 1 << 28, 32


def maybe_among(df: DataFrame, number: str, numbers: DataFrame, most_bits: int = FILTER_BITS) -> DataFrame:
    """``df`` with _maybe: false only where column ``number`` (a 64-bit hash) isn't among those of ``numbers``, a saved table of one column.

    The numbers go to every executor as a bitmap of BITS_A_KEY bits for each, ``most_bits`` at most,
    so what is sent has a fixed bound.  Beyond a key for every second bit it would tell too little,
    and _maybe is true everywhere: the caller's join decides in any case, the filter only spares it rows.
    """
    n = numbers.count()
    if not n or 2 * n > most_bits:
        return df.withColumn("_maybe", F.lit(n > 0))
    bits = min(most_bits, max(1 << 15, 1 << (BITS_A_KEY * n - 1).bit_length()))
    at = lambda c: F.col(c).bitwiseAND(F.lit(bits - 1))
    page, place = F.shiftright("_at", 15).cast("int"), F.col("_at").bitwiseAND(F.lit((1 << 15) - 1))
    pages = (
        numbers.toDF("_number").select(at("_number").alias("_at")).groupBy(page.alias("_page"))
        .agg(F.bitmap_construct_agg(place).alias("_bits"))  # a page has 2**15 bits
    )
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, place.bitwiseAND(F.lit(7)).cast("int")) == 1
    found = df.withColumn("_at", at(number)).withColumn("_page", page).join(F.broadcast(pages), "_page", "left")
    return found.withColumn("_maybe", F.coalesce(hit, F.lit(False))).select(*df.columns, "_maybe")


def hash_of(key: Column) -> Column:
    """A 64-bit hash of a key of any plain type; null has one too."""
    return F.xxhash64(key.cast("string"))


def text_digest(text: Column) -> Column:
    """Digest of a text; null counts as empty."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def carried(df: DataFrame, key: str, **others: Column) -> DataFrame:
    """``df`` as _row, a struct of all its columns, so that no name of it can clash; _key; _hash, its key's hash; and ``others``."""
    return df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"), df[key].alias("_key"), hash_of(df[key]).alias("_hash"), *[c.alias(n) for n, c in others.items()])


def without_dropped(df: DataFrame, found: DataFrame, key: str, text: str) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns.

    ``found`` has (doc_id, digest, kept) of at least all rows that have a fellow; what it lacks
    stays.  A row is known by its key, null being one like any other, and its text's digest; of
    rows that share both one stays, if any does (that whose other columns hash lowest).  A text is
    shuffled only if its key may be that of a dropped row.
    """
    dropped = saved(
        found.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(F.bool_or("kept").alias("_one"), F.count(F.lit(1)).alias("_n"))
        .where("not _one or _n > 1").select("_id", "_digest", "_one")
    )
    rows = maybe_among(carried(df, key), "_hash", dropped.select(hash_of(F.col("_id"))))
    doubt = rows.where("_maybe").withColumn("_own", text_digest(F.col(f"_row.`{text}`")))
    same = F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_digest"))
    stays = rows.where("not _maybe").select("_row.*").unionByName(doubt.join(dropped, same, "left_anti").select("_row.*"))
    again = dropped.where("_one")
    if again.isEmpty():
        return stays
    others = [F.col(f"_row.`{c}`") for c, kind in df.dtypes if "map<" not in kind and "variant" not in kind]
    one = doubt.join(again, same, "left_semi").groupBy("_key", "_own").agg(F.min_by("_row", F.xxhash64(*others)).alias("_row"))
    return stays.unionByName(one.select("_row.*"))
