"""Sharding by rendezvous hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import gapless, saved, unit_hash, utf8_bytes


def shard_of(key: Column, weights: list[float]) -> Column:
    """The shard that a key belongs to: the one with the highest weighted score.

    Shard j scores ``-weight / ln(u)`` with u a hash of key and j, so each shard wins keys in
    proportion to its weight and a shard added at the end takes keys only into itself.
    A weight of 0 or less takes none.  A null key is a key like any other.
    """
    key = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    scores = [F.struct((F.lit(-float(w)) / F.log(unit_hash(key, F.lit(j)))).alias("score"), F.lit(-j).alias("shard")) for j, w in enumerate(weights) if w > 0]
    if not scores:
        raise ValueError("no shard has a weight above 0")
    return (-(F.array_max(F.array(*scores))["shard"])).cast("int")


def shard_documents(df: DataFrame, key: str = "doc_id", text: str = "text", weights: list[float] | None = None, grown: list[float] | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 8; slot counts from 0 within the shard; grown_shard is the
    shard under ``grown`` (default: one more shard of weight 1).  Null text: no bytes, checksum 0.
    Null keys share a shard; repeated rows stay and get slots of their own; other columns are not
    read.  An empty table gives none.  Only numbers are shuffled, never texts.
    """
    weights = weights or [1.0] * 24
    grown = grown or [*weights, 1.0]
    body = F.coalesce(F.col(text), F.lit(""))
    rows = saved(df.select(  # numbers only; they are read twice
        F.col(key).alias("doc_id"),
        (utf8_bytes(F.col(text)) + 8).alias("size"),
        F.crc32(F.encode(body, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown).alias("grown_shard"),
    ))
    return gapless(rows, "shard", ["doc_id", "size", "text_crc32"], "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def op2_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards of all documents by key; null text: no bytes, null ids share a shard, repeated rows have slots of their own, no rows of an empty table."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), weights=[1.0] * 24)
