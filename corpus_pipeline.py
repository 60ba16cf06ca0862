"""The corpus pipeline: quality rules, exact dedup, near-duplicates, mixing, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import shared_table
from lectern.llm.dedup import without_copies
from lectern.llm.mix import mixed_rows
from lectern.llm.neardup import one_of_each
from lectern.llm.pack import pack_files
from lectern.llm.repetition import without_repetition
from lectern.operators.lineage import spread

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep.  Null and empty texts go; repeated rows are judged each; an empty table stays empty."""
    return without_repetition(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: that with the largest id.  Null counts as empty; of rows that repeat id and text one stays."""
    return without_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that near-duplicate links hold together: that with the least id.  Texts without words link to nothing and stay; of rows that repeat id and text one stays."""
    return one_of_each(docs)


#: Shards of the mix.
SHARDS = 16


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source's weight takes it, shard by shard, shuffled within a shard.

    A shard is written in files of its own, which are ranges of its shuffled order.  Null is a source
    of its own; a text without words goes with its block; repeated rows are drawn each.
    """
    files = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // SHARDS)
    part = F.shiftright(F.shiftrightunsigned("place", 40) * files, 24)  # the place's highest bits
    dealt = mixed_rows(docs, shards=SHARDS).withColumn("_file", (F.col("shard") * files + part).cast("int"))
    return dealt.repartitionById(SHARDS * files, "_file").sortWithinPartitions("_file", "place").select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix, each in its training sequence.

    Each file, which is of one shard, is packed in its order, and no sequence has two copies of a
    piece.  Null counts as empty, which is one token; repeated rows are packed each.  A table that
    isn't read from files is packed as a whole.
    """
    return pack_files(docs)


STAGES: list[tuple[str, Stage]] = [("quality rules", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("mixing", mixed), ("packing", packed)]

#: Suffix arrays, MinHash, hypergeometric draws and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each one's rows are written to the shared folder and read again by the next."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for i, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES):
            docs.write.parquet(path := shared_table(spark, "pipeline"))
            docs = spark.read.parquet(path)
    return docs
