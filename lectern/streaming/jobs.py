"""Structured Streaming forms of the knowledge base build and the ledgers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.window import Window

from lectern.operators.chunking import chunk_sections
from lectern.operators.kb import build_kb, document_digests
from lectern.operators.ledger import Ledger
from lectern.operators.lineage import settled

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def latest_documents(documents: DataFrame) -> DataFrame:
    """The last version of each document by (version, content)."""
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("version").desc(), F.col("content").desc()))
    return documents.withColumn("_n", last).where("_n = 1").drop("_n")


def build_chunks(documents: DataFrame) -> DataFrame:
    """Batch form: chunks of the last version of each document."""
    return chunk_sections(as_sections(latest_documents(documents)))


def as_sections(documents: DataFrame) -> DataFrame:
    """Documents as one section each."""
    return documents.withColumn("section_pos", F.lit(0)).withColumn("page", F.lit(None).cast("int")).withColumn("title", F.lit(None).cast("string"))


def read_kb(spark: SparkSession, table: str) -> DataFrame:
    """The chunks that :func:`stream_build_kb` keeps in the folder ``table``."""
    return spark.read.parquet(f"{table}/chunks").where("chunk_id is not null").drop("bucket")


def read_report(spark: SparkSession, table: str) -> DataFrame:
    """The report that :func:`stream_build_kb` keeps in the folder ``table``: a row for each document."""
    return spark.read.parquet(f"{table}/report").drop("bucket")


def _stored(spark: SparkSession, table: str, like: DataFrame, buckets: list[int]) -> DataFrame:
    """These buckets of a table; nothing if it isn't there yet."""
    try:
        return spark.read.schema(like.schema).parquet(table).where(F.col("bucket").isin(buckets))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return like.limit(0)


def _path(spark: SparkSession, name: str):
    """(file system, path) of a folder that driver and executors share."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_in_place(spark: SparkSession, staged: str, table: str) -> None:
    """The buckets of a staged table in place of those of ``table``; again and again it gives the same."""
    spark.read.parquet(staged).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(table)


def stage_batch(documents: DataFrame, table: str, staged: str, buckets: int, embedder: Callable[[Column], Column] | None = None) -> bool:
    """Write what a batch makes of the buckets that it touches beside the tables; false if it touches none.

    Of documents (course_id, document_id, source_type, content, version, and error if it can't be
    read) the last version counts, if it is not older than the one in the report.  Those whose content
    has the digest that the report has keep their chunks, with the version that made them.
    """
    spark = documents.sparkSession
    bucket = F.pmod(F.xxhash64("document_id"), F.lit(buckets)).cast("int")
    rows = documents if "error" in documents.columns else documents.withColumn("error", F.lit(None).cast("string"))
    last = settled(latest_documents(rows).withColumn("bucket", bucket))
    touched = [r["bucket"] for r in last.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
    if not touched:
        return False
    digests = document_digests(last).select("document_id", "content_digest")
    empty = F.lit(None).cast
    shape = last.limit(0).select("document_id", "course_id", empty("string").alias("parse_status"), empty("bigint").alias("chunk_count"), empty("string").alias("error_message"), "version", empty("string").alias("content_digest"), "bucket")
    report = _stored(spark, f"{table}/report", shape, touched)
    known = report.select("document_id", F.col("version").alias("_v"), F.col("content_digest").alias("_d"))
    fresh = settled(last.join(digests, "document_id").join(known, "document_id", "left").where("_v is null or version >= _v"))
    todo = fresh.where("_d is null or _d <> content_digest")
    sections = as_sections(todo.select(*last.columns))
    built, made = build_kb(sections, embedder=embedder)
    read = todo.where("error is null")
    emptied = read.join(built.select("document_id").distinct(), "document_id", "left_anti")
    said = {"course_id", "document_id", "source_type", "version", "bucket"}
    emptied = emptied.select(*[F.col(c) if c in said else F.lit(None).cast(k).alias(c) for c, k in built.dtypes])
    old = _stored(spark, f"{table}/chunks", built, touched).join(read.select("document_id"), "document_id", "left_anti")
    old.select(*built.columns).unionByName(built).unionByName(emptied).write.mode("overwrite").parquet(f"{staged}/chunks")
    new = made.select("document_id", "parse_status", F.col("chunk_count").cast("long").alias("chunk_count"), "error_message")
    same = report.select("document_id", "parse_status", "chunk_count", "error_message").join(fresh.where("_d = content_digest").select("document_id"), "document_id", "left_semi")
    now = new.unionByName(same).join(fresh.select("document_id", "course_id", "version", "content_digest", "bucket"), "document_id")
    report.join(fresh.select("document_id"), "document_id", "left_anti").unionByName(now.select(*shape.columns)).write.mode("overwrite").parquet(f"{staged}/report")
    return True


def stream_build_kb(stream: DataFrame, table: str, checkpoint: str, buckets: int = 64, available_now: bool = True, embedder: Callable[[Column], Column] | None = None) -> StreamingQuery:
    """Keep the folder ``table`` at what ``build_kb`` makes of the last version of each document: chunks with vectors (:func:`read_kb`) and a report with a row for each document, failures too (:func:`read_report`).

    A batch touches only the buckets that its documents fall in.  Their rows of both tables are
    written beside the old ones; when both are whole, a marker says so, and they take the place of
    the old ones by dynamic partition overwrite.  A batch that is replayed without a marker starts
    anew from tables that it hasn't touched, and one with a marker puts the same rows in place again:
    so both tables come to the same state wherever it died.  Only between the two overwrites a
    reader can see chunks that are newer than the report.

    Documents whose content didn't change are not chunked again.  One that can't be read keeps its
    chunks; one that was emptied loses them, and leaves a row without chunk_id in the table.
    """

    def upsert(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        files, folder = _path(spark, staged := f"{checkpoint}/staged/{batch_id}")
        _, marker = _path(spark, f"{staged}/_whole")
        if not files.exists(marker):
            if not stage_batch(batch, table, staged, buckets, embedder):
                return
            files.create(marker, True).close()
        for name in ("chunks", "report"):
            put_in_place(spark, f"{staged}/{name}", f"{table}/{name}")
        files.delete(folder, True)

    writer = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{checkpoint}/stream")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


class RequestLedger(StatefulProcessor):
    """Decides the requests of one (operation, key) in order of time, as the batch form does, with the ledger row as state."""

    OUT = "operation string, idempotency_key string, request_id bigint, decision string, attempt int"
    STATE = "hash string, outcome string, done_us bigint, lease_us bigint, attempt int"

    def __init__(self, lease_seconds: int = 300):
        self.lease_us = lease_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", self.STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["at_us", "request_id"])
        ledger = Ledger(self.lease_us, *(self.state.get() if self.state.exists() else ()))
        out = []
        for r in batch.itertuples(index=False):
            decision = ledger.decide(r.request_hash, int(r.at_us), r.outcome, None if pd.isna(r.done_us) else int(r.done_us))
            out.append((key[0], key[1], int(r.request_id), decision, ledger.attempt))
        self.state.update(ledger.row())
        yield pd.DataFrame(out, columns=["operation", "idempotency_key", "request_id", "decision", "attempt"])

    def close(self) -> None:
        pass


def stream_requests(requests: DataFrame, lease_seconds: int = 300) -> DataFrame:
    """Streaming form of the request ledger for requests with a key.

    Rows of a batch are decided in order of time, batches in order of arrival; a request that comes
    in a later batch than a younger one of its key is decided against the ledger as it then is.
    The session needs the RocksDB state store (STATE_STORE).
    """
    keyed = requests.where("idempotency_key is not null").select("operation", "idempotency_key", "request_id", "request_hash", "outcome", F.unix_micros(F.col("at")).alias("at_us"), F.unix_micros(F.col("done_at")).alias("done_us"))
    return keyed.groupBy("operation", "idempotency_key").transformWithStateInPandas(RequestLedger(lease_seconds), outputStructType=RequestLedger.OUT, outputMode="append", timeMode="none")


def stream_task_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events (at, kind) counted by event-time window and kind; what is later than the watermark is left out of a closed window."""
    return events.withWatermark("at", late).groupBy(F.window("at", window), "kind").agg(F.count(F.lit(1)).alias("events")).select(F.col("window.start").alias("window_start"), "kind", "events")


def stream_first_requests(requests: DataFrame, late: str = "2 hours") -> DataFrame:
    """The first request of each (operation, key) that the stream sees within the watermark."""
    return requests.withWatermark("at", late).dropDuplicatesWithinWatermark(["operation", "idempotency_key"])


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
