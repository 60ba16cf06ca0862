"""The incremental build and the stream of the knowledge base against the whole build."""

import pytest
from pyspark.sql import functions as F

from lectern.operators.kb import build_kb, refresh_kb
from lectern.operators.search import embed
from lectern.streaming import jobs as J

DOCS = "course_id string, document_id string, source_type string, content string, version int, error string"
ROWS = ["document_id", "chunk_pos", "content", "embedding", "knowledge_points"]
REPORT = ["document_id", "course_id", "parse_status", "chunk_count", "error_message"]


def plain(df, columns):
    return sorted((tuple(map(str, r)) for r in df.select(columns).collect()))


def never(text):
    """An embedder that fails if it is asked for a vector."""
    return F.raise_error(F.lit("embedded again")).cast("array<double>")


def test_a_second_build_of_the_same_encodes_nothing(spark):
    docs = J.as_sections(spark.createDataFrame([("c", "a", "t", "one\n\ntwo", 1, None), ("c", "b", "t", None, 1, "broken"), ("c", "d", "t", "", 1, None)], DOCS))
    chunks, report = (df.checkpoint() for df in refresh_kb(docs))
    again, second = refresh_kb(docs, chunks, report, embedder=never)
    assert plain(again, ROWS) == plain(chunks, ROWS) and plain(second, REPORT) == plain(report, REPORT) == plain(build_kb(docs)[1], REPORT)
    with pytest.raises(Exception, match="embedded again"):
        refresh_kb(docs.withColumn("content", F.lit("three")), chunks, report, embedder=never)[0].collect()


def test_changed_added_removed_and_broken_documents(spark):
    before = J.as_sections(spark.createDataFrame([("c", "same", "t", "text one", 1, None), ("c", "changed", "t", "old", 1, None), ("c", "gone", "t", "x", 1, None), ("c", "breaks", "t", "kept", 1, None), ("c", "emptied", "t", "y", 1, None)], DOCS))
    now = J.as_sections(spark.createDataFrame([("c", "same", "t", "text one", 2, None), ("c", "changed", "t", "new", 2, None), ("c", "added", "t", "z", 2, None), ("c", "breaks", "t", None, 2, "broken"), ("c", "emptied", "t", " ", 2, None)], DOCS))
    chunks, report = refresh_kb(now, *(df.checkpoint() for df in refresh_kb(before)))
    want, status = build_kb(now)
    assert {(r.document_id, r.content, r.version) for r in chunks.collect()} == {(r.document_id, r.content, r.version) for r in want.where("document_id <> 'same'").collect()} | {("breaks", "kept", 1), ("same", "text one", 1)}
    assert plain(report, REPORT) == plain(status, REPORT)
    assert refresh_kb(now.limit(0), chunks, report)[0].count() == 0


BATCHES = [
    [("c", "a", "t", "one", 1, None), ("c", "b", "t", "first text", 1, None), ("c", "e", "t", None, 1, "broken"), ("c", "f", "t", "  ", 1, None)],
    [("c", "a", "t", "two", 2, None), ("c", "b", "t", None, 2, "broken"), ("c", "g", "t", "more", 1, None), ("c", "a", "t", "older", 1, None)],
    [("c", "e", "t", "mended", 2, None), ("c", "a", "t", "too old", 1, None), ("c", "g", "t", "more", 2, None)],
]


@pytest.mark.parametrize("dies", [None, (1, "stage_batch"), (1, "put chunks"), (2, "put report"), (2, "put chunks")])
def test_stream_is_the_build_wherever_it_dies(spark, tmp_path, monkeypatch, dies):
    table, put, stage = str(tmp_path / "table"), J.put_in_place, J.stage_batch
    for i, rows in enumerate(BATCHES):
        spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

        def run():
            J.stream_build_kb(spark.readStream.schema(DOCS).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp"), buckets=2).awaitTermination()

        def dying_put(session, staged, place):
            if dies[1] == f"put {place.rsplit('/')[-1]}":
                raise RuntimeError("died")
            put(session, staged, place)
            if dies[1] == "put report" and place.endswith("chunks"):
                raise RuntimeError("died")

        def dying_stage(*args):
            stage(*args)
            raise RuntimeError("died")

        if dies and dies[0] == i:
            monkeypatch.setattr(J, "put_in_place", dying_put)
            if dies[1] == "stage_batch":
                monkeypatch.setattr(J, "stage_batch", dying_stage)
            with pytest.raises(Exception, match="died"):
                run()
            monkeypatch.undo()
        run()
    last = spark.createDataFrame([max((r for part in BATCHES for r in part if r[1] == d), key=lambda r: r[4]) for d in "abefg"], DOCS)
    chunks, report = build_kb(J.as_sections(last))
    kept = embed(spark.createDataFrame([("b", 0, "first text")], "document_id string, chunk_pos int, content string"))  # it can't be read any more
    got = J.read_kb(spark, table)
    assert plain(got, ROWS[:4]) == sorted(plain(chunks, ROWS[:4]) + plain(kept, ROWS[:4]))
    assert plain(J.read_report(spark, table), REPORT) == plain(report, REPORT)
    assert {r.document_id: r.version for r in J.read_report(spark, table).collect()} == {"a": 2, "b": 2, "e": 2, "f": 1, "g": 2}
    assert not list((tmp_path / "cp" / "staged").glob("*"))
