"""Readers, writers and sinks on files made here."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.operators.chunking import chunk_documents, chunk_sections
from lectern.operators.tables import flatten_cells, write_chunks
from lectern.sources import files as S


def test_files_are_routed_and_decoded(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("state space search\r\nsecond line  ")
    (tmp_path / "b.txt").write_bytes("搜索算法".encode("gb18030"))
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "c.md").write_text("# Chapter 1\n\nAI basics")
    (tmp_path / "bad.md").write_bytes(b"\xff\xfe\xfd")
    (tmp_path / "d.pdf").write_bytes(b"%PDF")
    sections, failed = S.scan_sections(spark, str(tmp_path / "*"))
    got = {r.path.rsplit("/", 1)[1]: r.content for r in sections.collect()}
    assert got == {"a.TXT": "state space search\nsecond line", "b.txt": "搜索算法", "c.md": "# Chapter 1\n\nAI basics"}
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in failed.collect()}
    assert errors["d.pdf"] == "Unsupported parser for file type: .pdf" and "UTF-8" in errors["bad.md"]
    # Spark leaves files of no bytes out of a listing.
    manifest = S.file_manifest(S.scan_files(spark, str(tmp_path / "*"))).collect()
    assert len(manifest) == 5 and all(len(r.sha256) == 64 for r in manifest)


@pytest.mark.parametrize("split", ["128m", "3000", "257"])
def test_long_text_over_several_splits(spark, tmp_path, split):
    long = "\n\n".join(f"paragraph {i} é {'word ' * (i % 40)}" + "\n" * (i % 3) for i in range(400))
    for name, text in (("long.txt", "\ufeff" + long), ("short.txt", "one\nline"), ("blank.txt", "\n\n \n\n"), ("crlf.txt", "a\r\n\r\nb")):
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "bad.txt").write_bytes(b"fine\n\n" * 300 + b"\xff\xfe")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        found, failed = S.scan_long_text(spark, str(tmp_path / "*.txt"), 16)
        rows = sorted((r.path.rsplit("/", 1)[1], r.section_pos, r.content) for r in found.collect())
        assert [r.path.rsplit("/", 1)[1] for r in failed.collect()] == ["bad.txt"]
        parts = found.select("path").where("path like '%long.txt'").count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    whole = {r.path.rsplit("/", 1)[1]: r.content for r in S.scan_sections(spark, str(tmp_path / "*.txt"))[0].collect()}
    n = -(-len(long.split("\n\n")) // 16)
    assert parts == n > 20 and [r[1] for r in rows if r[0] == "long.txt"] == list(range(n))
    tidy = lambda text: [p.strip() for p in text.split("\n\n") if p.strip()]
    for name in ("long.txt", "short.txt", "crlf.txt"):
        assert tidy("\n\n".join(c for n, _, c in rows if n == name)) == tidy(whole[name])
    assert [r for r in rows if r[0] == "blank.txt"] == []


def test_registered_reader(spark, tmp_path):
    (tmp_path / "x.csv").write_text("concept,relation")

    def read(batches):
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "section_pos": 0, "page": None, "title": "csv", "content": [bytes(c).decode() for c in b["content"]]})

    S.register_reader(".csv", read)
    try:
        sections, _ = S.scan_sections(spark, str(tmp_path / "*"))
        assert [(r.title, r.content) for r in sections.collect()] == [("csv", "concept,relation")]
    finally:
        S.READERS.clear()


def test_sheet(spark):
    cells = [("KnowledgeGraph", r, c, v) for r, row in enumerate([("concept", "relation", "target"), ("search", "is_a", "algorithm"), (None, None, None), ("x", " ", None)]) for c, v in enumerate(row)]
    (row,) = flatten_cells(spark.createDataFrame(cells, "sheet string, row int, col int, value string")).collect()
    assert row.title == "KnowledgeGraph" and row.content == "concept | relation | target\nsearch | is_a | algorithm\nx | "


def test_long_section_with_a_chapter(spark):
    text = "第1章 搜索算法\n\n" + "\n\n".join(["启发式搜索使用估价函数。" * 3] * 30)
    df = spark.createDataFrame([("c", "d", "textbook", 0, text, 3, None)], "course_id string, document_id string, source_type string, section_pos int, content string, page int, title string")
    chunks = chunk_sections(df, 200, 20).orderBy("chunk_pos").collect()
    assert len(chunks) > 1 and {r.page for r in chunks} == {3} and chunks[0].knowledge_points
    assert chunks[0].chapter == "第1章 搜索算法" and all(len(r.content) <= 200 + 20 + 2 for r in chunks)
    with pytest.raises(ValueError):
        chunk_sections(df, 100, 100)


def test_chunks_are_replaced_by_course(spark, tmp_path):
    df = spark.createDataFrame([("c1", "d1", "t", "hello world"), ("c2", "d2", "t", "bye")], "course_id string, document_id string, source_type string, content string")
    path = str(tmp_path / "chunks")
    write_chunks(chunk_documents(df), path)
    write_chunks(chunk_documents(df.where("course_id = 'c1'").withColumn("content", F.lit("new"))), path)
    assert {(r.course_id, r.content_preview) for r in spark.read.parquet(path).collect()} == {("c1", "new"), ("c2", "bye")}
    with pytest.raises(ValueError):
        write_chunks(chunk_documents(df.limit(0)), path)


def test_report_is_sorted_json(spark, tmp_path):
    S.write_report(spark.createDataFrame([(1, "x")], "b int, a string"), str(tmp_path / "r"))
    (row,) = spark.read.text(str(tmp_path / "r")).collect()
    assert row.value == '{"a":"x","b":1}' and json.loads(row.value)
