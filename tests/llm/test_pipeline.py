"""Each stage of the pipeline on its own input, and the whole."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from lectern.llm.common import shared_table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, seen = docs.columns, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := shared_table(spark, "stage"))
        before, docs = docs, spark.read.parquet(path)
        seen.append(docs.count())
        if i < 4:
            assert docs.columns == columns, name
            assert docs.join(before, "doc_id", "left_anti").count() == 0
        if i == 0:
            assert docs.where("text is null").count() == 0 and all(len(WORD.findall(r.text)) >= 20 for r in docs.collect())
        if i == 1:
            kept = {}
            for r in before.collect():
                kept[r.text] = max(r.doc_id, kept.get(r.text, -1))
            assert {r.doc_id for r in docs.collect()} == set(kept.values()) and seen[1] == len(kept)
        if i == 3:
            assert max(Counter(r.doc_id for r in docs.collect()).values()) <= 3
    assert seen[0] > seen[1] >= seen[2]
    assert corpus_pipeline.run(spark, sf_dir).count() == seen[-1]


def test_stages_take_odd_rows(spark):
    long = "lorem%d " * 40
    rows = [(1, long % tuple(range(40)), None, None, None), (1, long % tuple(range(40)), None, None, None), (None, long % tuple(range(7, 47)), "en", "s", 1), (2, "", "en", "s", 0), (3, None, "en", "s", 0), (4, " ".join(f"v{i}" for i in range(30_000)), "en", "t", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").selectExpr("*", "1 as kept", "2 as _row", "'x' as label", "3 as shards", "4 as _source", "5 as _key", "6 as shard", "map('a', 1) as place", "7 as _digest", "8 as _maybe", "9 as _place")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, "")
            assert out.count() >= 0 and (name == "packing" or out.columns == some.columns)
    assert corpus_pipeline.STAGES[0][1](spark, docs, "").count() == 4
    assert corpus_pipeline.STAGES[1][1](spark, docs, "").count() == 4
    assert corpus_pipeline.STAGES[2][1](spark, docs, "").count() <= 5


def test_packing_keeps_the_shards_and_their_order(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    stages["mixing"](spark, docs, sf_dir).write.parquet(str(tmp_path / "mix"))
    mix = spark.read.parquet(str(tmp_path / "mix"))
    place = defaultdict(list)  # of each document's copies: file and row
    for r in mix.select("doc_id", "_metadata.file_name", "_metadata.row_index").collect():
        place[r.doc_id].append((r.file_name, r.row_index))
    assert len({f for rows in place.values() for f, _ in rows}) == corpus_pipeline.SHARDS
    rows = stages["packing"](spark, mix, sf_dir).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))] and sum(r.length for r in own) <= own[0].sequence_size
        pieces = [(r.doc_id, r.start, r.ids_crc32) for r in own]
        assert len(pieces) == len(set(pieces))  # no two copies of a piece
        assert set.intersection(*({f for f, _ in place[r.doc_id]} for r in own))  # one shard
    assert Counter(r.doc_id for r in rows if r.start == 0) == {d: len(p) for d, p in place.items()}
    again = stages["packing"](spark, mix.repartition(3, "doc_id"), sf_dir)
    assert again.count() == len(rows)
    # Among the documents of a file that it has once, pieces of one length lie in sequences alike in the order of the file.
    other = stages["packing"](spark, spark.read.parquet(str(tmp_path / "mix")), sf_dir).collect()
    assert sorted(map(str, other)) == sorted(map(str, rows))
    once = sorted((place[r.doc_id][0], r.sequence_id, r.offset) for r in rows if r.length == 2048 and len(place[r.doc_id]) == 1)
    for (f, _), s, _ in [(a[0], a, b) for a, b in zip(once, once[1:], strict=False) if a[0][0] == b[0][0] and a[1] > b[1]]:
        raise AssertionError(f"{f}: {s} out of order")
