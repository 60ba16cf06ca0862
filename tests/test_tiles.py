"""Search of many queries in tiles against the search that sends the queries to the chunks."""

import numpy as np
import pytest

from lectern.operators import search as S

CHUNK = "course_id string, chunk_id string, chapter string, source_type string, verified boolean, embedding array<double>, content string"
ASKED = "query_id bigint, course_id string, chapter string, source_type string, verified_only boolean, embedding array<double>, top_k int"


@pytest.mark.parametrize(("own", "digits", "block"), [(False, None, 16), (True, 6, 16), (False, 9, 1024)])
def test_tiles_are_the_small_path(spark, monkeypatch, own, digits, block):
    rng = np.random.default_rng(1)
    vector = lambda: [float(x) for x in rng.integers(-2, 3, 6) / 3]  # noqa: E731  many ties
    pick = lambda *c: c[rng.integers(len(c))]
    course = lambda: pick("big", "big", "big", "a", "b", "c", None)
    chunks = [(course(), f"é{i}", pick("1", "2", None), pick("x", "y"), pick(True, False, None), None if i % 97 == 0 else vector(), f"t{i}") for i in range(900)]
    queries = [(i, pick("big", "a", "b", "c", "none", None), pick("", "1", None), pick("", None, "x"), pick(None, True, False), None if i % 50 == 7 else vector(), i % 20 + 1) for i in range(120)]
    c, q = spark.createDataFrame(chunks, CHUNK).repartition(3), spark.createDataFrame(queries, ASKED)
    q = q if own else q.drop("top_k")
    columns = ["query_id", "rank", "chunk_id", "course_id", "content", "distance"]
    want = sorted(map(tuple, S.search(c, q, 5, digits=digits).select(columns).collect()))
    monkeypatch.setattr(S, "QUERIES_SENT", 0)
    monkeypatch.setattr(S, "CHUNK_BLOCK", block)
    monkeypatch.setattr(S, "QUERY_BLOCK", 7)
    monkeypatch.setattr(S, "SALT_BLOCKS", 4)
    got = S.search(c, q, 5, digits=digits)
    plan = got._jdf.queryExecution().toString()
    assert "salt" in plan and len(want) > 100
    assert sorted(map(tuple, got.select(columns).collect())) == want
    assert S.search(c.limit(0), q, 5).count() == 0 and S.search(c, q.limit(0), 5).count() == 0


@pytest.mark.parametrize(("cell", "few"), [(1024, 16), (16, 4), (8, 1)])
def test_duplicate_pairs_of_small_and_large_groups(spark, monkeypatch, cell, few):
    from lectern.operators import exams as E

    monkeypatch.setattr(E, "CELL", cell)
    monkeypatch.setattr(E, "FEW", few)
    rng = np.random.default_rng(2)
    words = lambda: " ".join(f"w{i}" for i in rng.integers(0, 9, 6))
    items = [(g, p, words() if p % 11 else None) for g, n in ((1, 70), (2, 3), (3, 1), (4, 5), (None, 4)) for p in range(n)]
    df = spark.createDataFrame(items, "exam_id bigint, pos int, question_text string").selectExpr("*", "1 as g", "2 as p", "3 as b").repartition(3)
    vectors = S.hashing_vectors([t for _, _, t in items], 256)
    want = {(g, p, q): float(v @ w) for (g, p, _), v in zip(items, vectors, strict=True) for (h, q, _), w in zip(items, vectors, strict=True) if g is not None and g == h and p < q and round(float(v @ w), 9) >= 0.7}
    got = {(r.exam_id, r.i, r.j): r.similarity for r in E.duplicate_pairs(df, threshold=0.7).collect()}
    assert got.keys() == want.keys() and len(want) > 50 and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert E.duplicate_pairs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        E.duplicate_pairs(df, threshold=0)
