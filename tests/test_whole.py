"""Queries that work on all documents, against brute force on a small fixture."""

import hashlib
import re

import __spark_entry__
import numpy as np
import pytest

from lectern.plans.queries import QUERIES

TOKEN = re.compile("[一-鿿A-Za-z0-9_]+")


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """Documents of 6 sources, of one chunk each, and 4 of them as benchmark items; no item is of src0."""
    folder = str(tmp_path_factory.mktemp("small"))
    docs = [(i, " ".join(f"w{(i * 7 + j * j) % 97}" for j in range(20 + i)), "en", f"src{i % 6}", 0) for i in range(60)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    items = [(i, docs[i][1]) for i in (7, 14, 27, 40)]
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, items


def embedding(text):
    v = np.zeros(256)
    for t in TOKEN.findall(text.lower()):
        d = hashlib.sha256(t.encode()).digest()
        v[int.from_bytes(d[:4], "big") % 256] += 1 if d[4] % 2 == 0 else -1
    return v / (np.linalg.norm(v) or 1)


def nearest(docs, items, k=8):
    """(rank, doc_id, distance) of each item's k nearest documents."""
    vectors = {d[0]: embedding(d[1]) for d in docs}
    found = {}
    for i, text in items:
        distance = sorted((round(float(((v - embedding(text)) ** 2).sum()), 9), f"{d}:0", d) for d, v in vectors.items())[:k]
        found[i] = [(rank, d, x) for rank, (x, _, d) in enumerate(distance, 1)]
    return found


def test_search_reaches_all_documents(spark, small):
    folder, docs, items = small
    got = {(r.query_id, r.rank): r.score for r in QUERIES[__spark_entry__.i03_search_all_documents.__name__](spark, folder).collect()}
    want = {(i, rank): 1 / (1 + x) for i, rows in nearest(docs, items).items() for rank, _, x in rows}
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-5 for k in want)
    assert all(got[i, 1] == 1 for i, _ in items)


def test_rows_of_all_courses_are_whole(spark, small):
    folder, docs, _ = small
    assert {(r.entry_id, r.text) for r in QUERIES["c10_eav_to_rows_of_all"](spark, folder).collect()} == {(d[0], d[1]) for d in docs}


def test_labels_and_metrics_of_a_search_of_all_documents(spark, small):
    folder, docs, items = small
    texts = {d[0]: d[1] for d in docs}
    hits = {i: [all(w in texts[d] for w in list(dict.fromkeys(re.findall("[A-Za-z][A-Za-z0-9_-]{2,20}", texts[i])))[:2]) for _, d, _ in rows] for i, rows in nearest(docs, items).items()}
    assert any(0 < sum(h) < 8 for h in hits.values())
    got = {r.query_id: (r.n_retrieved, r.n_expected, r.missing) for r in QUERIES["b07_labels_of_search"](spark, folder).collect()}
    assert got == {i: (8, max(1, sum(h)), not any(h)) for i, h in hits.items()}
    r = QUERIES["i05_evaluate_search"](spark, folder).first()
    gain = lambda h: sum(x / np.log2(n + 2) for n, x in enumerate(h))
    assert r.hit_at_k == r.recall_at_k == np.mean([any(h) for h in hits.values()])
    assert abs(r.mrr - np.mean([1 / (h.index(True) + 1) if any(h) else 0 for h in hits.values()])) < 2e-6
    assert abs(r.ndcg - np.mean([gain(h) / gain([1] * sum(h)) if any(h) else 0 for h in hits.values()])) < 2e-6
    assert abs(r.context_precision - np.mean([sum(h) / 8 for h in hits.values()])) < 2e-6
