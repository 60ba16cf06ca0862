"""Periodic runs against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm.periodic import WaveletTree, find_runs, op12_periodic_runs, periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_runs(words, least=6, exponent=4):
    found, n = {}, len(words)
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, exponent * q):
                found.setdefault((i, j + q), q)
            i = max(j, i + 1) if j == i else j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapse(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


looped = st.builds(lambda a, b, n, c, d, m: [*a, *(b * n), *c, *(d * m)], *[st.lists(st.sampled_from("abc"), max_size=6), st.lists(st.sampled_from("ab"), min_size=1, max_size=5), st.integers(0, 9)] * 2)


@given(st.lists(st.lists(st.sampled_from("ab"), max_size=40) | looped, max_size=4))
@settings(max_examples=400, deadline=None)
def test_runs_of_small_texts(texts):
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    edges = np.r_[0, np.cumsum(sizes)].astype(np.int64)
    words = np.array([ord(w) for t in texts for w in t], dtype=np.int64)
    start, end, period = find_runs(words, np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes))
    for t, a, b in zip(texts, edges, edges[1:], strict=False):
        own = (start >= a) & (start < b)
        assert list(zip(start[own] - a, end[own] - start[own], period[own], strict=True)) == brute_runs(t)


@given(st.permutations(range(13)), st.data())
@settings(deadline=None)
def test_wavelet_tree(values, data):
    tree, values = WaveletTree(np.array(values)), list(values)
    a, b = sorted(data.draw(st.tuples(st.integers(0, 13), st.integers(0, 13))))
    x = data.draw(st.integers(0, 12))
    one = lambda *n: [np.array([i]) for i in n]
    assert tree.less(*one(a, b, x))[0] == sum(v < x for v in values[a:b])
    for k, v in enumerate(sorted(values[a:b])):
        assert tree.nth(*one(a, b, k))[0] == v


def test_query_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        w = WORD.findall(r.text or "")
        h, n = zlib.crc32(str(r.doc_id).encode()), len(w)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w) if n <= 1500 or h % 10 == 0 else None
        g = got[r.doc_id]
        if runs is None:
            continue
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        assert (g.n_runs, g.start, g.length, g.period) == (len(runs), *best)
        assert g.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert g.runs_sha256 == hashlib.sha256("".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()).hexdigest()
        assert g.collapsed_sha256 == hashlib.sha256(collapse(w, runs).encode()).hexdigest()


def test_odd_rows(spark):
    rows = [(1, "a b " * 5 + "c"), (2, ""), (3, None), (None, "x " * 70_000), (1, "a b " * 5 + "c"), (4, "y" * 100_000), (5, "a a b " * 60_000 + "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as runs", "2 as collapsed", "'k' as _text")
    got = {(r.doc_id, tuple(map(tuple, r.runs)), r.collapsed) for r in periodic_runs(df).collect()}
    assert got == {(1, ((0, 10, 2),), "a b c"), (2, (), ""), (3, (), ""), (None, ((0, 70_000, 1),), "x"), (4, (), "y" * 100_000), (5, ((0, 180_000, 3),), "a a b z")}
    assert periodic_runs(df).count() == len(rows) and periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic_runs(df, exponent=3)
