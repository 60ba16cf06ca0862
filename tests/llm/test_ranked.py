"""Ranked search against brute force."""

import math
import re
from collections import Counter, defaultdict

import pytest

from lectern.llm import ranked
from lectern.llm.ranked import op11_ranked_search, rank_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(docs, items, best=10):
    terms = lambda text: TERM.findall((text or "").translate(LOWER))
    held = [(d, Counter(terms(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, length = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = set()
    for item, text in set(items):
        found = []
        for d, c in held:
            m = 25 + 75 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score:
                found.append((-score, d is not None, d or 0, d))
        out |= {(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:best], 1)}
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    assert {tuple(r) for r in op11_ranked_search(spark, sf_dir).collect()} == brute(docs, items)


DOCS = [(1, "The CAT sat. É\x85x"), (2, None), (3, ""), (None, "the cat"), (4, "the cat"), (4, "the cat"), (5, "cat " * 40_000), (6, "ÉÉ é dog-dog_dog"), (7, "!!"), (8, "mouse")]
ITEMS = [(1, "the CAT cat"), (1, "the CAT cat"), (1, "dog"), (None, "É\x85x sat é"), (2, None), (3, "--"), (4, "unheard"), (5, "mouse the the the")]


@pytest.mark.parametrize(("block", "bundle", "size"), [(4096, 256, 1 << 20), (2, 2, 1 << 20), (3, 1, 12)])
def test_odd_rows_blocks_bundles_and_passes(spark, monkeypatch, block, bundle, size):
    monkeypatch.setattr(ranked, "BLOCK", block)
    monkeypatch.setattr(ranked, "BUNDLE", bundle)
    monkeypatch.setattr(ranked, "PASS_BYTES", size)
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string").selectExpr("*", "1 as terms", "2 as block", "3 as item", "4 as score", "5 as rank")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 as said", "2 as hash", "3 as bytes", "4 as doc_id")
    got = [tuple(r) for r in rank_documents(docs, items, best=3).collect()]
    want = brute(DOCS, ITEMS, 3)
    assert len(got) == len(want)
    by = defaultdict(list)
    for r in got:
        by[r[0], r[1]].append(r[2:])
    assert {(*k, *v) for k, vs in by.items() for v in vs} == want
    assert rank_documents(docs.limit(0), items).count() == 0 and rank_documents(docs, items.limit(0)).count() == 0
