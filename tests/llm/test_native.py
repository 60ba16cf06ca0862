"""Sharding, mixing and exact dedup against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import pytest

from lectern.llm.common import bands_for, gapless, maybe_among, saved
from lectern.llm.dedup import OP9_SQL, exact_copies, op9_exact_dedup, without_copies
from lectern.llm.mix import _drawn, _numbered, _taken, mix_sources, mixed_rows, op3_mix_sources, split_blocks
from lectern.llm.shard import op2_rendezvous_shards, shard_documents

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [
    (1, "a b c", "en", "x", 5), (2, "a b c", "en", None, 5), (3, "", "en", "x", 0), (4, None, "en", "y", 0), (5, "é 中 " * 3000, "en", "x", 1), (5, "é 中 " * 3000, "en", "x", 1),
    (None, "a b c", None, None, None), (6, "A b c", "en", "y", 5), (7, "a b c ", "en", "y", 6), (None, None, None, None, None),
]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_shards(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op2_rendezvous_shards(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    slots = {}
    for r in rows:
        b = docs[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(b) + 8, zlib.crc32(b), "key") and 0 <= r.shard < 24
        assert r.grown_shard in (r.shard, 24)
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_follow_weights_and_take_odd_rows(spark, odd):
    many = spark.range(20_000).selectExpr("id as doc_id", "'' as text")
    counts = {r.shard: r["count"] for r in shard_documents(many, weights=[1.0, 3.0, 0.0]).groupBy("shard").count().collect()}
    assert set(counts) == {0, 1} and 2.7 < counts[1] / counts[0] < 3.3
    assert shard_documents(odd).count() == len(ODD) and shard_documents(odd.limit(0)).count() == 0
    clash = odd.selectExpr("*", "1 as shard", "2 as _bucket", "3 as slot")
    assert shard_documents(clash).count() == len(ODD)


def test_gapless_is_gapless_within_hot_groups(spark):
    df = spark.range(5000).selectExpr("id", "case when id % 10 = 0 then id % 7 else 99 end as g")
    rows = gapless(df, "g", ["id"], "at").collect()
    for g in {r.g for r in rows}:
        assert sorted(r.at for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))


def expected_targets(sizes, weights=(1, 2, 3), cap=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, total, open_ = dict.fromkeys(order, 0.0), sum(sizes.values()), set(order)
    while total > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += total * weight[s] / w
        total = sum(max(0, target[s] - cap * sizes[s]) for s in open_)
        full = {s for s in open_ if target[s] >= cap * sizes[s]}
        for s in full:
            target[s] = cap * sizes[s]
        open_ -= full
    return target


def check_mix(rows, docs):
    words = {}
    for d in docs:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", d.text or ""))
        words[d.source] = words.get(d.source, 0) + n
    target = expected_targets(words)
    taken = dict.fromkeys(words, 0)
    assert len(rows) == len(docs)
    for r in rows:
        assert r.source_size == words[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert r.taken == r.size * r.copies <= 3 * r.size and len(r.shards) == r.copies and all(0 <= x < 16 for x in r.shards)
        taken[r.source] += r.taken
    return target, taken


def test_mix_meets_targets_and_repeats(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mix_sources(docs).collect()
    target, taken = check_mix(rows, docs.collect())
    largest = {s: max(r.size for r in rows if r.source == s) for s in target}
    assert all(abs(taken[s] - t) < largest[s] for s, t in target.items())
    assert sum(abs(taken[s] - t) for s, t in target.items()) < 0.03 * sum(target.values())
    again = {(r.doc_id, tuple(r.shards)) for r in mix_sources(docs.repartition(7)).collect()}
    assert again == {(r.doc_id, tuple(r.shards)) for r in rows}
    assert set(op3_mix_sources(spark, sf_dir).columns) >= {"doc_id", "size", "source_size", "target", "taken"}


def test_mix_caps_small_sources(spark):
    rows = [(i, "w " * 10, "en", "big", 20) for i in range(100)] + [(200 + i, "w " * 10, "en", "tiny", 20) for i in range(3)] + [(300, None, "en", None, 0)]
    df = spark.createDataFrame(rows, DOCS)
    target, taken = check_mix(mix_sources(df).collect(), df.collect())
    assert target["tiny"] == 90 and taken["tiny"] == 90 and taken[None] == 0


def test_mix_takes_odd_rows(odd):
    check_mix(mix_sources(odd).collect(), odd.collect())
    assert mix_sources(odd.limit(0)).count() == 0
    out = mixed_rows(odd).collect()
    assert {r.row.text for r in out} <= {r[1] for r in ODD}
    counts = sorted((str(r.doc_id), r.size, r.copies) for r in mix_sources(odd).collect() for _ in range(r.copies))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r.row.doc_id), size(r.row.text)) for r in out) == [c[:2] for c in counts]


def test_mix_tells_rows_of_one_key_apart(spark):
    rows = [(None, "w " * (5 + i % 4) + f"n{i}", "en", "a", i) for i in range(300)] + [(1, "w " * 6 + f"k{i}", "en", "b", i) for i in range(300)]
    rows += [(2, "same " * 7, "en", "c", i % 5) for i in range(200)] + [(10 + i, f"v{i} " * 9, "en", "d", i) for i in range(150)]
    df = spark.createDataFrame(rows, DOCS)
    mix = mix_sources(df).collect()
    target, taken = check_mix(mix, rows_of := df.collect())
    largest = {s: max(r.size for r in mix if r.source == s) for s in target}
    assert all(abs(taken[s] - t) < largest[s] for s, t in target.items())
    out = [mixed_rows(d).collect() for d in (df, df.repartition(7))]
    assert sorted(map(str, out[0])) == sorted(map(str, out[1]))
    rows = [r.row for r in out[0]]
    assert len(rows) == sum(r.copies for r in mix) and {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in taken} == taken
    times = Counter((r.doc_id, r.text, r.source, r.n_chars) for r in rows)
    assert all(times[d.doc_id, d.text, d.source, d.n_chars] <= 3 * (40 if d.source == "c" else 1) for d in rows_of)


def test_mix_reruns_agree_where_ids_repeat(spark):
    rows = [(i // 4, " ".join(f"t{i}_{j}" for j in range(1 + i * 7 % 25)), "en", "xyz"[i % 3], i) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS)
    outs = [mix_sources(d).collect() for d in (df, df.repartition(5), df.repartition(3, "text"), df.orderBy("n_chars", ascending=False).coalesce(1))]
    target, taken = check_mix(outs[0], df.collect())
    assert all(sorted(map(str, o)) == sorted(map(str, outs[0])) for o in outs)
    assert all(abs(taken[s] - t) < 25 for s, t in target.items())


def test_mix_draws_whole_blocks_by_quota(spark):
    """Rows of one block go to the same shards, but for the part of a block that ends a source; each shard's draws are a run of the quota."""
    rows = [(i, "w " * (1 + i % 9), "en", "ab"[i % 5 > 0], i) for i in range(6000)]
    numbered = _numbered(spark.createDataFrame(rows, DOCS), "doc_id", "text", "source", 20)
    sources, blocks = _drawn(numbered, (1, 2, 3), 3, 8, 20)
    of = {r.source_key: r for r in sources.collect()}
    drawn = {(r.source_key, r._block): r._shards or [] for r in blocks.collect()}
    assert len(drawn) > 490 and {s for s, _ in drawn} == set(of)  # a block without rows is none
    for r in _taken(numbered, sources, blocks).collect():
        src, whole = of[r.source_key], drawn[r.source_key, r._block]
        partly = (r._block == src._part and r._place <= src._until) or r._place == src._fill
        assert r.shards == whole + [src._part_shard] * partly
    for s in of:
        dealt = Counter(x for (k, _), shards in drawn.items() if k == s for x in shards)
        assert max(dealt.values()) - min(dealt[i] for i in range(8)) < 40
    mean = sum(len(x) for x in drawn.values()) / 8
    totals = Counter(x for shards in drawn.values() for x in shards)
    assert all(abs(totals[i] - mean) <= 3 for i in range(8))


def test_splitting_tree_keeps_quotas(spark):
    quotas = {"sa": 256 * 3, "sb": 17, "sc": 0, "sd": 1000}
    ends = {r.source_key: r.ends for r in split_blocks(spark.createDataFrame(list(quotas.items()), "source_key string, quota bigint"), 8, 1).collect()}
    sizes = {s: [b - a for a, b in zip([0, *e], e, strict=False)] for s, e in ends.items()}
    assert {s: e[-1] for s, e in ends.items()} == quotas and all(min(x) >= 0 for x in sizes.values())
    totals = [sum(sizes[s][i] for s in quotas) for i in range(8)]
    assert max(totals) - min(totals) <= 3
    assert max(sizes["sd"]) - min(sizes["sd"]) < 60


def test_exact_dedup_is_the_sql(spark, sf_dir):
    duckdb.sql(f"create or replace view documents as from read_parquet('{sf_dir}/documents.parquet')")
    want = sorted(duckdb.sql(OP9_SQL).fetchall())
    got = op9_exact_dedup(spark, sf_dir)
    assert sorted(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == want


def test_exact_dedup_of_odd_rows(odd):
    rows = exact_copies(odd, digests=True).collect()
    assert len(rows) == len(ODD)
    groups = {}
    for r in ODD:
        groups.setdefault(r[1] or "", []).append(r[0])
    for r in rows:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.digest)
        assert r.group_size == len(groups[text]) and r.keep_id == max((x for x in groups[text] if x is not None), default=None)
    assert sum(r.kept for r in rows) == len(groups)
    kept = without_copies(odd).collect()
    assert sorted((r.text or "") for r in kept) == sorted(groups) and len(kept[0]) == 5
    assert without_copies(odd.limit(0)).count() == 0


def test_exact_dedup_of_one_key_with_many_texts(spark):
    rows = [(None if i % 2 else 1, f"text {i // 4}", "en", "s", i) for i in range(400)]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    kept = without_copies(df).collect()
    assert sorted(r.text for r in kept) == sorted({r[1] for r in rows}) and {r.doc_id for r in kept} == {1}
    again = without_copies(df.repartition(3)).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


@pytest.mark.parametrize("most_bits", [1 << 28, 1 << 15, 8])
def test_filter_has_no_false_negatives(spark, most_bits):
    numbers = saved(spark.range(900).selectExpr("xxhash64(id) as h"))
    rows = maybe_among(spark.range(5000).selectExpr("id", "xxhash64(id) as n"), "n", numbers, most_bits).collect()
    assert len(rows) == 5000 and all(r._maybe for r in rows if r.id < 900)
    assert sum(r._maybe for r in rows) < (1200 if most_bits > 1 << 20 else 5001)
    assert not any(r._maybe for r in maybe_among(spark.range(9).selectExpr("id as n"), "n", numbers.limit(0)).collect())


def test_bands_reach_the_recall():
    for threshold, recall, most in ((0.8, 0.999, 128), (0.3, 0.9, 128), (0.05, 0.9, 128), (0.5, 0.99, 128), (1.0, 0.999, 8), (0.99, 0.999, 128)):
        bands, rows = bands_for(threshold, recall, most)
        assert 1 - (1 - threshold**rows) ** bands >= recall and bands * rows <= most
    for wrong in ((0.01, 0.999), (0.0, 0.9), (0.8, 1.0)):
        with pytest.raises(ValueError):
            bands_for(*wrong)
