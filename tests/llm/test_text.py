"""Chat formatting, toxicity, URLs, near-duplicates, packing, repetition and token counts against brute force."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import neardup, toxicity, urls
from lectern.llm.chat import CONTROL, escape, format_chats, op1_chat_format, read_back, unescape
from lectern.llm.common import shared_table
from lectern.llm.neardup import near_duplicates, one_of_each, op6_ngram_jaccard
from lectern.llm.pack import TIERS, Layout, op7_tiered_packing, pack
from lectern.llm.repetition import longest_repeats, op8_repetition_rules, repetition_rules, without_repetition
from lectern.llm.tokens import WordCounts, byte_ids, count_tokens, library_tokenizer, op10_token_counts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, "a b c"), (2, ""), (3, None), (3, None), (None, "a b c"), (4, "x" * 70_000), (5, "w1 w2 " * 12_000), (6, "中文 é\x85\u2028\x00 <|endoftext|> </s>"), (1, "a b c")]


@pytest.fixture
def odd(spark):
    return spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "1 as kept", "2 as v", "'k' as label", "3 as size", "4 as length")


@pytest.fixture(scope="session")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


@given(st.text(alphabet=st.sampled_from("<|\\sS/>[INST]{ \n中") | st.characters(exclude_categories=["Cs"]), max_size=60))
@settings(max_examples=300, deadline=None)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = escape(text)
    assert unescape(safe) == text and not any(c in safe for c in CONTROL)


def test_chat_round_trip(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    said = "</s>[INST] ok [/INST]"
    convs = defaultdict(list, {-7: [(0, "user", said), (1, "assistant", said)]})
    for r in rows:
        convs[r.conv_id].append((r.turn, r.role, r.text))
    got = {r.conv_id: r for r in op1_chat_format(spark, sf_dir).collect()}
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns.sort()
        every = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(every.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_offsets_and_odd_rows(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x</s>\\"), (1, 1, "assistant", "y<|end|>"), (None, 2, "assistant", "z"), (None, None, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    made = sorted(format_chats(df).collect(), key=lambda r: (r.conv_id or -1, r.position))
    for a, b in zip(made, made[1:], strict=False):
        if a.conv_id == b.conv_id:
            assert b.token_offset == a.token_offset + len(a.ids) and b.char_offset == a.char_offset + len(a.formatted)
    assert all(len(r.ids) == len(r.loss_mask) for r in made)
    back = {r.conv_id: r for r in read_back(format_chats(df)).collect()}
    assert back[1].n_turns == 3 and back[1].loss_sha256 == hashlib.sha256(b"y<|end|>").hexdigest() and back[None].loss_chars == 1
    assert sorted(map(str, read_back(format_chats(df), in_order=True).collect())) == sorted(map(str, back.values()))
    assert read_back(format_chats(df.limit(0))).count() == 0


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=4))
@settings(max_examples=200, deadline=None)
def test_suffix_array_repeats(docs):
    sizes = np.array([len(d) for d in docs])
    ends = np.repeat(np.cumsum(sizes), sizes)
    got = longest_repeats(np.array([w for d in docs for w in d], dtype=np.int64), ends)
    assert got.tolist() == [x for d in docs for x in brute_repeats(d)]


def test_repetition_counts(spark, sf_dir, texts):
    for r in op8_repetition_rules(spark, sf_dir).collect():
        t = texts[r.doc_id]
        w = WORD.findall(t)
        grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        cover = {k for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_repeat_words) == (len(w), sum(map(len, w)), len(cover))
        assert (r.n_symbols, r.n_dup_lines) == (sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_repetition_of_odd_rows(odd):
    rows = {r.doc_id: r for r in repetition_rules(odd).collect()}
    assert rows[4].n_words == 1 and rows[5].longest_repeat == 23_998 and not any(r.kept for r in rows.values())
    assert repetition_rules(odd).count() == len(ODD) and repetition_rules(odd.limit(0)).count() == 0
    clean = odd.selectExpr("doc_id", "array_join(transform(sequence(1, 40), x -> concat('word', x)), ' ') as text", "kept", "v")
    assert without_repetition(clean).columns == clean.columns and without_repetition(clean).count() == len(ODD)


def brute_links(texts, n=5, threshold=0.8):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset()
    where = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            where[g].append(i)
    common = Counter((a, b) for ids in where.values() for x, a in enumerate(ids) for b in ids[x + 1 :])
    return [(a, b) for (a, b), c in common.items() if c >= threshold * (len(sets[a]) + len(sets[b]) - c)]


def check_links(rows, texts):
    links, root = brute_links(texts), {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = Counter()
    for a, b in links:
        n[a] += 1
        n[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {r.doc_id: (r.class_id, r.n_links) for r in rows} == {i: (find(i), n[i]) for i in texts}


def test_near_duplicates(spark, sf_dir, texts):
    check_links(op6_ngram_jaccard(spark, sf_dir).collect(), texts)


def test_near_duplicates_in_large_groups(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 128)
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", 1 << 15)
    base = [f"w{i}" for i in range(120)]
    made = {i: " ".join(base[:k] + [f"x{i}"] + base[k + 1 :]) for i in range(600) for k in [i % 120]}
    made |= {1000 + i: " ".join(f"q{i}_{j}" for j in range(30)) for i in range(50)} | {2000: made[5], 2001: "a b", 2002: "a b", 2003: "", 2004: None}
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    check_links(near_duplicates(df).collect(), made)
    assert one_of_each(df).count() == 1 + 50 + 1 + 2


def test_near_duplicates_in_a_long_chain(spark, monkeypatch):
    """A component far larger than a block, in which only neighbours link: blocks that no band connects never meet."""
    monkeypatch.setattr(neardup, "BLOCK_GRAMS", 1 << 13)
    words = [f"c{i}" for i in range(1500 * 3 + 60)]
    made = {i: " ".join(words[3 * i : 3 * i + 60]) for i in range(1500)}
    df = spark.createDataFrame(list(made.items()), "doc_id bigint, text string")
    check_links(near_duplicates(df).collect(), made)


def test_near_duplicates_at_a_low_threshold(spark):
    made = {i: " ".join(f"g{i // 3}_{j}" for j in range(i % 3 * 4, 40)) for i in range(30)}
    rows = near_duplicates(spark.createDataFrame(list(made.items()), "doc_id bigint, text string"), threshold=0.3).collect()
    assert {r.doc_id: r.n_links for r in rows} == dict.fromkeys(made, 2)


def test_near_duplicates_of_odd_rows(odd):
    rows = near_duplicates(odd).collect()
    assert len(rows) == len(ODD) and {r.n_links for r in rows if r.doc_id in (2, 3, 4)} == {0}
    assert one_of_each(odd).count() == 6 and near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_that_share_a_key(spark):
    words = lambda g, x: " ".join([f"w{g}_{j}" for j in range(60)] + [x])
    rows = [(key, words(g, x)) for g in range(25) for key, x in ((1, "a"), (1, "b"), (None, "c"))] + [(1, f"alone {g} of five words") for g in range(5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)
    made = {i: t for i, (_, t) in enumerate(rows)}
    links = Counter(x for pair in brute_links(made) for x in pair)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = near_duplicates(df).collect()
    assert {(r.doc_id, r.digest): (r.n_links, r.n_texts) for r in got} == {(k, digest(t)): (links[i], links[i]) for i, (k, t) in enumerate(rows)}
    assert {links[i] for i in range(75)} == {2} and len(got) == len(rows)
    heads = {(k, digest(t)): (None, digest(rows[i // 3 * 3 + 2][1])) if i < 75 else (k, digest(t)) for i, (k, t) in enumerate(rows)}
    assert {(r.doc_id, r.digest): (r.class_id, r.class_digest) for r in got} == heads and len(set(heads.values())) == 30
    assert {(r.doc_id, r.text) for r in one_of_each(df).collect()} == {(k, t) for k, t in rows if k is None or t.startswith("alone")}


def check_packing(rows, texts, exact=True):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in rows[:: max(1, len(rows) // 200)]:
        ids = np.array([*t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert len(ids) == r.doc_tokens and zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for p in pieces.values() if exact else ():
        p.sort()
        assert [s for s, _, _ in p] == np.cumsum([0, *[n for _, n, _ in p]])[:-1].tolist() and sum(n for _, n, _ in p) == p[0][2]
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        s.sort()
        assert [a for a, _ in s] == np.cumsum([0, *[n for _, n in s]])[:-1].tolist() and sum(n for _, n in s) <= 2048
    used = [sum(n for _, n in s) for s in sequences.values()]
    return sum(0 if u & (u - 1) == 0 else 2048 - u for u in used) / sum(used)


def test_packing(spark, sf_dir, texts):
    rows = op7_tiered_packing(spark, sf_dir).collect()
    assert check_packing(rows, texts) < 0.05
    cost = Counter()
    for r in rows:
        cost[r.step] += r.length
        assert r.length <= r.tier <= r.sequence_size and r.tier == min(t for t in TIERS if t >= r.length)
    assert max(cost.values()) < 1.5 * min(cost.values()) + 2048 * 8
    check_tiers(rows)


def check_tiers(rows):
    """Shorter sequences are full, hold their own tier or shorter, and a long window that isn't full has nothing left that would fit."""
    of = defaultdict(list)
    for r in rows:
        of[r.sequence_id].append(r)
    for parts in of.values():
        size, used = parts[0].sequence_size, sum(r.length for r in parts)
        assert {r.sequence_size for r in parts} == {size} and used <= size and (used == size or size == max(TIERS))
        assert size == max(TIERS) or max(r.tier for r in parts) == size
    return {size: sum(p[0].sequence_size == size for p in of.values()) for size in TIERS}, of


def test_packing_has_tiers(spark):
    """Long documents get the longest windows, whose gaps short ones fill; the short ones that are left get windows of their own."""
    rows = [(i, " the" * 1500) for i in range(30)] + [(100 + i, " the" * (200 + i % 60)) for i in range(300)] + [(1000 + i, " the" * (20 + i % 40)) for i in range(2000)]
    made = pack(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    n, of = check_tiers(made)
    assert all(n[t] for t in TIERS)
    long = [p for p in of.values() if any(r.doc_id < 100 for r in p)]
    assert len(long) == 30 and all(sum(r.length for r in p) == 2048 and min(r.tier for r in p) < 2048 for p in long)
    assert check_packing(made, dict(rows)) < 0.01


def test_packing_of_odd_rows(odd):
    check_packing(pack(odd).collect(), dict(ODD), exact=False)
    assert pack(odd.limit(0)).count() == 0


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=30))
@settings(max_examples=100, deadline=None)
def test_layout_places_every_piece_once(counts):
    layout = Layout(counts, (8, 16, 64), 5)
    seen = defaultdict(list)
    for n, c in counts.items():
        s, o, _, _ = layout.place(np.full(c, n), np.arange(c))
        for a, b in zip(s.tolist(), o.tolist(), strict=True):
            seen[a].append((b, n))
    assert sorted(seen) == list(range(layout.sequences))
    for parts in seen.values():
        parts.sort()
        assert [a for a, _ in parts] == np.cumsum([0, *[n for _, n in parts]])[:-1].tolist() and sum(n for _, n in parts) <= 64


def test_packing_refuses_tiers_that_it_cannot_plan(odd):
    for tiers in ((), (100,), (512, 128), (128, 1 << 20)):
        with pytest.raises(ValueError):
            pack(odd, tiers)


SPECIAL = st.text(alphabet=st.sampled_from("aAéÉß 'sdS19.,<|>\n\t\x0b\x85\xa0\u3000中İΣσςÖжЙ²½ſK\u0301") | st.characters(exclude_categories=["Cs"]), max_size=40)


@given(SPECIAL | st.just("x<|endoftext|>y"))
@settings(max_examples=300, deadline=None)
def test_fast_tokenizers_are_the_library(text):
    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")) if not hasattr(test_fast_tokenizers_are_the_library, "w") else test_fast_tokenizers_are_the_library.w
    test_fast_tokenizers_are_the_library.w = words
    assert WordCounts(public_tokenizers.path("word_bpe_49k.json"))([text]) == [len(words.encode(text, add_special_tokens=False).ids)]
    for ordinary in (False, True):
        assert byte_ids(text, specials=not ordinary).tolist() == library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"), ordinary).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("run", [" ", "\n", "x", "\u3000", "!"])
def test_very_long_runs(spark, run):
    text = f"begin <|endoftext|>{run * 1_200_000} end"
    library = library_tokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert byte_ids(text, specials=True).tolist() == library.encode(text, add_special_tokens=False).ids
    df = spark.createDataFrame([(1, text), (2, "short")], "doc_id bigint, text string")
    rows = pack(df).collect()
    assert sum(r.length for r in rows if r.doc_id == 1) == len(byte_ids(text, specials=True)) + 1
    turns = df.selectExpr("doc_id as conv_id", "1 as turn", "'assistant' as role", "text")
    back = {r.conv_id: r for r in read_back(format_chats(turns)).collect()}
    assert back[1].loss_chars == len(text) and back[1].loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    n = len(Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text, add_special_tokens=False).ids)
    assert {r.doc_id: r.n_tokens for r in count_tokens(df, shared_table(spark, "cache")).collect()}[1] == n


def test_token_counts_and_cache(spark, sf_dir, texts, odd):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = op10_token_counts(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(t.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    cache = shared_table(spark, "cache")
    first = sorted(count_tokens(odd, cache).collect(), key=str)
    size = spark.read.parquet(cache).count()
    assert size == len({x or "" for _, x in ODD}) and len(first) == len(ODD)
    assert sorted(count_tokens(odd, cache).collect(), key=str) == first and spark.read.parquet(cache).count() == size
    count_tokens(odd, cache, tokenizer="piece_bpe_32k.model").collect()
    assert spark.read.parquet(cache).count() == 2 * size
    assert count_tokens(odd.limit(0), shared_table(spark, "cache")).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
    return re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]


def test_urls(spark, sf_dir):
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()}
    rows = urls.op5_url_filter(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    right = []
    for r in rows:
        host, path = brute_url(pages[r.page_id])
        fit = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r.host, r.path) == (host, path) and r.rule == (max(fit)[2] if fit else None) and r.verdict in ("allow", "block")
        if fit:
            assert r.verdict == max(fit)[1]
            right.append((r.block_score >= 0.5) == (r.verdict == "block"))
    assert sum(right) > 0.9 * len(right)


def test_odd_urls(spark):
    odd = [None, "", "no scheme", "HTTP://WWW.Example.COM/en/71?x=1#y", "a://b://c/d", "x://h?q", "x://h#f", "x://ÀB.com/en/\n7", "://com/en/", "x://notcom/en/"]
    df = spark.createDataFrame(list(enumerate(odd)), "page_id int, url string").selectExpr("*", "1 as label", "'h' as host", "2 as _suffix")
    rows = {r.page_id: r for r in urls.judge_urls(df).collect()}
    assert {i: (rows[i].host, rows[i].path) for i in rows} == {i: brute_url(u) for i, u in enumerate(odd)}
    assert rows[3].rule == "example.com/en/7" and rows[8].rule == "com/en/" and rows[9].rule is None and rows[7].rule == "com/en/"
    assert urls.judge_urls(df.limit(0)).count() == 0


def test_each_rule_gives_the_verdict_of_the_contract(spark, tmp_path):
    want = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "allow", "example.net/de/8": "block", "org/es/": "block"}
    assert {h + p: v for v, h, p in urls.RULES} == want and len(urls.RULES) == len(want)
    made = [
        ("http://a.com/en/7", "com/en/"), ("http://COM/en/", "com/en/"), ("http://example.com/en/81", "com/en/"), ("http://www.example.com/en/7", "example.com/en/7"), ("http://EXAMPLE.com/en/71?x#y", "example.com/en/7"),
        ("http://net/de/", "net/de/"), ("http://a.b.net/de/8", "net/de/"), ("http://example.net/de/7", "net/de/"), ("http://notexample.net/de/8", "net/de/"), ("http://www.Example.NET/de/155?page=2", "net/de/"),
        ("http://example.net/de/8", "example.net/de/8"), ("http://m.example.net/de/83#top", "example.net/de/8"), ("http://a.org/es/", "org/es/"), ("http://example.org/es/7", "org/es/"),
        ("http://example.net/en/8", None), ("http://example.org/de/8", None), ("http://net.de/de/8", None), ("http://example.net?/de/8", None), (None, None),
    ]
    spark.createDataFrame([(i, u) for i, (u, _) in enumerate(made)], "page_id bigint, url string").write.parquet(f"{tmp_path}/pages.parquet")
    rows = {r.page_id: r for r in urls.op5_url_filter(spark, str(tmp_path)).collect()}
    assert [rows[i].rule for i in range(len(made))] == [rule for _, rule in made] and len(rows) == len(made)
    assert [rows[i].verdict for i, (_, rule) in enumerate(made) if rule] == [want[rule] for _, rule in made if rule]
    assert {rows[i].verdict for i, (_, rule) in enumerate(made) if not rule} <= {"allow", "block"}


def test_a_hot_url_does_not_fill_the_sample(spark):
    made = [f"http://a{i}.com/en/{i * i}?x={i}" for i in range(40)] + [f"http://b{i}.example.com/en/7{i}" for i in range(40)]
    first = spark.createDataFrame([(u,) for u in made], "url string").orderBy(F.xxhash64("url")).first().url
    rows = [(i, u) for i, u in enumerate([*made, *[first] * 100, "http://q.shop/fr/1"])]
    got = urls.judge_urls(spark.createDataFrame(rows, "page_id int, url string"), learned=40).collect()
    assert len(got) == len(rows) and len({r.block_score for r in got}) > 1
    assert all((r.block_score >= 0.5) == (r.verdict == "block") for r in got if r.rule)


def test_toxicity_finds_gapped_words(spark):
    rng = np.random.default_rng(0)
    part = ["ba", "ne", "tu", "ri", "so", "lem", "kan", "dor", "vi", "pel"]
    word = lambda: "".join(rng.choice(part, rng.integers(1, 4)))
    bad = ["idiot", "moron", "worthless", "pathetic", "scum"]
    rows = []
    for i in range(600):
        words = [word() for _ in range(40)]
        toxic = i % 3 == 0
        if toxic:
            words[rng.integers(0, 40)] = str(rng.choice(bad))
        rows.append((i, " ".join(words), int(toxic)))
    model = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))
    probe = ["banetu idi-ot solem", "you m o r o n there", "rikan worth_less", "banetu solem ri", "", None, "a path.etic dor"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(probe)), "doc_id int, text string"), model).collect()}
    assert min(got[i] for i in (0, 1, 2, 6)) > 0.3 > max(got[i] for i in (3, 4, 5))


def plain_kernel(a, b):
    """Common subsequences of 3 letters within 5 and of 4 within 6, each place weighing 0.65 per letter of its span, over both words' norms."""

    def places(w):
        w = f"\x02{w}\x03"
        for size, most in ((3, 5), (4, 6)):
            for at in itertools.combinations(range(len(w)), size):
                if (span := at[-1] - at[0] + 1) <= most:
                    yield (tuple(y - x for x, y in zip(at, at[1:], strict=False)), "".join(w[i] for i in at)), 0.65**span

    def table(w):
        out = defaultdict(float)
        for (_, letters), weight in places(w):
            out[letters] += weight
        return out, sum(x * x for _, x in places(w)) ** 0.5 or 1e-6

    (x, n), (y, m) = table(a), table(b)
    return sum(v * y[k] for k, v in x.items() if k in y) / n / m


@given(st.lists(st.text("abcé", min_size=1, max_size=9), min_size=2, max_size=6))
@settings(max_examples=100, deadline=None)
def test_string_kernel_is_the_plain_one(words):
    _, _, gram = toxicity.kernel(words, words[:2])
    assert np.allclose(gram, [[plain_kernel(a, b) for b in words[:2]] for a in words], atol=1e-9)


def test_toxicity_on_held_out_rows(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = toxicity.op4_toxicity(spark, sf).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [(r.score, labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    bad, good = [s for s, y, _ in held if y], [s for s, y, _ in held if not y]
    assert sum((b > g) + (b == g) / 2 for b in bad for g in good) / len(bad) / len(good) > 0.7
    assert sum(p for _, y, p in held if y) > 0.5 * len(bad) and sum(p for _, y, p in held if not y) < 0.1 * len(good)


def test_toxicity_survives_a_few_wrong_labels_and_spelled_words(spark):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(["ba", "ne", "tu", "ri", "so", "lem", "kan", "dor"], rng.integers(1, 4)))
    rows = []
    for i in range(600):
        words = [word() for _ in range(30)]
        if i % 3 == 0 or i % 40 == 1:  # some clean documents quote an insult
            words[int(rng.integers(0, 30))] = str(rng.choice(["idiot", "moron"]))
        rows.append((i, " ".join(words), int(i % 3 == 0)))
    model = toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))
    probe = ["you m. o. r. o. n. there", "so i  d  i  o  t lem", "x" * 15 + "moron" + "y" * 15, "banetu solem ri"]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(probe)), "doc_id int, text string"), model).collect()}
    assert min(got[0], got[1]) > 0.3 > got[3]


PARTS = ["ba", "ne", "tu", "ri", "so", "lem", "kan", "dor"]


def harmless_words_together(n, insult=("you", "dirty", "pig")):
    """Documents that are toxic exactly when a sentence says the insult; each of its words is in clean sentences too."""
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(PARTS, rng.integers(1, 4)))
    rows = []
    for i in range(n):
        said = [[word() for _ in range(8)] for _ in range(5)]
        for w in insult:
            said[int(rng.integers(5))][int(rng.integers(8))] = w
        if i % 3 == 0:
            said[int(rng.integers(5))][2:5] = insult
        rows.append((i, ". ".join(" ".join(s) for s in said) + ".", int(any(" ".join(insult) in " ".join(s) for s in said))))
    return rows


def learned(spark, rows):
    return toxicity.learn(spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id bigint, toxic int"))


def test_toxicity_of_harmless_words_together(spark):
    rows = harmless_words_together(900)
    model = learned(spark, rows[:600])
    unseen = [(i, x, y) for i, x, y in rows[600:]] + [(900, "so you d-i-r-t-y p!g kan ba", 1), (901, "you dirtyy pigg tu", 1), (902, "you are dirty. pig ba", 0), (903, "pig dirty you", 0)]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame([u[:2] for u in unseen], "doc_id bigint, text string"), model).collect()}
    assert np.mean([got[i] >= 0.3 for i, _, y in unseen if y]) > 0.95 and np.mean([got[i] >= 0.3 for i, _, y in unseen if not y]) < 0.05
    assert got[901] >= 0.3 > max(got[902], got[903])


def test_a_documents_score_is_that_of_its_highest_string_or_phrase(spark):
    rows = harmless_words_together(300)
    model = learned(spark, rows)
    weigh = toxicity.Weights(np.array(model["codes"], dtype=np.int64).view(np.uint64), np.array(model["values"]))
    gate = toxicity.Weights(np.array(model["gate_codes"], dtype=np.int64).view(np.uint64), np.array(model["gate_values"]))
    texts = [*(x for _, x, _ in rows[:40]), "you dirty pig", "you x dirty y pig", "you x y z dirty", "w. o. r. d", "", None, "dirty " * 50, "y" * 60 + " pig"]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), model).orderBy("doc_id").collect()]
    assert len(model["gate_codes"])
    for text, score in zip(texts, got, strict=True):
        said = toxicity.strings(text or "")
        for s in re.split(r"(?<=[.!?])\s+|\n+", (text or "").lower()):
            words = [w for w in re.findall(r"[^\W_](?:\S*[^\W_])?", s) if len(w) <= toxicity.WINDOW]
            for size in (2, 3):
                for at in itertools.combinations(range(len(words)), size):
                    if at[-1] - at[0] < toxicity.REACH and all(gate([words[i]])[0] >= toxicity.ALIKE for i in at):
                        said.add(" ".join(words[i] for i in at))
        best = max([weigh([w])[0] + model["bias"] for w in said], default=-3.0)
        assert abs(score - 1 / (1 + np.exp(-(np.clip(best, -3, 3) * model["slope"] + model["shift"])))) < 1e-9


def test_learning_is_bounded_in_rows_and_words(spark):
    rows = harmless_words_together(120)
    many = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string").union(spark.range(3000).selectExpr("cast(3 as bigint) as doc_id", "concat('other ', id) as text"))
    labels = spark.createDataFrame([(i, t) for i, _, t in rows] * 3, "doc_id bigint, toxic int")
    seen = spark.sparkContext.accumulator(0)
    plain = toxicity.fit

    def counted(documents, **how):
        seen.add(len(documents))
        return plain(documents, **how)

    toxicity.fit = counted
    try:
        toxicity.learn(many, labels)
    finally:
        toxicity.fit = plain
    assert seen.value == 120
    long = toxicity.learned_part("a b. " * 5000 + "c " * 1000)
    assert len(long.split("\n")) <= toxicity.SENTENCES and max(len(x.split()) for x in long.split("\n")) <= toxicity.SENTENCE_WORDS


def test_toxicity_without_labels(spark, odd):
    model = toxicity.learn(odd, spark.createDataFrame([], "doc_id bigint, toxic int"))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
