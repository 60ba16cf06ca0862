"""Byte-level BPE against the tiktoken library."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import bpe
from lectern.llm.bpe import MULTI, decode, encode, op13_byte_bpe, packed, ranks_encoding, unpacked

ODD = [(1, "a b c"), (2, ""), (3, None), (3, None), (None, "a b c"), (4, "x" * 70_000), (5, "w1 w2 " * 12_000), (6, "中文 é\x85 \x00 <|endoftext|> </s>"), (1, "a b c"), (7, "ࡰࡰ it'sࡰ  ﷐ x\n\n y"), (8, " " * 1_000_000 + "z"), (9, "ࡰ" + "\n" * 300_000)]


@given(st.lists(st.integers(0, 2**62), max_size=50))
@settings(deadline=None)
def test_packed_numbers_come_back(numbers):
    assert unpacked(packed(np.array(numbers, dtype=np.int64))).tolist() == numbers


def test_ids_are_the_librarys_and_decode_to_the_text(spark, sf_dir):
    own = ranks_encoding(MULTI)
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in op13_byte_bpe(spark, sf_dir).collect()}
    assert len(got) == len(rows)
    for r in rows:
        ids = own.encode_ordinary(r.text or "")
        assert got[r.doc_id].n_tokens == len(ids) and got[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[r.doc_id].decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@pytest.mark.parametrize("block", [1, 3, 1 << 22])
def test_odd_texts(spark, monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK_WORDS", block)
    df = spark.createDataFrame(ODD, "doc_id bigint, text string").selectExpr("*", "'k' as ids", "1 as pieces", "2 as block", "3 as target", "4 as packed")
    got = sorted(((r.doc_id, bytes(r.decoded), list(r.ids)) for r in decode(encode(df)).collect()), key=str)
    own = ranks_encoding(MULTI)
    spaces = {8: [*own._encode_single_piece(b" " * 999_999), *own.encode_ordinary(" z")], 9: [*own.encode_ordinary("ࡰ"), *own._encode_single_piece(b"\n" * 300_000)]}  # too long for the library's pattern
    assert got == sorted(((k, (x or "").encode(), spaces.get(k) or own.encode_ordinary(x or "")) for k, x in ODD), key=str)
    assert encode(df.limit(0)).count() == 0


def test_every_character_is_split_as_the_library_splits_it(spark):
    own = ranks_encoding(MULTI)
    chars = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rows = [(i, "".join(f"a{c}b {c} 1{c}2  {c}{c}.{c}'s" for c in chars[i : i + 256])) for i in range(0, len(chars), 256)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: list(r.ids) for r in encode(df).toLocalIterator()}
    assert [i for i, x in rows if got[i] != own.encode_ordinary(x)] == []


def test_decoding_refuses_unknown_ids_and_takes_none(spark):
    assert [bytes(r.decoded) for r in decode(spark.createDataFrame([([],), (None,)], "ids array<int>")).collect()] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary|bounds"):
        decode(spark.createDataFrame([([70_000],)], "ids array<int>")).collect()
