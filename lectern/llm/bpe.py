"""Byte-level BPE over a corpus: each distinct word is encoded once, and documents are put together from the ids of their words."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.tokens import byte_encoding, tokenizer_path
from lectern.operators.lineage import spread

MULTI = "byte_bpe_multi_50k.tiktoken"
#: Words of the documents that make a block; a longer document is a block of its own.
BLOCK_WORDS = 1 << 22
#: Words that are put together at a time.
WORDS_AT_ONCE = 1 << 18
#: Distinct words whose ids a task remembers; beyond that it begins anew.
WORDS_KEPT = 1 << 19
#: Rows that are encoded at a time; effort of the compression of what is shuffled.
ROWS_AT_ONCE, EFFORT = 16, 9


#: Begins a stretch that the library splits itself.  It is unassigned for ever, so no piece of a text without unassigned characters holds it.
UNSPLIT = "\ufdd0"


def _java(pattern: str) -> Column:
    """A pattern as Java writes it: there white space is ASCII unless asked for otherwise."""
    return F.lit(pattern.replace(r"\s", r"\p{IsWhite_Space}").replace(r"\S", r"\P{IsWhite_Space}"))


def split_pieces(text: Column) -> Column:
    """The pieces of a text that are encoded apart from each other; null has none.

    A character that this Java doesn't know may be a letter to the library.  A text that holds one is
    cut only beside white space, where pieces end in any case, and what lies between is marked with UNSPLIT.
    """
    import public_tokenizers

    apart = F.regexp_extract_all(text, _java(r"\s+(?!\S)|\s?\S+|\s+"), F.lit(0))
    marked = F.transform(apart, lambda s: F.when(s.rlike(r"\P{IsWhite_Space}"), F.concat(F.lit(UNSPLIT), s)).otherwise(s))
    found = F.when(text.rlike(r"\p{Cn}"), marked).otherwise(F.regexp_extract_all(text, _java(public_tokenizers.PATTERN), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def ranks_encoding(name: str):
    """The vocabulary of a ranks file without special tokens."""
    import public_tokenizers

    return byte_encoding(tokenizer_path(name), public_tokenizers.PATTERN, ())


def packed(numbers: np.ndarray) -> bytes:
    """Numbers in 7 bits a byte, lowest first, the high bit set on all but a number's last byte."""
    return b"".join(_packed(numbers[i : i + WORDS_AT_ONCE]) for i in range(0, len(numbers), WORDS_AT_ONCE))


def _packed(numbers: np.ndarray) -> bytes:
    n = numbers.astype(np.uint64)
    size = np.ones(len(n), dtype=np.int64)
    for k in range(1, 10):
        size += n >= np.uint64(1 << (7 * k))
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        here = np.flatnonzero(size > k)
        more = np.where(size[here] > k + 1, 128, 0)
        out[at[here] + k] = ((n[here] >> np.uint64(7 * k)) & np.uint64(127)).astype(np.uint8) | more.astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes, kind: type = np.int64) -> np.ndarray:
    """What :func:`packed` was given."""
    b, out, at = np.frombuffer(data, dtype=np.uint8), [np.zeros(0, dtype=kind)], 0
    while at < len(b):
        part = b[at : at + WORDS_AT_ONCE + 10]
        ends = np.flatnonzero(part < 128)  # the last number of a part may be cut off
        starts = np.r_[0, ends[:-1] + 1]
        part = part[: ends[-1] + 1]
        place = np.arange(len(part)) - np.repeat(starts, ends - starts + 1)
        out.append(np.add.reduceat((part & 127).astype(np.int64) << (7 * place), starts).astype(kind))
        at += len(part)
    return np.concatenate(out)


def small(*parts: bytes) -> bytes:
    """Parts, each behind its length, compressed."""
    body = b"".join(len(p).to_bytes(8, "little") + p for p in parts)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=EFFORT).compress(body, asbytes=True)


def large(data: bytes) -> list[bytes]:
    """The parts that :func:`small` was given."""
    body = pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)
    out, at = [], 0
    while at < len(body):
        size = int.from_bytes(body[at : at + 8], "little")
        out.append(body[at + 8 : at + 8 + size])
        at += 8 + size
    return out


def _block(number: int, keys: list[pa.Array], sizes: list[np.ndarray], pieces: list[pa.DictionaryArray], targets: int) -> Iterator[tuple]:
    """The rows of a block: its distinct words by where they go, then its documents as sequences of word numbers."""
    coded = pa.chunked_array(pieces, pieces[0].type).unify_dictionaries()
    words = coded.chunk(0).dictionary.cast(pa.binary())
    order = np.argsort(-sum(np.bincount(x.indices, minlength=len(words)) for x in coded.chunks), kind="stable")  # frequent words get small numbers
    rank = np.empty(len(words), dtype=np.int32)
    rank[order] = np.arange(len(words))
    sequence = b"".join(packed(rank[x.indices]) for x in coded.chunks)
    bucket = np.fromiter((zlib.crc32(w) % targets for w in words.to_pylist()), dtype=np.int64, count=len(words))[order]
    by = np.argsort(bucket, kind="stable")
    for mine in np.split(by, np.flatnonzero(np.diff(bucket[by])) + 1):
        if len(mine):
            own = words.take(pa.array(order[mine]))
            offsets = np.frombuffer(own.buffers()[1], dtype=np.int32, count=len(own) + 1)
            text = own.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]]
            yield int(bucket[mine[0]]), number, None, small(packed(np.diff(mine, prepend=0)), packed(np.diff(offsets)), text), None
    yield number % targets, number, pa.concat_arrays(keys), small(sequence), np.concatenate(sizes)


def encode(df: DataFrame, key: str = "doc_id", text: str = "text", ranks: str = MULTI) -> DataFrame:
    """One row per input row: the key as doc_id, and ids, as the tiktoken library encodes the text without special tokens.

    Texts are split by the vocabulary's pattern, each piece at its position, and the pieces of a
    block of documents make one row per distinct word and target, with the positions as numbers of
    words.  All rows of a word meet in one task, which encodes it once; its ids go back to the
    blocks, where the documents are put together by position.  A word is at most one row of a
    block, however often it occurs, so frequent words weigh no more than others.  Words of a target
    are packed into one value, so two shuffles move less than the texts.

    Null text: empty, no ids.  Repeated rows and repeated or null keys stay, an empty table gives none.
    """
    spark = df.sparkSession
    targets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = df.select(F.col(key)).schema[0].dataType
    pieces = df.select(F.col(key).alias("doc_id"), split_pieces(F.col(text)).alias("pieces"))
    schema = T.StructType([T.StructField("target", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("docs", T.ArrayType(kind)), T.StructField("packed", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 33
        held: tuple[list, list, list] = ([], [], [])
        words = 0

        def made() -> Iterator[pa.RecordBatch]:
            for target, block, docs, value, sizes in _block(number, *held, targets):
                whole = [pa.array([target], pa.int32()), pa.array([block], pa.int64())]
                lists = [pa.nulls(1, pa.list_(held[0][0].type)), pa.nulls(1, pa.list_(pa.int32()))]
                if docs is not None:
                    lists = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), pa.array(sizes, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*whole, lists[0], pa.array([value], pa.binary()), lists[1]], schema.names)

        for batch in batches:
            at = 0
            sizes = np.diff(batch.column(1).offsets.to_numpy())
            while at < len(sizes):
                room = np.searchsorted(np.cumsum(sizes[at:]), BLOCK_WORDS - words, side="right")
                end = min(len(sizes), at + max(int(room), 0 if words else 1))
                if end > at:
                    part = batch.slice(at, end - at)
                    held[0].append(part.column(0))
                    held[1].append(sizes[at:end])
                    held[2].append(part.column(1).flatten().dictionary_encode())
                    words += int(sizes[at:end].sum())
                    at = end
                if at < len(sizes):
                    yield from made()
                    number, held, words = number + 1, ([], [], []), 0
                    pa.default_memory_pool().release_unused()
        if held[0]:
            yield from made()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, mark = ranks_encoding(ranks), UNSPLIT.encode()
        kept: dict[bytes, bytes] = {}

        def ids_of(word: bytes) -> bytes:
            ids = own.encode_ordinary(word.removeprefix(mark).decode()) if word.startswith(mark) else own._encode_single_piece(word)
            return np.array(ids, dtype=np.int32).tobytes()

        for whole in batches:
            for at in range(0, len(whole), ROWS_AT_ONCE):
                batch, values = whole.slice(at, ROWS_AT_ONCE), []
                for is_words, value in zip(batch.column(2).is_null().to_pylist(), batch.column(3), strict=True):
                    if not is_words:
                        values.append(value)
                        continue
                    numbers, lengths, body = large(value.as_py())
                    found, begin = [], 0
                    if len(kept) > WORDS_KEPT:
                        kept.clear()
                    for end in np.cumsum(unpacked(lengths)).tolist():
                        word = body[begin:end]
                        ids = kept.get(word)
                        if ids is None:
                            ids = kept[word] = ids_of(word)
                        found.append(ids)
                        begin = end
                    flat = np.frombuffer(b"".join(found), dtype=np.int32)
                    values.append(small(numbers, packed(np.array([len(x) // 4 for x in found])), packed(flat)))
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(values, pa.binary()), batch.column(4)], schema.names)

    def assembled(rows: pa.Table) -> pa.Table:
        docs, sizes, sequence, parts = None, None, None, []
        for batch in rows.to_batches():
            for i, value in enumerate(batch.column("packed").to_pylist()):
                if batch.column("docs").is_valid()[i].as_py():
                    docs, sizes = batch.column("docs")[i].values, batch.column("sizes")[i].values.to_numpy()
                    sequence = unpacked(large(value)[0], np.int32)
                else:
                    parts.append(large(value))
        numbers = [np.cumsum(unpacked(n)) for n, _, _ in parts]
        count = np.zeros(sum(map(len, numbers)), dtype=np.int32)
        for n, (_, c, _) in zip(numbers, parts, strict=True):
            count[n] = unpacked(c)
        begin = np.cumsum(count, dtype=np.int64) - count
        ids = np.zeros(int(count.sum()), dtype=np.int32)
        for n, (_, _, flat) in zip(numbers, parts, strict=True):
            ids[_spans(begin[n], count[n])] = unpacked(flat, np.int32)
        out, edges, at = [], np.r_[0, np.cumsum(sizes)], 0
        while at < len(sizes):
            end = max(at + 1, int(np.searchsorted(edges, edges[at] + WORDS_AT_ONCE, side="right")) - 1)
            said = sequence[edges[at] : edges[end]]
            size = np.r_[0, np.cumsum(count[said])]
            values = pa.array(ids[_spans(begin[said], count[said])], pa.int32())
            out.append(pa.Table.from_arrays([docs[at:end], pa.ListArray.from_arrays(pa.array(size[edges[at : end + 1] - edges[at]], pa.int32()), values)], ["doc_id", "ids"]))
            at = end
        return pa.concat_tables(out)

    result = T.StructType([T.StructField("doc_id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    sent = pieces.mapInArrow(blocks, schema).repartitionById(targets, F.col("target"))
    return sent.mapInArrow(encoded, schema).groupBy("block").applyInArrow(assembled, result)


def _spans(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    ends = np.cumsum(count, dtype=np.int64)
    return np.repeat(begin - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def token_bytes(name: str = MULTI) -> pa.Array:
    """The token-byte table: the bytes of each id, in order of ids; null where there is none."""
    own = ranks_encoding(name)
    table: list[bytes | None] = [None] * (own.max_token_value + 1)
    for word, i in own._mergeable_ranks.items():
        table[i] = word
    return pa.array(table, pa.binary())


def decode(df: DataFrame, ids: str = "ids", ranks: str = MULTI) -> DataFrame:
    """``df`` with decoded: the bytes of its ids, one after the other.

    Each id is joined with the token-byte table.  That has one row per entry of the vocabulary, so
    every task holds it, and nothing is shuffled.  Null or no ids: no bytes.  An id that the table lacks is an error.
    """
    carried = df.select(F.struct(*[df[c] for c in df.columns]).alias("_row"))  # ids go along once, within the row
    place = df.columns.index(ids)
    schema = T.StructType([carried.schema["_row"], T.StructField("decoded", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            lists, at = batch.column(0).flatten()[place], 0
            edges = np.r_[0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]
            flat = lists.flatten()
            while at < len(lists):
                end = max(at + 1, int(np.searchsorted(edges, edges[at] + 4 * WORDS_AT_ONCE, side="right")) - 1)
                found = table.take(flat[edges[at] : edges[end]])
                if found.null_count:
                    raise ValueError("an id is not in the vocabulary")
                decoded = pa.array([b""] * (end - at), pa.binary())
                if len(found):
                    cut = np.frombuffer(found.buffers()[1], dtype=np.int32, count=len(found) + 1)[edges[at : end + 1] - edges[at]]
                    decoded = pa.Array.from_buffers(pa.binary(), end - at, [None, pa.py_buffer(np.ascontiguousarray(cut)), found.buffers()[2]])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, end - at), decoded], schema.names)
                at = end

    return carried.mapInArrow(run, schema).select("_row.*", "decoded")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents and what they decode to; null text: empty, repeated rows each, no rows of an empty table."""
    found = decode(encode(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
    listed = F.array_join(F.col("ids").cast("array<string>"), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
