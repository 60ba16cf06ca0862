"""Periodic runs of words within a text, found by internal pattern matching."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WORD
from lectern.llm.repetition import FIND, WORDS_AT_ONCE, suffix_ranks
from lectern.operators.lineage import spread

#: A run has at least so many words, and so many times its period.
LEAST, EXPONENT = 6, 4


class WaveletTree:
    """Distinct numbers below their count, in a given order: how many of a range are less than one, and which is the n-th least.  All queries are vectors."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        for bit in range(max(1, (len(values) - 1).bit_length()) - 1, -1, -1):
            one = (values >> bit & 1).astype(bool)
            zeros = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~one, out=zeros[1:])
            self.levels.append((bit, zeros, int(zeros[-1])))
            values = np.concatenate([values[~one], values[one]])

    def less(self, left: np.ndarray, right: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values in [left, right) are less than ``than``."""
        found = np.zeros(len(left), dtype=np.int64)
        for bit, zeros, ones_at in self.levels:
            a, b = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = (than >> bit & 1).astype(bool)
            found += np.where(one, b - a, 0)
            left, right = np.where(one, ones_at + left - a, a), np.where(one, ones_at + right - b, b)
        return found

    def nth(self, left: np.ndarray, right: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The value of [left, right) that ``n`` others of it are less than."""
        found = np.zeros(len(left), dtype=np.int64)
        for bit, zeros, ones_at in self.levels:
            a, b = zeros[left].astype(np.int64), zeros[right].astype(np.int64)
            one = n >= b - a
            n = n - np.where(one, b - a, 0)
            found |= one.astype(np.int64) << bit
            left, right = np.where(one, ones_at + left - a, a), np.where(one, ones_at + right - b, b)
        return found


def candidates(levels: list[np.ndarray], begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period): for each block of 2**k words whose text has it again at most 2**k words before or behind, the first of the two places and their distance.

    Blocks lie at multiples of their size.  Those that begin like a block are a range of the suffix
    array; within it the tree gives the nearest ones before and behind.  Places of a block in so
    small a neighbourhood form a progression, whose step is its period.  A run of L words with
    period q and L >= 4 q holds a whole block of more than L / 4 words, and so of q at least, and has
    room for the block q words before or behind; it can't occur nearer, as q is the least period.
    """
    n = len(begins)
    at = np.arange(n)
    if len(levels) < 3:  # no two words together occur twice
        return at[:0], at[:0]
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = at
    again = np.bincount(levels[1], minlength=n)[levels[1]] > 1
    inside = np.r_[0, np.cumsum(again[order])]  # of the suffix array only what occurs twice is kept
    places = np.flatnonzero(again)
    number = np.cumsum(again) - 1
    tree = WaveletTree(number[order[again[order]]])
    offset, xs, ds = at - begins, [], []
    for k, rank in enumerate(levels[1:], 1):
        size = 1 << k
        at = at[(offset[at] & (size - 1)) == 0]
        ties = np.bincount(rank, minlength=n)
        blocks = at[(at + size <= ends[at]) & (ties[rank[at]] > 1)]
        left = rank[blocks].astype(np.int64)
        left, right = inside[left], inside[left + ties[left]]
        before = tree.less(left, right, number[blocks])
        for near, there in ((before + 1, before + 1 < right - left), (before - 1, before > 0)):
            p = blocks[there]
            q = places[tree.nth(left[there], right[there], near[there])]
            close = np.abs(q - p) <= size
            xs.append(np.minimum(p, q)[close])
            ds.append(np.abs(q - p)[close])
    return np.concatenate(xs), np.concatenate(ds)


def find_runs(words: np.ndarray, begins: np.ndarray, ends: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start, then period, each within its text.

    Each candidate is extended as far as its period holds, to either side, by steps of halving powers
    of two that compare ranks.
    """
    levels = suffix_ranks(words, ends)
    x, d = candidates(levels, begins, ends)
    pairs = np.unique(np.c_[x, d], axis=0) if len(x) else np.zeros((0, 2), dtype=np.int64)
    x, d = pairs[:, 0], pairs[:, 1]
    n, begin, end = len(words), begins[x], ends[x]
    behind, before = np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        rank, size = levels[k], 1 << k
        a = x + behind
        there = a + d < end
        behind += np.where(there & (rank[np.minimum(a, n - 1)] == rank[np.minimum(a + d, n - 1)]), size, 0)
        a = x - before - size
        there = a >= begin
        a = np.maximum(a, 0)
        before += np.where(there & (rank[a] == rank[np.minimum(a + d, n - 1)]), size, 0)
    start, end = x - before, x + d + behind
    long = end - start >= np.maximum(least, exponent * d)
    found = np.unique(np.c_[start, end, d][long], axis=0)
    found = found[np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)][: len(found)]]  # the least period of a stretch
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    return found[:, 0], found[:, 1], found[:, 2]


def _measured(texts: list[str], least: int, exponent: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(runs of each text, (start, length, period) of all, collapsed texts)."""
    said = [FIND(t) for t in texts]
    sizes = np.array([len(x) for x in said], dtype=np.int64)
    edges = np.r_[0, np.cumsum(sizes)]
    words = pd.factorize(np.array([w for x in said for w in x], dtype=object))[0]
    start, end, period = find_runs(words, np.repeat(edges[:-1], sizes), np.repeat(edges[1:], sizes), least, exponent)
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, end, -1)
    kept = np.cumsum(edge[:-1]) == 0
    text = np.searchsorted(edges, start, side="right") - 1
    collapsed = []
    for i, own in enumerate(said):
        keep = kept[edges[i] : edges[i + 1]]
        collapsed.append(" ".join(own if keep.all() else compress(own, keep)))
    return np.bincount(text, minlength=len(texts)), np.c_[start - edges[text], end - start, period], collapsed


def periodic_runs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, exponent: int = EXPONENT) -> DataFrame:
    """One row per input row: the key as doc_id, runs, and the collapsed text.

    A run is a stretch of at least ``least`` words and ``exponent`` (4 or more) times its least
    period that no neighbouring word extends; runs are structs of start (word number), length and
    period, by start, then period.  Collapsed are the words that no run contains behind its first
    period, joined by one space.  Null and empty texts have no words and no runs.  Repeated rows stay;
    an empty table gives none.  Texts are worked on whole, a batch at a time, so nothing is shuffled;
    memory and time grow with the longest text as n log n.
    """
    if least < 2 or exponent < 4:
        raise ValueError("runs have at least 2 words and 4 periods")
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("doc_id", rows.schema["doc_id"].dataType), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, tables, collapsed, begin, size = batch.column(1).to_pylist(), [], [], [], 0, 0
            for i, t in enumerate(texts, 1):
                size += len(t) // 5
                if size > WORDS_AT_ONCE or i == len(texts):
                    c, table, short = _measured(texts[begin:i], least, exponent)
                    counts.append(c)
                    tables.append(table)
                    collapsed += short
                    begin, size = i, 0
            numbers = np.concatenate(tables) if tables else np.zeros((0, 3), dtype=np.int64)
            offsets = np.r_[0, np.cumsum(np.concatenate(counts))] if counts else [0]
            structs = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(numbers[:, i])) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs), pa.array(collapsed, pa.string())], schema.names)

    return rows.mapInArrow(find, schema)


def with_loops(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text): every tenth text, by the checksum h of its key, repeats words from word a on: word i is word a + (i - a) % p, with g = floor(h / 10), a = g % n and p = 1 + floor((n - a) / (3 + g % 8))."""
    h = F.crc32(F.encode(F.col(key).cast("string"), "UTF-8"))
    words = F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))
    looped = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.floor(h / 10).alias("g"), F.when(h % 10 == 0, words).alias("w")).withColumn("n", F.size("w").cast("long"))
    looped = looped.withColumn("a", F.expr("g % n")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    made = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.expr("a") + (i - F.col("a")) % F.col("p")).cast("int"))), " ")
    return looped.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of all documents, a tenth of which loop; null and empty texts have none, repeated rows each, no rows of an empty table, and a null id never loops."""
    found = periodic_runs(with_loops(spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start, r.length, r.period)), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div (-best.period)").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


#: The checksum is worked out bit by bit; equal words at each distance give stretches.
OP12_SQL = """
WITH said AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w,
    xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
        lambda c, b: CASE WHEN xor(c, b) & 1 = 1 THEN xor(xor(c, b) >> 1, 3988292384) ELSE xor(c, b) >> 1 END), 4294967295) AS h FROM documents),
sized AS (SELECT *, len(w) AS n, h // 10 AS g FROM said),
placed AS (SELECT *, g % greatest(n, 1) AS a, 1 + (n - g % greatest(n, 1)) // (3 + g % 8) AS p FROM sized),
looped AS (SELECT r, doc_id, n, CASE WHEN h % 10 = 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM placed),
words AS (SELECT r, n, unnest(w) AS word, unnest(range(n)) AS i FROM looped),
alike AS (SELECT x.r, x.i, y.i - x.i AS d FROM words x JOIN words y ON x.r = y.r AND x.word = y.word AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretch AS (SELECT r, d, i, i - row_number() OVER (PARTITION BY r, d ORDER BY i) AS s FROM alike),
periods AS (SELECT r, d, min(i) AS start, count(*) + d AS length FROM stretch GROUP BY r, d, s HAVING count(*) + d >= greatest(6, 4 * d)),
runs AS (SELECT r, start, length, min(d) AS period FROM periods GROUP BY r, start, length),
listed AS (SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines,
    arg_max({'start': start, 'length': length, 'period': period}, {'length': length, 'start': -start, 'period': -period}) AS best FROM runs GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS body FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, best.start AS start, best.length AS length, best.period AS period, 1000 * best.length // best.period AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(body, '')) AS collapsed_sha256
FROM looped LEFT JOIN listed USING (r) LEFT JOIN kept USING (r)
"""
