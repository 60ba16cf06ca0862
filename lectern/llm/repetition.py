"""Quality rules on repetition within a text, from a suffix array over its words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import WORD
from lectern.operators.lineage import spread

FIND = re.compile(WORD).findall
HAS_WORD = re.compile(WORD).search
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
#: Words whose suffixes are sorted together; a longer text is sorted by itself.
WORDS_AT_ONCE = 300_000

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "repeat_words", "longest_repeat", "n_maximal")


def suffix_ranks(words: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """For each k the ranks of all positions by the 2**k words from there, up to the first k at which none are tied.

    ``words`` holds the word ids of several texts in a row, ``ends`` for each position the end of its
    text.  Texts don't tie with each other.  A rank is the number of positions that come before its
    tie, so the last ranks give the suffix array.  Doubling sorts only what is still tied.
    """
    n = len(words)
    width = int(words.max(initial=0)) + 1
    key = ends.astype(np.int64) * width + words
    order = np.argsort(key, kind="stable")
    fresh = np.r_[True, key[order][1:] != key[order][:-1]][:n]
    starts = np.flatnonzero(fresh)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = starts[np.cumsum(fresh) - 1]
    levels, k = [rank], 1
    tied = np.sort(order[~(fresh & np.r_[fresh[1:], True][:n])])
    while len(tied):
        ahead = tied + k
        follow = np.where(ahead < ends[tied], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        own = rank[tied].astype(np.int64)
        by = np.argsort(own * (n + 2) + follow, kind="stable")
        own, follow, tied = own[by], follow[by], tied[by]
        group = np.r_[True, own[1:] != own[:-1]]
        part = group | np.r_[True, follow[1:] != follow[:-1]]
        place = np.arange(len(tied))
        first = lambda marks: np.maximum.accumulate(np.where(marks, place, 0))
        rank = rank.copy()
        rank[tied] = own + first(part) - first(group)
        tied = tied[~(part & np.r_[part[1:], True])]
        levels.append(rank)
        k *= 2
    return levels


def longest_repeats(words: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each position, the length of the longest run of words from there that begins elsewhere in the same text too.

    The common prefix of neighbours in the suffix array comes from the ranks of all doublings.
    """
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.int64)
    levels = suffix_ranks(words, ends)
    order = np.empty(n, dtype=np.int64)
    order[levels[-1]] = np.arange(n)
    a, b = order[:-1], order[1:]
    same = ends[a] == ends[b]
    a, b = a[same], b[same]
    common = np.zeros(len(a), dtype=np.int64)
    for level in range(len(levels) - 1, -1, -1):
        x, y = a + common, b + common
        inside = (x < ends[a]) & (y < ends[b])
        x, y = np.minimum(x, n - 1), np.minimum(y, n - 1)
        common += np.where(inside & (levels[level][x] == levels[level][y]), 1 << level, 0)
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, a, common)
    np.maximum.at(out, b, common)
    return out


def covered(spans: np.ndarray, least: int) -> np.ndarray:
    """Which positions lie in a span of ``least`` words or more; spans has the length that begins at each position."""
    begin = np.flatnonzero(spans >= least)
    edge = np.zeros(len(spans) + 1, dtype=np.int64)
    np.add.at(edge, begin, 1)
    np.add.at(edge, begin + spans[begin], -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str], window: int, least: int) -> np.ndarray:
    """COUNTS of each text."""
    found = [FIND(t) for t in texts]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    out = np.zeros((len(texts), len(COUNTS)), dtype=np.int64)
    out[:, 0] = sizes
    for i, text in enumerate(texts):
        out[i, 1] = len(text) - sum(map(text.count, SPACES))
        out[i, 2] = sum(map(text.count, SYMBOLS))
        lines = text.split("\n")
        if len(lines) > len(set(lines)):
            lines = [x for x in lines if HAS_WORD(x)]
            out[i, 3] = len(lines) - len(set(lines))
    if not sizes.sum():
        return out
    words = pd.factorize(np.array([w for x in found for w in x], dtype=object))[0]
    del found
    starts = np.r_[0, np.cumsum(sizes)]
    repeats = longest_repeats(words, np.repeat(starts[1:], sizes))
    full = np.flatnonzero(sizes)
    sums = lambda x: np.add.reduceat(x.astype(np.int64), starts[full])
    out[full, 4] = sums(covered(repeats, window))
    out[full, 5] = sums(covered(repeats, least))
    out[full, 6] = np.maximum.reduceat(repeats, starts[full])
    begins = np.r_[True, repeats[1:] >= repeats[:-1]]
    begins[starts[full]] = True
    out[full, 7] = sums((repeats >= least) & begins)
    return out


def _measured(df: DataFrame, carried: Column, text: str, window: int, least: int) -> DataFrame:
    """``carried`` as _row beside COUNTS."""
    rows = df.select(carried.alias("_row"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    schema = T.StructType([T.StructField("_row", rows.schema["_row"].dataType), *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, parts, begin, size = batch.column(1).to_pylist(), [], 0, 0
            for i, t in enumerate(texts):
                size += len(t) // 5
                if size > WORDS_AT_ONCE:
                    parts.append(measure(texts[begin : i + 1], window, least))
                    begin, size = i + 1, 0
            parts.append(measure(texts[begin:], window, least))
            counts = np.concatenate(parts)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(counts[:, i]) for i in range(len(COUNTS))]], ["_row", *COUNTS])

    return rows.mapInArrow(run, schema)


def _judged(measured: DataFrame, most_covered: float, longest: int, least_words: int) -> DataFrame:
    share = lambda c: F.col(c) * 1000 > F.col("n_words") * round(1000 * most_covered)
    return (
        measured.withColumn("base_failed", (F.col("n_words") < least_words) | share("n_repeat_words"))
        .withColumn("kept", ~(F.col("base_failed") | share("repeat_words") | (F.col("longest_repeat") > longest)))
    )


def repetition_rules(df: DataFrame, key: str = "doc_id", text: str = "text", window: int = 8, least: int = 5, most_covered: float = 0.3, longest: int = 200, least_words: int = 20) -> DataFrame:
    """One row per input row: the key as doc_id, the COUNTS, base_failed and kept.

    repeat_words is how many words the union of all maximal repeated runs of ``least`` words or more
    covers, n_maximal how many begin a run that can't be extended to the left, longest_repeat the
    longest one.  A text is kept unless it fails the base rules (fewer than ``least_words`` words,
    or over ``most_covered`` of its words in ``window``-word windows that occur twice), or its
    maximal repeats cover over ``most_covered`` of it, or one is over ``longest`` words long.
    Null and empty texts have no words and fail.  Repeated rows stay; an empty table gives none.
    """
    return _judged(_measured(df, F.col(key), text, window, least), most_covered, longest, least_words).withColumnRenamed("_row", "doc_id")


def without_repetition(df: DataFrame, text: str = "text", window: int = 8, least: int = 5, most_covered: float = 0.3, longest: int = 200, least_words: int = 20) -> DataFrame:
    """The rows of ``df`` that :func:`repetition_rules` keeps, with all their columns; they pass through the tasks, so nothing is joined."""
    return _judged(_measured(df, F.struct(*[df[c] for c in df.columns]), text, window, least), most_covered, longest, least_words).where("kept").select("_row.*")


def op8_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdicts of all documents; null and empty texts have no words and fail, repeated rows are judged each, no rows of an empty table."""
    found = repetition_rules(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "repeat_words", "longest_repeat")
