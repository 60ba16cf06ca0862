"""Packing documents into training sequences by context-size tiers."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import gapless, saved
from lectern.llm.tokens import byte_ids
from lectern.operators.lineage import spread

END_ID = 1
#: Context sizes, each with sequences of its own.
TIERS = (128, 512, 2048)
#: The plan's time grows with the square of the longest tier.
LONGEST = 1 << 13
PIECES = "doc_id {key}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


def cut(df: DataFrame, window: int, key: str = "doc_id", text: str = "text", carried: dict[str, Column] | None = None) -> DataFrame:
    """The pieces of each row's token ids: whole windows, then the tail; ``carried`` are further columns, which each piece repeats.

    Ids are those of byte_bpe_50k (a special string inside a text counts as its special id), then
    END_ID; so an empty or null text has one.
    """
    rows = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"), *[c.alias(n) for n, c in (carried or {}).items()])
    others = "".join(f", {f.name} {f.dataType.simpleString()}" for f in rows.schema[2:])

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            owner, rows = [], []
            for n, body in enumerate(batch.pop("_text")):
                ids = np.append(byte_ids(body, specials=True), END_ID).astype("<u4")
                for at in range(0, len(ids), window):
                    piece = ids[at : at + window]
                    owner.append(n)
                    rows.append((at, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            numbers = np.array(rows, dtype=np.int64).reshape(-1, 4)
            own = batch.take(owner).reset_index(drop=True)
            made = {"doc_id": own.pop("doc_id")} | {c: numbers[:, i] for i, c in enumerate(("start", "length", "ids_crc32", "doc_tokens"))}
            yield pd.DataFrame(made | {c: own[c] for c in own.columns})

    return rows.mapInPandas(encode, PIECES.format(key=rows.schema["doc_id"].dataType.simpleString()) + others)


class Layout:
    """Where the n-th piece of each length goes, planned on how many pieces each length has.

    A piece's tier is the least context size that holds it.  The longest tier is packed first, into
    sequences of its own size: a sequence is opened with the longest piece of the tier, and its gap
    is filled with the longest piece that fits, of the same tier or else of a shorter one.  Then the
    next tier is packed, with what the longer ones left, into sequences of its own, shorter size.
    Only a sequence of the longest size may stay unfilled, as it is padded to that size in any
    case; where a shorter one can't be filled, its first pieces are held back, and in the end those
    held back fill sequences of the longest size.  Sequences that are composed alike are planned
    together, so the plan depends on the number of lengths (at most the longest tier), not of pieces.
    """

    def __init__(self, counts: dict[int, int], tiers: tuple[int, ...] = TIERS, group: int = 64):
        if not tiers or list(tiers) != sorted(set(tiers)) or any(t & (t - 1) for t in tiers) or not 1 <= tiers[-1] <= LONGEST:
            raise ValueError(f"tiers must be ascending powers of two, {LONGEST} at most")
        self.left = {n: c for n, c in counts.items() if c > 0}
        self.mask = sum(1 << n for n in self.left)
        self.made: list[tuple[int, int, tuple[int, ...]]] = []
        longest, held = tiers[-1], {}
        for tier, shorter in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
            self._pack(tier, shorter, None if tier == longest else held)
        for n, c in held.items():
            self.left[n] = c
            self.mask |= 1 << n
        self._pack(longest, 0, None)
        # Alike sequences by cost (attention grows with the square of a piece); dealt to steps in a snake.
        self.made.sort(key=lambda x: -sum(n * n for n in x[2]))
        self.sequences = sum(times for times, _, _ in self.made)
        self.steps = max(1, -(-self.sequences // group))
        rank: dict[int, int] = {}
        rows, begin = [], 0
        for times, size, parts in self.made:
            at, slots = 0, {}
            for n in parts:
                slots.setdefault(n, []).append(at)
                at += n
            for n, ats in slots.items():
                for offset in ats:
                    rows.append((n, rank.get(n, 0), begin, offset, size))
                    rank[n] = rank.get(n, 0) + times
            begin += times
        table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
        self.keys, self.first, self.begin, self.offset, self.size = (table[:, 0] << 42) + table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def _pack(self, size: int, above: int, held: dict[int, int] | None) -> None:
        """Sequences of this size for the pieces over ``above``; with ``held``, only filled ones."""
        own = ((1 << (size + 1)) - 1) & ~((1 << (above + 1)) - 1)
        while self.mask & own:
            first = (self.mask & own).bit_length() - 1
            used, parts, gap = {first: 1}, [first], size - first
            while gap and (n := self._best(used, gap)):
                used[n] = used.get(n, 0) + 1
                parts.append(n)
                gap -= n
            if gap and held is not None:
                held[first] = held.get(first, 0) + self.left[first]
                self._take(first, self.left[first])
                continue
            times = min(self.left[n] // k for n, k in used.items())
            for n, k in used.items():
                self._take(n, k * times)
            self.made.append((times, size, tuple(parts)))

    def _take(self, n: int, count: int) -> None:
        self.left[n] -= count
        if not self.left[n]:
            self.mask &= ~(1 << n)

    def _best(self, used: dict[int, int], gap: int) -> int:
        """The longest length that fits and is left; a pair that fills the gap whole goes before it.  0 if none fits."""
        free = self.mask & ((1 << (gap + 1)) - 1)
        for n, k in used.items():
            if self.left[n] <= k:
                free &= ~(1 << n)
        longest = free.bit_length() - 1 if free else 0
        more = free
        for _ in range(64):
            n = more.bit_length() - 1
            if n <= 0:
                break
            if n == gap or (free >> (gap - n) & 1 and (gap - n != n or self.left[n] > used.get(n, 0) + 1)):
                return n
            more &= ~(1 << n)
        return longest

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """sequence_id, offset, the sequence's size, step."""
        at = np.searchsorted(self.keys, (length << 42) + rank, side="right") - 1
        sequence = self.begin[at] + rank - self.first[at]
        turn, place = np.divmod(sequence, self.steps)
        return sequence, self.offset[at], self.size[at], np.where(turn % 2, self.steps - 1 - place, place)


def pack(df: DataFrame, tiers: tuple[int, ...] = TIERS, key: str = "doc_id", text: str = "text", group: int = 64) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, sequence_size, step.

    ``tiers`` are ascending powers of two.  Documents are cut only where they are longer than the
    last; a piece's tier is the least that holds it, and :class:`Layout` says how each tier is packed
    and how shorter ones fill the gaps of longer.  Sequences of shorter sizes are full.  Steps take up
    to ``group`` sequences of about the same total cost.  Of a corpus the driver gets one number for
    each length up to the last tier; the plan made from them is as bounded.  Null text: empty, one
    token.  Rows that repeat are packed each for itself; an empty table gives none.
    """
    tiers = tuple(tiers)
    Layout({}, tiers, group)  # refuses tiers that can't be packed before anything is read
    pieces = saved(cut(df, tiers[-1], key, text))
    layout = Layout({r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}, tiers, group)
    ranked = gapless(pieces, "length", ["doc_id", "start", "ids_crc32"], "_rank")
    kind = pieces.schema["doc_id"].dataType.simpleString()
    sizes = np.array(tiers)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            length = b["length"].to_numpy()
            sequence, offset, size, step = layout.place(length, b.pop("_rank").to_numpy())
            yield b.assign(sequence_id=sequence, offset=offset, tier=sizes[np.searchsorted(sizes, length)], sequence_size=size, step=step)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    return ranked.select(*names, "_rank").mapInPandas(place, PIECES.format(key=kind) + ", sequence_id bigint, offset bigint, tier bigint, sequence_size bigint, step bigint")


def pack_in_order(df: DataFrame, unit: Column, at: Column, tiers: tuple[int, ...] = TIERS, key: str = "doc_id", text: str = "text", group: int = 64) -> DataFrame:
    """As :func:`pack`, but each ``unit`` by itself, with its pieces in the order of ``at``, and never two copies of a piece in one sequence.

    Of the pieces of one length, those that come first go to the first places.  Copies of a piece
    (same document and place in it, same ids) are told apart by their order; all first ones of a unit
    are packed together, then all second ones, and so on, so copies never share a sequence.  A unit
    is one task's work and should have a bounded number of rows; the driver gets two numbers of each.
    """
    tiers = tuple(tiers)
    Layout({}, tiers, group)
    pieces = cut(df, tiers[-1], key, text, {"_unit": unit, "_at": at})
    kind = pieces.schema["doc_id"].dataType.simpleString()
    places = "sequence_id bigint, offset bigint, tier bigint, sequence_size bigint, step bigint"
    sizes = np.array(tiers)

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_at", "start"], kind="stable", ignore_index=True)
        wave = rows.groupby(["doc_id", "start", "ids_crc32"], dropna=False, sort=False).cumcount()
        out, sequences, steps = [], 0, 0
        for _, own in rows.groupby(wave.to_numpy(), sort=True):
            layout = Layout(own["length"].value_counts().to_dict(), tiers, group)
            length = own["length"].to_numpy()
            sequence, offset, size, step = layout.place(length, own.groupby("length", sort=False).cumcount().to_numpy())
            out.append(own.drop(columns="_at").assign(sequence_id=sequence + sequences, offset=offset, tier=sizes[np.searchsorted(sizes, length)], sequence_size=size, step=step + steps))
            sequences, steps = sequences + layout.sequences, steps + layout.steps
        return pd.concat(out, ignore_index=True)

    packed = saved(pieces.groupBy("_unit").applyInPandas(place, PIECES.format(key=kind) + f", _unit {pieces.schema['_unit'].dataType.simpleString()}, {places}"))
    ends = sorted(packed.groupBy("_unit").agg(F.max("sequence_id") + 1, F.max("step") + 1).collect())
    begins, sequences, steps = [], 0, 0
    for name, more, turns in ends:
        begins.append((name, sequences, steps))
        sequences, steps = sequences + more, steps + turns
    first = df.sparkSession.createDataFrame(begins, T.StructType([pieces.schema["_unit"], T.StructField("_sequences", T.LongType()), T.StructField("_steps", T.LongType())]))
    moved = packed.join(F.broadcast(first), "_unit").withColumns({"sequence_id": F.col("sequence_id") + F.col("_sequences"), "step": F.col("step") + F.col("_steps")})
    return moved.drop("_unit", "_sequences", "_steps")


#: Rows of a file that are packed together.
UNIT_ROWS = 1 << 16


def pack_files(df: DataFrame, **how) -> DataFrame:
    """:func:`pack_in_order` for a table read from Parquet: each file in its order, UNIT_ROWS rows at a time; :func:`pack` for any other table.

    So what was dealt to a file and shuffled in it stays together, in that order.
    """
    try:
        df.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return pack(df, **how)
    row = F.col("_metadata.row_index")
    return pack_in_order(df, F.concat_ws(":", "_metadata.file_path", F.shiftright(row, UNIT_ROWS.bit_length() - 1).cast("string")), row, **how)


def op7_tiered_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 128, 512 and 2,048 tokens, one row per piece; null text: empty, repeated rows each packed, no rows of an empty table."""
    return pack(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")))
