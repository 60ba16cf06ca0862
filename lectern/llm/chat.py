"""Chat formatting on token level."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.tokens import byte_bpe_50k, byte_ids

#: Reserved ids, above those of byte_bpe_50k, and how they read in the formatted text.
TURN, BODY, END = 50257, 50258, 50259
MARKS = {TURN: "<|turn|>", BODY: "<|body|>", END: "<|end|>"}
#: Strings that some chat template gives a meaning; inside a text their first character is followed by a backslash.
CONTROL = ("<|", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join([r"\\", *map(re.escape, CONTROL)]))


def escape(text: str) -> str:
    """``text`` without control strings: a backslash goes before each backslash and into each control string behind its first character."""
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    """What :func:`escape` was given: each backslash stands for the character behind it."""
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def _kind(df: DataFrame, name: str) -> str:
    return df.select(F.col(name)).schema[0].dataType.simpleString()


def _same(a, b) -> bool:
    return a == b or (pd.isna(a) and pd.isna(b))


def format_chats(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per turn, in order within each conversation: conv_id, position, ids, loss_mask, token_offset, char_offset, formatted.

    A turn's ids are TURN, the role's, BODY, the text's, END.  Segments are encoded apart from each
    other and never as special ids, so a text can't make a reserved id; control strings in roles and
    texts are escaped besides.  The mask is 1 on the text's ids of the roles in ``trained``: the
    prefix sum of +1 where the segment begins and -1 behind it.  Offsets are prefix sums over the
    conversation, so its sequence is the concatenation of its rows.  Null role or text: empty.  Turns
    that repeat a number are ordered by role and text.  Null conversation ids are one conversation.
    Tasks hold one batch of turns at a time, however long a conversation is.  An empty table gives none.
    """
    turns = df.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = lambda text: byte_ids(text).tolist()
        last, position, tokens, chars = run, 0, 0, 0
        for batch in batches:
            rows = []
            for c, r, t in zip(batch["conv_id"], batch["role"], batch["text"], strict=True):
                if last is run or not _same(c, last):
                    last, position, tokens, chars = c, 0, 0, 0
                name, body = escape(r), escape(t)
                ids = [TURN, *encode(name), BODY]
                begin = len(ids)
                ids += encode(body)
                edge = np.zeros(len(ids) + 2, dtype=np.int8)
                if r in trained:
                    edge[begin] += 1
                    edge[len(ids)] -= 1
                ids.append(END)
                formatted = f"{MARKS[TURN]}{name}{MARKS[BODY]}{body}{MARKS[END]}"
                rows.append((position, ids, np.cumsum(edge[:-1], dtype=np.int8).tobytes(), tokens, chars, formatted))
                position, tokens, chars = position + 1, tokens + len(ids), chars + len(formatted)
            made = pd.DataFrame(rows, columns=["position", "ids", "loss_mask", "token_offset", "char_offset", "formatted"])
            yield made.assign(conv_id=batch["conv_id"].to_numpy())[["conv_id", *made.columns]]

    schema = f"conv_id {_kind(df, conv)}, position bigint, ids array<int>, loss_mask binary, token_offset bigint, char_offset bigint, formatted string"
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInPandas(run, schema)


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """One row per conversation from the rows of :func:`format_chats`: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``in_order`` says that they come as :func:`format_chats` returns them, each conversation whole and in
    order within a task; then nothing is shuffled again.  Roles and texts come from the ids between the reserved ones, trained text from the ids under the
    mask; both are unescaped.  Digests are fed turn by turn.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decode = byte_bpe_50k().decode_bytes
        read = lambda ids: unescape(decode(ids).decode("utf-8"))
        last, state = run, None
        for batch in batches:
            done = []
            for c, ids, mask, chars in zip(batch["conv_id"], batch["ids"], batch["loss_mask"], batch["_chars"], strict=True):
                if last is run or not _same(c, last):
                    if state:
                        done.append(state)
                    last, state = c, [c, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                ids = np.asarray(ids)
                body = int(np.flatnonzero(ids == BODY)[0])
                if ids[0] != TURN or ids[-1] != END or ((ids[1:-1] >= TURN).sum() != 1):
                    raise ValueError("a turn's reserved ids are out of place")
                state[1] += 1
                state[2].update(f"{read(ids[1:body].tolist())}\n{read(ids[body + 1 : -1].tolist())}\n".encode())
                under = read(ids[np.frombuffer(mask, dtype=np.int8) == 1].tolist())
                state[3] += len(under)
                state[4].update(under.encode())
                state[5] += int(chars)
            if done:
                yield table(done)
        if state:
            yield table([state])

    def table(states: list) -> pd.DataFrame:
        rows = [(c, n, h.hexdigest(), k, g.hexdigest(), f) for c, n, h, k, g, f in states]
        return pd.DataFrame(rows, columns=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    rows = formatted.select("conv_id", "position", "ids", "loss_mask", F.length("formatted").alias("_chars"))
    schema = f"conv_id {_kind(formatted, 'conv_id')}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = rows if in_order else rows.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    return rows.mapInPandas(run, schema)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and one of ours, formatted and read back; null text: empty, turns that repeat a number stay, an empty table gives ours alone."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    return read_back(format_chats(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").union(own)), in_order=True)
