"""Tokenizers inside tasks, and token counts behind a digest cache."""

from __future__ import annotations

import base64
import functools
import hashlib
import os
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import FILTER_BITS, hash_of, maybe_among, saved, shared_table, text_digest, utf8_bytes
from lectern.operators.lineage import spread

#: Rows that a task holds as Python texts at a time.
TEXTS_AT_ONCE = 256
#: Digests that a task knows it has counted.
DIGESTS_KEPT = 200_000
#: Words whose count a worker remembers.
WORDS_KEPT = 400_000


def tokenizer_path(name: str) -> str:
    """Where the vocabulary file of this name lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_encoding(path: str, pattern: str, specials: tuple[tuple[str, int], ...]):
    """The byte-level vocabulary of a ranks file."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=dict(specials))


@functools.cache
def byte_bpe_50k():
    """byte_bpe_50k as ranks; it gives the ids that the tokenizers library gives with the .json file, several times as fast."""
    import public_tokenizers

    return byte_encoding(tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, (("<|endoftext|>", 50256),))


#: Runs of white space that long go to the tokenizers library; the ranks form's pattern backtracks through a run and runs out of stack on a million.
LONG_RUN = 50_000
_SPACES = re.compile(r"\s+")


def byte_ids(text: str, specials: bool = False) -> np.ndarray:
    """byte_bpe_50k ids of any text; ``specials``: a special string in it counts as its special id, else it is taken as ordinary text."""
    if len(text) >= LONG_RUN and any(m.end() - m.start() >= LONG_RUN for m in _SPACES.finditer(text)):
        return np.array(library_tokenizer(tokenizer_path("byte_bpe_50k.json"), not specials).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    own = byte_bpe_50k()
    return own.encode_to_numpy(text, allowed_special=own.special_tokens_set if specials else set(), disallowed_special=())


@functools.cache
def library_tokenizer(path: str, ordinary: bool = False):
    """The tokenizer of a .json file, without truncation or padding; ``ordinary``: special strings in texts are ordinary text."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    found.encode_special_tokens = ordinary
    return found


@functools.cache
def sentence_model(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@functools.cache
def file_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


class WordCounts:
    """Counts the tokens of word_bpe_49k text by adding those of its words, each of which the library encodes once.

    The vocabulary's own splitting pattern cuts a text into words that are encoded apart from each
    other, so the sum is the library's count.  A text goes to the library whole if it holds a
    special string or a character that case folding or normalisation may treat by its neighbours.
    """

    #: Letters with one lower case form each, alike in Python and in the library, and not composed by NFC with what follows.
    PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E\xA0-įı-ſЀ-ѐ一-鿿　-〿‐-‧‰-⁞]*")
    SPECIAL = re.compile(r"<\|(?:startoftext|endoftext)\|>")

    def __init__(self, path: str):
        import regex

        self.tokenizer = library_tokenizer(path)
        self.find = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+").findall
        self.kept: dict[str, int] = {}

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def __call__(self, texts: list[str]) -> list[int]:
        out, rest = [0] * len(texts), []
        split: list[tuple[int, list[str]]] = []
        unknown: set[str] = set()
        if len(self.kept) > WORDS_KEPT:
            self.kept.clear()
        kept = self.kept
        for i, text in enumerate(texts):
            if not self.PLAIN.fullmatch(text) or self.SPECIAL.search(text):
                rest.append(i)
                continue
            words = self.find(unicodedata.normalize("NFC", text).lower())
            split.append((i, words))
            unknown.update(w for w in words if w not in kept)
        todo = list(unknown)
        kept.update(zip(todo, self.whole(todo), strict=True))
        for i, words in split:
            out[i] = sum(map(kept.__getitem__, words))
        if rest:
            for i, n in zip(rest, self.whole([texts[i] for i in rest]), strict=True):
                out[i] = n
        return out


@functools.cache
def counter(path: str):
    """A function from texts to token counts for a vocabulary file."""
    if path.endswith(".model"):
        model = sentence_model(path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    if os.path.basename(path) == "word_bpe_49k.json":
        return WordCounts(path)
    tokenizer = library_tokenizer(path)
    return lambda texts: [len(x.ids) for x in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def count_tokens(df: DataFrame, cache: str, key: str = "doc_id", text: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a table (content_digest, tokenizer_digest, n_tokens), in folders by tokenizer_digest.  A text's digest is looked up
    there under this tokenizer's; only distinct texts that it lacks are encoded, and their counts
    are appended to it.  One row of each such text is encoded where it lies, so no text is shuffled;
    a filter finds these rows, and lets a few others through whose counts are not used.  The digest is of the text as it is (null counts as empty), as white space
    and case can matter to a tokenizer.  Repeated texts are encoded once; an empty table gives none.
    A job that dies in the middle leaves at most counts that are right; entries that two jobs both
    appended count once.
    """
    spark = df.sparkSession
    version = file_digest(tokenizer_path(tokenizer))
    rows = saved(df.select(F.col(key).alias("doc_id"), utf8_bytes(F.col(text)).alias("n_bytes"), text_digest(F.col(text)).alias("content_digest")).withColumn("pair", F.xxhash64(hash_of(F.col("doc_id")), "content_digest")))
    asked = saved(rows.select("content_digest").distinct())  # of a cache, however large, only these are grouped
    schema = "content_digest string, tokenizer_digest string, n_tokens bigint"
    try:
        stored = spark.read.schema(schema).parquet(cache).where(F.col("tokenizer_digest") == version).join(asked, "content_digest", "left_semi").select("content_digest").distinct()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = None
    missing = asked if stored is None else asked.join(stored, "content_digest", "left_anti")
    # One row of each missing digest is encoded where it lies: that whose pair of key and digest hashes lowest.
    chosen = saved(rows.join(missing, "content_digest", "left_semi").groupBy("content_digest").agg(F.min("pair").alias("pair")).select("pair"))
    texts = df.select(F.coalesce(F.col(text), F.lit("")).alias("_text"), hash_of(F.col(key)).alias("_hash")).withColumn("content_digest", F.sha2("_text", 256))
    texts = maybe_among(texts.withColumn("_pair", F.xxhash64("_hash", "content_digest")), "_pair", chosen).where("_maybe").select("content_digest", "_text")
    if 2 * chosen.count() > FILTER_BITS:  # too many for the filter to tell them from their copies
        texts = texts.join(missing, "content_digest", "left_semi").groupBy("content_digest").agg(F.first("_text").alias("_text"))

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(tokenizer_path(tokenizer))
        done: set[str] = set()  # rows that repeat in a task
        for batch in batches:
            batch = batch[~batch["content_digest"].isin(done)].drop_duplicates("content_digest")
            done = set(batch["content_digest"]) if len(done) > DIGESTS_KEPT else done | set(batch["content_digest"])
            found: list[int] = []
            for i in range(0, len(batch), TEXTS_AT_ONCE):
                found += count(batch["_text"].iloc[i : i + TEXTS_AT_ONCE].tolist())
            yield pd.DataFrame({"content_digest": batch["content_digest"], "tokenizer_digest": version, "n_tokens": np.array(found, dtype=np.int64)})

    fresh = texts.mapInPandas(encode, schema).groupBy("content_digest").agg(F.first("tokenizer_digest").alias("tokenizer_digest"), F.first("n_tokens").alias("n_tokens"))
    fresh.join(missing, "content_digest", "left_semi").write.mode("append").partitionBy("tokenizer_digest").parquet(cache)
    # Saved, so that the join below deals both sides out itself and can split a digest that many rows share.
    counts = saved(spark.read.schema(schema).parquet(cache).where(F.col("tokenizer_digest") == version).join(asked, "content_digest", "left_semi").groupBy("content_digest").agg(F.first("n_tokens").alias("n_tokens")))
    return rows.join(counts, "content_digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts for all documents over a cache that begins empty."""
    return count_tokens(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), shared_table(spark, "token-counts"))
