"""Near-duplicates: Jaccard join on word n-grams by MinHash banding, with verification on whole n-gram sets."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import WORD, bands_for, gapless, hash_of, maybe_among, saved, text_digest, without_dropped
from lectern.operators.lineage import spread

FIND = re.compile(WORD).findall
#: Texts that are hashed together, by characters.
CHARS_AT_ONCE = 3_000_000
#: Texts and n-grams of a block at most (a longer text is one by itself); pairs are verified block by block.
BLOCK, BLOCK_GRAMS = 1024, 1 << 20
COLUMNS_AT_ONCE = 8192


def _mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def gram_sets(texts: list[str], n: int) -> list[np.ndarray]:
    """Each text's n-grams of words as sorted distinct hashes; a text of fewer than n words, but one at least, has one gram."""
    found = [FIND(t) for t in texts]
    sizes = np.array([len(x) for x in found], dtype=np.int64)
    if not sizes.sum():
        return [np.zeros(0, dtype=np.uint64) for _ in texts]
    codes, distinct = pd.factorize(np.array([w for x in found for w in x], dtype=object))
    words = pd.util.hash_array(np.asarray(distinct, dtype=object), categorize=False)[codes]
    rows = []
    starts = np.r_[0, np.cumsum(sizes)]
    factors = [np.uint64(f) for f in _mixed(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)]
    with np.errstate(over="ignore"):
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j, f in enumerate(factors):
            grams += words[j : j + len(grams)] * f
        for i, size in enumerate(sizes):
            if size >= n:
                rows.append(np.unique(_mixed(grams[starts[i] : starts[i] + size - n + 1])))
            elif size:
                rows.append(_mixed(np.array([sum(int(w) * int(f) for w, f in zip(words[starts[i] : starts[i + 1]], factors, strict=False)) % 2**64 ^ int(size)], dtype=np.uint64)))
            else:
                rows.append(np.zeros(0, dtype=np.uint64))
    return rows


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """For each set, a hash of each band of its MinHash signature; all sets have a member."""
    values = np.concatenate(sets)
    starts = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    keys = _mixed(np.arange(7, 7 + 2 * bands * rows, dtype=np.uint64))
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for p in range(bands * rows):
            least = np.minimum.reduceat(values * (keys[2 * p] | np.uint64(1)) + keys[2 * p + 1], starts)
            out[:, p // rows] = _mixed(out[:, p // rows] + least)
    return out.view(np.int64)


def _texts_at_once(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size > CHARS_AT_ONCE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of the vertices of the edges (a, b): label is the least vertex of v's component.  Vertices are of any type that has an order.

    Each round every vertex goes to the least of its neighbourhood and from there to the least of that
    one's, and the graph is contracted accordingly.  Where the order of vertices has nothing to do
    with the edges, as with digests, at most about half of them are left, so the rounds follow the
    logarithm of the largest component, long chains included.
    """
    edges = saved(edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct())
    labels = None
    while True:
        # What is joined by a key that many rows share is saved, so that the join deals both sides out itself and can split it.
        least = saved(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("to")))
        step = saved(least.join(least.select(F.col("a").alias("w"), F.col("to").alias("next")), F.col("to") == F.col("w")).select(F.col("a").alias("w"), "next"))
        if labels is None:
            labels = step.toDF("v", "label")
        else:
            labels = saved(labels.join(step, F.col("label") == F.col("w"), "left").select("v", F.coalesce("next", "label").alias("label")))
        edges = (
            edges.join(step, F.col("a") == F.col("w")).select(F.col("next").alias("a"), "b")
            .join(step, F.col("b") == F.col("w")).select("a", F.col("next").alias("b")).where("a <> b").distinct()
        )
        edges = saved(edges)
        if edges.isEmpty():
            return labels


def _verify(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """The links among the texts of one block, or between those of two: for each text with any, the other texts and rows that it links to and the least text it hangs together with."""
    group = group.sort_values("v", ignore_index=True)  # bytes sort as Spark sorts them
    sets = [np.frombuffer(x, dtype=np.uint64) for x in group["grams"]]
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    shared = times[column] > 1
    row, column = row[shared], column[shared]
    kept, column = np.unique(column, return_inverse=True)
    first = (group["block"] == group["low"]).to_numpy()
    alone = bool((group["low"] == group["high"]).all())
    a = np.arange(len(sets)) if alone else np.flatnonzero(first)
    b = a if alone else np.flatnonzero(~first)
    common = np.zeros((len(a), len(b)), dtype=np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for begin in range(0, len(kept), COLUMNS_AT_ONCE):
        lo, hi = np.searchsorted(column, [begin, begin + COLUMNS_AT_ONCE])
        part = np.zeros((len(sets), min(COLUMNS_AT_ONCE, len(kept) - begin)), dtype=np.float32)
        part[row[lo:hi], column[lo:hi] - begin] = 1
        common += part[a] @ part[b].T
    union = sizes[a][:, None] + sizes[b][None, :] - common
    linked = common.astype(np.float64) >= threshold * union - 1e-9
    if alone:
        np.fill_diagonal(linked, False)
    rows = group["rows"].to_numpy(dtype=np.int64)
    texts, near = np.zeros(len(sets), dtype=np.int64), np.zeros(len(sets), dtype=np.int64)
    texts[a], near[a] = linked.sum(1), linked @ rows[b]
    if not alone:
        texts[b], near[b] = linked.sum(0), linked.T @ rows[a]
    root = np.arange(len(sets))
    x, y = np.nonzero(linked)
    x, y = a[x], b[y]
    while True:
        new = root.copy()
        np.minimum.at(new, x, root[y])
        np.minimum.at(new, y, root[x])
        new = new[new]
        if (new == root).all():
            break
        root = new
    v = group["v"].to_numpy()
    has = texts > 0
    return pd.DataFrame({"v": v[has], "texts": texts[has], "near": near[has], "root": v[root[has]]})


def _in_blocks(edges: DataFrame, candidates: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs) of candidates (v, label), their numbers of grams (v, grams) and buckets, edges (a: member, b: the bucket's least text, hash).

    members: v, block.  A component that fits is a block.  The texts of a larger one are laid out
    by their least bucket, so that alike texts lie together, and cut into blocks.
    pairs: low, high of blocks, each with itself, and any two with texts in the same bucket.
    """
    weighed = saved(candidates.join(sizes, "v").withColumn("weight", F.greatest("grams", F.lit(BLOCK_GRAMS // BLOCK))).select("v", "label", "weight"))
    whole = saved(weighed.groupBy("label").agg(F.sum("weight").alias("_all")))
    # Saved where a key that many rows share is joined, so that the join deals both sides out itself and can split it.
    least = edges.groupBy(F.col("a").alias("v")).agg(F.min("hash").alias("home"))
    large = saved(weighed.join(whole.where(F.col("_all") > BLOCK_GRAMS), "label").join(least, "v").select("v", "label", "weight", "home"))
    homes = saved(large.groupBy("home").agg(F.count(F.lit(1)).alias("_n")))
    large = saved(large.join(homes, "home").withColumn("_part", F.pmod(F.xxhash64("v"), F.ceil(F.col("_n") / 65_536))))  # so many of a bucket are sorted in one task
    placed = gapless(large, "label", ["home", "_part", "v"], "_at", by=["home", "_part"], weight="weight")
    dealt = saved(placed.select("v", F.unhex(F.md5(F.concat_ws(":", F.hex("label"), F.floor(F.col("_at") / BLOCK_GRAMS).cast("string")))).alias("block")))
    members = saved(weighed.join(whole.where(F.col("_all") <= BLOCK_GRAMS), "label").select("v", F.col("label").alias("block")).unionByName(dealt))
    met = saved(edges.join(dealt, F.col("a") == F.col("v")).select("hash", "block").distinct())
    other = met.select(F.col("hash").alias("_hash"), F.col("block").alias("high"))
    crossed = met.join(other, (F.col("hash") == F.col("_hash")) & (F.col("block") < F.col("high"))).select(F.col("block").alias("low"), "high").distinct()
    return members, members.select(F.col("block").alias("low"), F.col("block").alias("high")).distinct().unionByName(crossed)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", n: int = 5, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One row per input row: doc_id, class_id, class_digest, n_links, n_texts, kept, digest.

    Rows link when the Jaccard similarity of their sets of n-word grams is at least ``threshold``.
    n_links counts the other rows that a row links to, n_texts the other n-gram sets among them;
    rows that hang together by links share class_id, the least doc_id of them, and class_digest,
    that row's digest (where ids repeat or are null only both together name a class of texts with words); the row with the
    least id and digest is kept.  Words are as they
    are in the text; a text of one to n - 1 words is one gram; null and empty texts link to nothing
    and are classes of their own.  Repeated rows link to each other.  An empty table gives none.

    Rows with equal n-gram sets are one text from the start.  Bands and rows are chosen so that a
    pair at the threshold meets in a band with probability ``recall``.  Texts that meet in a band
    hang together as candidates, through the band's least text, so no pairs are written out.
    Components are cut into blocks (:func:`_in_blocks`); each candidate's whole n-gram set, of the
    row with its least id and digest, is sent once for each block that its own is verified against,
    which is every one that a band connects it with.  A text is shuffled only if its key may be a
    candidate's.
    """
    bands, rows = bands_for(threshold, recall)
    kind = df.select(F.col(key)).schema[0].dataType.simpleString()
    docs = df.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_text"].tolist()
            for lo, hi in _texts_at_once(texts):
                sets = gram_sets(texts[lo:hi], n)
                full = [i for i, s in enumerate(sets) if len(s)]
                v: list = [None] * (hi - lo)
                found: list = [None] * (hi - lo)
                if full:
                    for i, h in zip(full, band_hashes([sets[i] for i in full], bands, rows), strict=True):
                        v[i], found[i] = hashlib.blake2b(sets[i].tobytes(), digest_size=16).digest(), h
                part = batch.iloc[lo:hi].reset_index(drop=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "digest": part["digest"], "v": pd.Series(v, dtype=object), "grams": [len(s) for s in sets], "bands": pd.Series(found, dtype=object)})

    signed = saved(docs.withColumn("digest", text_digest(F.col("_text"))).mapInPandas(sign, f"doc_id {kind}, digest string, v binary, grams bigint, bands array<bigint>"))
    texts = saved(signed.where("v is not null").groupBy("v").agg(F.min(F.struct("doc_id", "digest")).alias("first"), F.count(F.lit(1)).alias("rows"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))
    met = texts.select(F.col("v").alias("a"), F.explode("bands").alias("hash"))  # each band hashes with keys of its own
    # What is grouped by a key and then joined by it is saved between, so that the join can split a key that many rows share.
    buckets = saved(met.groupBy("hash").agg(F.min("a").alias("b"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    edges = saved(maybe_among(met, "hash", buckets.select("hash")).where("_maybe").join(buckets, "hash").select("a", "b", "hash"))
    members, pairs = _in_blocks(edges, components(edges.select("a", "b")), texts.select("v", "grams"))
    # Each end of a pair of blocks, and what is sent there.
    ends = saved(pairs.withColumn("block", F.explode(F.array_distinct(F.array("low", "high")))))
    firsts = saved(members.join(texts.select("v", "first", "rows"), "v").select("v", "block", "rows", F.col("first.doc_id").alias("_id"), F.col("first.digest").alias("_digest")))

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            bodies = batch.pop("_text").tolist()
            for lo, hi in _texts_at_once(bodies):
                yield batch.iloc[lo:hi].assign(grams=[s.tobytes() for s in gram_sets(bodies[lo:hi], n)])

    wanted = maybe_among(docs.withColumn("_hash", hash_of(F.col("doc_id"))), "_hash", firsts.select(hash_of(F.col("_id")))).where("_maybe").withColumn("digest", text_digest(F.col("_text")))
    grams = (
        wanted.select("doc_id", "digest", "_text").join(firsts, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest"))).select("v", "rows", "block", "_text")
        .mapInPandas(gram, "v binary, rows bigint, block binary, grams binary")
        .dropDuplicates(["v"])
    )
    sent = grams.join(ends, "block").select("v", "rows", "block", "low", "high", "grams")
    verified = saved(sent.groupBy("low", "high").applyInPandas(lambda g: _verify(g, threshold), "v binary, texts bigint, near bigint, root binary"))
    links = verified.groupBy("v").agg(F.sum("texts").alias("texts"), F.sum("near").alias("near"))
    labels = components(verified.select(F.col("v").alias("a"), F.col("root").alias("b")))
    named = labels.join(texts.select("v", "first"), "v")
    classes = saved(named.groupBy("label").agg(F.min("first").alias("class_first"))).join(labels, "label").select("v", "class_first")
    facts = saved(texts.select("v", "first", "rows").join(links, "v", "left").join(classes, "v", "left"))
    head = F.coalesce("class_first", "first")
    worded = signed.where("v is not null").join(facts, "v").select(
        "doc_id", head["doc_id"].alias("class_id"), head["digest"].alias("class_digest"), (F.col("rows") - 1 + F.coalesce("near", F.lit(0))).cast("long").alias("n_links"), F.coalesce("texts", F.lit(0)).cast("long").alias("n_texts"),
        (head["doc_id"].eqNullSafe(F.col("doc_id")) & (head["digest"] == F.col("digest"))).alias("kept"), "digest",
    )
    none = F.lit(0).cast("long")
    wordless = signed.where("v is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("digest").alias("class_digest"), none.alias("n_links"), none.alias("n_texts"), F.lit(True).alias("kept"), "digest")
    return worded.unionByName(wordless)


def one_of_each(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``df`` that :func:`near_duplicates` keeps, with all their columns, whatever their names.

    Texts without words link to nothing and stay.  Of rows that share key and text one stays, that
    whose other columns hash lowest.  Only texts whose key may be that of a dropped row are shuffled.
    """
    return without_dropped(df, near_duplicates(df, key, text, **options).select("doc_id", "digest", "kept"), key, text)


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class and links of all documents; a null or empty text is a class of its own, repeated rows link to each other, no rows of an empty table."""
    return near_duplicates(spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))).select("doc_id", "class_id", "class_digest", "n_links", "n_texts")
