"""Filtered top-k similarity search for many queries at once."""

from __future__ import annotations

import functools
import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.functions.text import TOKEN, hash_tokens, strip
from lectern.functions.vectors import distance_to_score, l2_squared, token_slot
from lectern.operators.lineage import settled

MOST = 20
#: A queries table of at most so many rows, and bytes of vectors, is sent to every task.
QUERIES_SENT, BYTES_SENT = 4_000, 32 << 20
#: Rows of a tile on either side, and blocks of chunks that share a salt.
CHUNK_BLOCK, QUERY_BLOCK, SALT_BLOCKS = 1024, 256, 64
_ASKED = ("query_id", "course_id", "chapter", "source_type", "verified_only", "embedding")


def kb_filter(c: str = "c", q: str = "q") -> Column:
    """Whether a chunk is one that a query asks for: its course; chapter and source type if the query names one; verified or not if it says which."""
    same = lambda name: (F.coalesce(F.col(f"{q}.{name}"), F.lit("")) == "") | (F.col(f"{c}.{name}") == F.col(f"{q}.{name}"))
    return (F.col(f"{c}.course_id") == F.col(f"{q}.course_id")) & same("chapter") & same("source_type") & (F.col(f"{q}.verified_only").isNull() | (F.col(f"{c}.verified") == F.col(f"{q}.verified_only")))


def sparse_embeddings(df: DataFrame, key: str, text: str, dim: int = 256) -> DataFrame:
    """(key, slot, weight) rows of the hashing embedding: the form for joins on slots."""
    tokens = df.select(F.col(key), F.explode(hash_tokens(F.col(text))).alias("_t")).withColumn("_s", token_slot(F.col("_t"), dim))
    sums = tokens.groupBy(key, F.col("_s.slot").alias("slot")).agg(F.sum("_s.sign").alias("_w")).where("_w <> 0")
    norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(key)))
    return sums.select(key, "slot", (F.col("_w") / norm).alias("weight"))


_TOKEN = re.compile(TOKEN)


@functools.lru_cache(maxsize=1 << 18)
def _slot(token: str) -> int:
    """A token's slot from 1, negative for the negative sign."""
    digest = hashlib.sha256(token.encode("utf-8", "surrogatepass")).digest()
    return (1 + int.from_bytes(digest[:4], "big")) * (1 if digest[4] % 2 == 0 else -1)


def hashing_vectors(texts: list[str], dim: int) -> np.ndarray:
    """The hashing embeddings of a batch of texts, one row each."""
    out = np.zeros((len(texts), dim))
    for i, text in enumerate(texts):
        codes = np.array([_slot(t) for t in _TOKEN.findall((text or "").lower())], dtype=np.int64)
        out[i] = np.bincount((np.abs(codes) - 1) % dim, weights=np.sign(codes), minlength=dim)[:dim] if len(codes) else 0.0
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return np.divide(out, norm, out=out, where=norm > 0)


def embed(df: DataFrame, text: str = "content", output: str = "embedding", dim: int = 256, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Add a vector: the hashing embedding, or what ``embedder`` makes of the text column (for example a pandas UDF).

    Either works within the rows, so nothing is shuffled; the hashing embedding takes Arrow batches.
    """
    if embedder:
        return df.withColumn(output, embedder(F.col(text)))

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(list(hashing_vectors(texts.tolist(), dim)))

    return df.withColumn(output, vectors(F.col(text)))


def small_side(df: DataFrame) -> bool:
    """Whether a queries table, which is saved, is so small that it can be sent to every task: in rows and in bytes of its vectors."""
    n, numbers = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    return n <= QUERIES_SENT and 8 * numbers <= BYTES_SENT


def _nearest(rows: pd.DataFrame, asked: pd.DataFrame, k: int, digits: int | None) -> pd.DataFrame:
    """For each query the k nearest of the rows that pass its filter, by distance and then chunk_id: all columns of the rows, query_id, top_k and distance."""
    found = []
    vectors = np.stack(rows["embedding"].to_numpy()).astype(np.float64) if len(rows) else np.zeros((0, 0))
    by_course = rows.groupby("course_id").indices
    columns = {c: rows[c].to_numpy(dtype=object) for c in ("chapter", "source_type", "verified", "chunk_id")}
    for q in asked.itertuples(index=False):
        at = by_course.get(q.course_id)
        if at is None:
            continue
        for name in ("chapter", "source_type"):
            if (wanted := getattr(q, name)) is not None and wanted == wanted and wanted != "":
                at = at[columns[name][at] == wanted]
        if q.verified_only is not None and q.verified_only == q.verified_only:
            at = at[columns["verified"][at] == q.verified_only]
        if not len(at):
            continue
        gap = vectors[at] - q.embedding
        distance = np.einsum("ij,ij->i", gap, gap)
        if digits is not None:
            distance = np.round(distance, digits)
        if len(at) > k:  # all that tie with the k-th stay for the order by chunk_id
            near = np.flatnonzero(distance <= np.partition(distance, k - 1)[k - 1])
            at, distance = at[near], distance[near]
        order = np.lexsort((columns["chunk_id"][at].astype(str), distance))[:k]
        found.append(rows.iloc[at[order]].assign(query_id=q.query_id, top_k=q.top_k, distance=distance[order]))
    return pd.concat(found, ignore_index=True) if found else rows.iloc[:0].assign(query_id=None, top_k=None, distance=None)


def search(chunks: DataFrame, queries: DataFrame, k: int = 5, distance: Callable[[Column, Column], Column] | None = None, digits: int | None = None) -> DataFrame:
    """The k nearest chunks of each query that pass its filter, with rank and score.

    chunks: course_id, chunk_id, chapter, source_type, verified, embedding, ...; queries: query_id,
    course_id, chapter, source_type, verified_only, embedding, and optionally top_k (at most 20,
    in place of ``k``).  Nearest by squared Euclidean distance, rounded to ``digits`` if given, or by
    another ``distance``.  Ties go by chunk_id.  A course without chunks gives no rows.

    A queries table of bounded rows and bytes is sent to the chunks: each task compares Arrow batches
    of its chunks with it and passes on its own k nearest of each query, so however large a course
    is, only those are shuffled.  A larger table meets the chunks in tiles (:func:`_tiled`).  With
    another distance the two are joined by course.
    """
    if not 1 <= k <= MOST:
        raise ValueError(f"k must be between 1 and {MOST}")
    own = "top_k" in queries.columns
    if distance is None:
        asked = queries.select(*_ASKED, *["top_k"] * own).where("embedding is not null")
        asked = settled(asked if own else asked.withColumn("top_k", F.lit(k)))  # counted, then sent or cut into blocks
        found = (_compared if small_side(asked) else _tiled)(chunks, asked, MOST if own else k, digits)
    else:
        joined = chunks.alias("c").join(queries.alias("q"), kb_filter())
        far = (distance or l2_squared)(F.col("c.embedding"), F.col("q.embedding"))
        found = joined.select("q.query_id", (F.col("q.top_k") if own else F.lit(k)).alias("top_k"), "c.*", (far if digits is None else F.round(far, digits)).alias("distance")).drop("embedding")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    top = found.withColumn("rank", rank).where(F.col("rank") <= (MOST if own else k)).where(F.col("rank") <= F.col("top_k")).drop("top_k")
    return top.withColumn("score", distance_to_score(F.col("distance")))


def _compared(chunks: DataFrame, queries: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The k nearest chunks of each query within each task."""
    asked = queries.toPandas()  # bounded by small_side
    asked["embedding"] = [np.asarray(x, dtype=np.float64) for x in asked["embedding"]]
    sent = chunks.sparkSession.sparkContext.broadcast(asked)
    carried = [c for c in chunks.columns if c not in ("query_id", "top_k", "distance")]
    chunks = chunks.select(carried).where("embedding is not null")
    kinds = {f.name: f.dataType for f in queries.schema}
    schema = T.StructType([f for f in chunks.schema if f.name != "embedding"])
    schema = schema.add("query_id", kinds["query_id"]).add("top_k", kinds["top_k"]).add("distance", "double")
    names = schema.names

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = None
        for batch in batches:
            near = _nearest(batch, sent.value, k, digits)[names]
            best = near if best is None or not len(best) else pd.concat([best, near], ignore_index=True) if len(near) else best
            best = best.sort_values(["query_id", "distance", "chunk_id"], kind="stable").groupby("query_id", sort=False).head(k)
        if best is not None and len(best):
            yield best

    return chunks.mapInPandas(run, schema)


def _blocks(df: DataFrame, rows: int) -> DataFrame:
    """(course_id, block, rows): the rows of each course packed into arrays of at most ``rows`` structs, within each task, so nothing is shuffled."""
    df = df.where("course_id is not null and embedding is not null")
    item = T.StructType([f for f in df.schema])
    schema = T.StructType([df.schema["course_id"], T.StructField("block", T.LongType()), T.StructField("rows", T.ArrayType(item))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, waiting = TaskContext.get().partitionId() << 33, defaultdict(list), 0
        for batch in chain(batches, (None,)):
            if batch is not None and len(batch):
                table = pa.Table.from_batches([batch])
                for course, at in pd.Series(batch.column("course_id").to_pylist()).groupby(batch.column("course_id").to_pylist()).indices.items():
                    held[course].append(table.take(pa.array(at)))
                waiting += len(batch)
            for course in list(held) if batch is None or waiting > 64 * rows else [c for c, parts in held.items() if sum(map(len, parts)) >= rows]:
                whole = pa.concat_tables(held.pop(course)).combine_chunks()
                waiting -= len(whole)
                for at in range(0, len(whole), rows):
                    part = whole.slice(at, rows).combine_chunks()
                    packed = pa.StructArray.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in part.columns], names=part.column_names)
                    lists = pa.ListArray.from_arrays(pa.array([0, len(packed)], pa.int32()), packed)
                    yield pa.RecordBatch.from_arrays([pa.array([course], part.schema.field("course_id").type), pa.array([number], pa.int64()), lists], names=schema.names)
                    number += 1

    return df.mapInArrow(run, schema)


def _tiled(chunks: DataFrame, queries: DataFrame, k: int, digits: int | None) -> DataFrame:
    """The k nearest chunks of each query within each tile: a block of chunks against a block of queries of their course.

    A tile takes one matrix product; those that it can't tell from the k-th are measured exactly.
    Blocks of a large course are salted, and its query blocks copied to each salt, so no task
    has a whole course; within a task the join gives one tile after the other.
    """
    carried = [c for c in chunks.columns if c not in ("query_id", "top_k", "distance")]
    cut = settled(_blocks(chunks.select(carried), CHUNK_BLOCK))
    large = cut.groupBy("course_id").agg(F.ceil(F.count(F.lit(1)) / SALT_BLOCKS).cast("long").alias("_salts")).where("_salts > 1")
    salts = F.coalesce("_salts", F.lit(1))
    left = cut.join(large, "course_id", "left").select("course_id", F.pmod(F.xxhash64("block"), salts).alias("salt"), F.col("rows").alias("c"))
    right = _blocks(queries, QUERY_BLOCK).join(large, "course_id", "left").select("course_id", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.col("rows").alias("q"))
    kinds = {f.name: f.dataType for f in queries.schema}
    schema = T.StructType([f for f in chunks.select(carried).schema if f.name != "embedding"]).add("query_id", kinds["query_id"]).add("top_k", kinds["top_k"]).add("distance", "double")

    def vectors(rows: pa.StructArray) -> np.ndarray:
        flat = rows.field("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        return flat.reshape(len(rows), -1)

    def matching(c: pa.StructArray, q: pa.StructArray) -> np.ndarray:
        fits = np.ones((len(q), len(c)), dtype=bool)
        for name, asked in (("chapter", "chapter"), ("source_type", "source_type"), ("verified", "verified_only")):
            have, want = c.field(name).to_pylist(), q.field(asked).to_pylist()
            code = {v: i for i, v in enumerate(dict.fromkeys([*have, *want]))}
            free = np.array([w is None or w == "" for w in want])
            fits &= free[:, None] | (np.array([code[w] for w in want])[:, None] == np.array([code[h] for h in have])[None, :])
        return fits

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                c, q = batch.column(0)[i].values, batch.column(1)[i].values
                c = c.take(pc.array_sort_indices(c.field("chunk_id")))
                x, y = vectors(c), vectors(q)
                xx, yy = np.einsum("ij,ij->i", x, x), np.einsum("ij,ij->i", y, y)
                fits = matching(c, q)
                near = np.where(fits, xx[None, :] + yy[:, None] - 2 * (y @ x.T), np.inf)
                slack = 1e-9 * (1 + yy + xx.max(initial=0)) + (0 if digits is None else 10.0**-digits)
                last = np.partition(near, min(k, len(c)) - 1, axis=1)[:, min(k, len(c)) - 1]
                a, b = np.nonzero(fits & (near <= (last + slack)[:, None]))
                gap = x[b] - y[a]
                distance = np.einsum("ij,ij->i", gap, gap)
                if digits is not None:
                    distance = np.round(distance, digits)
                by = np.lexsort((b, distance, a))
                a, b, distance = a[by], b[by], distance[by]
                begin = np.flatnonzero(np.diff(a, prepend=-1))
                best = np.arange(len(a)) - np.repeat(begin, np.diff(np.r_[begin, len(a)])) < k
                rows, asked = c.take(pa.array(b[best])), q.take(pa.array(a[best]))
                yield pa.RecordBatch.from_arrays([*[rows.field(n) for n in schema.names[:-3]], asked.field("query_id"), asked.field("top_k"), pa.array(distance[best])], names=schema.names)

    return left.join(right, ["course_id", "salt"]).select("c", "q").mapInArrow(compare, schema)


def search_result(found: DataFrame) -> DataFrame:
    """What a search shows of its chunks: missing ids empty, unverified unless said."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return found.select("query_id", "rank", empty("chunk_id"), empty("document_id"), "course_id", F.coalesce("source_type", F.lit("unknown")).alias("source_type"), "chapter", "section", "page", "title", "content", F.coalesce("verified", F.lit(False)).alias("verified"), "score")


def context_query(kind: Column, chapter_range: Column, focus: Column, query: Column) -> Column:
    """Struct (query, k) that a request asks the knowledge base."""
    text = F.when(kind == "lesson", F.concat_ws(" ", F.nullif(chapter_range, F.lit("")), F.nullif(focus, F.lit("")))).when(kind == "exam", F.coalesce(chapter_range, F.lit(""))).otherwise(F.coalesce(query, F.lit("")))
    return F.struct(strip(text).alias("query"), F.when(kind.isin("lesson", "exam"), 8).otherwise(5).alias("k"))


def require_context(requests: DataFrame, found: DataFrame, message: str = "Build course documents into the knowledge base first") -> DataFrame:
    """Requests (request_id, kind, supplied) with contexts, n_contexts, failed and error: supplied contexts are used again, lesson and exam requests without any fail."""
    got = found.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("_got"))
    ids = F.transform(F.coalesce("_got", F.array().cast("array<struct<rank:int,chunk_id:string>>")), lambda x: x["chunk_id"])
    contexts = F.when(F.size(F.coalesce("supplied", F.array().cast("array<string>"))) > 0, F.col("supplied")).otherwise(ids)
    out = requests.join(got, "request_id", "left").withColumn("contexts", contexts).withColumn("n_contexts", F.size("contexts"))
    failed = F.col("kind").isin("lesson", "exam") & (F.col("n_contexts") == 0)
    return out.withColumn("failed", failed).withColumn("error", F.when(failed, F.lit(message))).drop("_got")
