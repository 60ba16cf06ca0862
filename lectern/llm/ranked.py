"""Ranked lexical search: bundles of items carry their documents' scores through the owners of the terms."""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lectern.llm.common import saved
from lectern.operators.lineage import spread

#: Whatever lies between terms: ASCII other than letters and digits.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Stages, each of which owns a share of the terms; documents of a block; items of a bundle, about.
OWNERS, BLOCK, BUNDLE = 4, 4096, 256
#: Bytes of the items' texts that are searched for in one pass over the documents; every task holds their terms.
PASS_BYTES = 32 << 20


def terms_of(text: Column) -> Column:
    """The terms of a text, in order, with repeats; null has none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(F.filter(F.split(lower, BETWEEN), lambda t: t != ""), F.array().cast("array<string>"))


INTS, SHORTS, LONGS = T.ArrayType(T.IntegerType()), T.ArrayType(T.ShortType()), T.ArrayType(T.LongType())


def _list(values, kind: pa.DataType) -> pa.Array:
    values = pa.array(values, kind) if not isinstance(values, pa.Array) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _flat(rows: pa.Table, name: str) -> np.ndarray:
    """The numbers of a list column's only row."""
    return rows.column(name)[0].values.to_numpy(zero_copy_only=False)


def index(df: DataFrame, vocabulary: list[str], owners: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The postings of the terms of ``vocabulary``, in blocks of at most BLOCK documents.

    Rows of a block: one with owner -1, that has docs (their keys) and sizes (their terms, with
    repeats); and one for each owner that has postings in it: terms (numbers in the vocabulary),
    places (of the documents in the block) and counts.  A term's owner is its number modulo ``owners``.
    """
    rows = df.select(F.col(key).alias("doc_id"), terms_of(F.col(text)).alias("terms"))
    kinds = {"block": T.LongType(), "owner": T.IntegerType(), "docs": T.ArrayType(rows.schema["doc_id"].dataType), "sizes": INTS, "terms": INTS, "places": INTS, "counts": INTS}
    schema = T.StructType([T.StructField(c, kind) for c, kind in kinds.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = (TaskContext.get().partitionId() << 33) - 1
        known = pa.array(vocabulary, pa.string())
        ints = pa.list_(pa.int32())
        for whole in batches:
            for at in range(0, len(whole), BLOCK):
                number, batch = number + 1, whole.slice(at, BLOCK)
                sizes = np.diff(batch.column(1).offsets.to_numpy())
                code = pc.fill_null(pc.index_in(batch.column(1).flatten(), known), -1).to_numpy(zero_copy_only=False)
                place = np.repeat(np.arange(len(sizes)), sizes)[code >= 0]
                pairs, counts = np.unique(code[code >= 0].astype(np.int64) * BLOCK + place, return_counts=True)
                terms, places = np.divmod(pairs, BLOCK)
                own = lambda b, o, *lists: pa.RecordBatch.from_arrays([pa.array([b], pa.int64()), pa.array([o], pa.int32()), *lists], schema.names)
                yield own(number, -1, _list(batch.column(0), batch.column(0).type), _list(sizes, pa.int32()), *[pa.nulls(1, ints)] * 3)
                for owner in range(owners):
                    mine = terms % owners == owner
                    if mine.any():
                        yield own(number, owner, pa.nulls(1, pa.list_(batch.column(0).type)), pa.nulls(1, ints), *[_list(x[mine], pa.int32()) for x in (terms, places, counts)])

    return rows.mapInArrow(run, schema)


def _stage(state: DataFrame, postings: DataFrame, wanted: list[list[tuple[int, int, int]]], documents: int, length: int) -> DataFrame:
    """``state`` with what one owner's terms add.  ``wanted``: of each bundle the (item, term, weight times repeats)."""

    def add(left: pa.Table, right: pa.Table) -> pa.Table:
        if not right.num_rows:
            return left
        pairs = wanted[left.column("bundle")[0].as_py()]
        sizes, known = _flat(left, "sizes").astype(np.int64), _flat(left, "items")
        scores = np.zeros((1 + max(int(known.max(initial=0)), *(i for i, _, _ in pairs), 0), len(sizes)), dtype=np.int64)
        scores[known, _flat(left, "places")] = _flat(left, "scores")
        terms, places, counts = _flat(right, "terms"), _flat(right, "places"), _flat(right, "counts").astype(np.int64)
        norm = 100 - 75 + (75 * sizes * documents) // length
        gives = (1_000_000_000 * counts) // (1000 * counts + 8 * norm[places])
        begin = np.flatnonzero(np.diff(terms, prepend=-1))
        spans = {t: slice(a, b) for t, a, b in zip(terms[begin].tolist(), begin, [*begin[1:], len(terms)], strict=True)}
        for item, term, weight in pairs:
            if span := spans.get(term):
                scores[item, places[span]] += weight * gives[span]
        items, places = np.nonzero(scores)
        made = {"items": _list(items, pa.int16()), "places": _list(places, pa.int16()), "scores": _list(scores[items, places], pa.int64())}
        return pa.table({c: made.get(c, left.column(c)) for c in left.column_names})

    return state.groupBy("bundle", "block").cogroup(postings.groupBy("bundle", "block")).applyInArrow(add, state.schema)


def _block_best(state: DataFrame, bundles: list[list[int]], best: int) -> DataFrame:
    """(item, doc_id, score): each item's best of each block; equal scores by ascending key."""
    kind = state.schema["docs"].dataType.elementType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = pa.Table.from_batches([batch.slice(i, 1)])
                docs, items, places, scores = row.column("docs")[0].values, _flat(row, "items"), _flat(row, "places").astype(np.int64), _flat(row, "scores")
                order = np.empty(len(docs), dtype=np.int64)
                order[pc.array_sort_indices(docs, null_placement="at_start").to_numpy()] = np.arange(len(docs))
                by = np.lexsort((order[places], -scores, items))
                items, places, scores = items[by], places[by], scores[by]
                begin = np.flatnonzero(np.diff(items, prepend=-1))
                top = np.arange(len(items)) - np.repeat(begin, np.diff(np.r_[begin, len(items)])) < best
                number = np.array(bundles[row.column("bundle")[0].as_py()], dtype=np.int32)[items[top]]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), docs.take(pa.array(places[top])), pa.array(scores[top], pa.int64())], ["item", "doc_id", "score"])

    return state.mapInArrow(run, T.StructType([T.StructField("item", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("score", T.LongType())]))


def _pass(docs: DataFrame, asked: DataFrame, best: int, owners: int) -> DataFrame:
    """The best documents of the items of one pass."""
    spark = docs.sparkSession
    rows = asked.orderBy("hash", "said").collect()  # at most PASS_BYTES
    vocabulary = sorted({t for r in rows for t in r["said"]})
    number = {t: i for i, t in enumerate(vocabulary)}
    postings = saved(index(docs, vocabulary, owners))
    blocks = postings.where("owner = -1")
    documents, length = blocks.select(F.explode("sizes").alias("n")).agg(F.count_if(F.col("n") > 0), F.sum("n").cast("long")).first()
    weight = F.floor(1000 * F.log((2.0 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    found = postings.where("owner >= 0").select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weights = dict(found.select("term", weight).collect())  # a number for each term of the pass
    bundles: list[list[int]] = [list(range(i, min(len(rows), i + BUNDLE))) for i in range(0, len(rows), BUNDLE)]
    wanted = defaultdict(lambda: [[] for _ in bundles])
    for i, r in enumerate(rows):
        for t, n in sorted(Counter(number[t] for t in r["said"]).items()):
            if w := weights.get(t):
                wanted[t % owners][i // BUNDLE].append((i % BUNDLE, t, n * w))
    each = F.explode(F.sequence(F.lit(0), F.lit(len(bundles) - 1))).alias("bundle")
    none = lambda kind, name: F.array().cast(kind).alias(name)
    state = blocks.select(each, "block", "docs", "sizes", none(SHORTS, "items"), none(SHORTS, "places"), none(LONGS, "scores"))
    for owner in range(owners):
        state = _stage(state, postings.where(F.col("owner") == owner).select(each, "block", "terms", "places", "counts"), wanted[owner], documents, length)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc("doc_id"))
    ranked = _block_best(state, bundles, best).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    ids = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([T.StructField("item", T.IntegerType()), asked.schema["item_id"]]))
    return ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")


def rank_documents(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", best: int = 10, owners: int = OWNERS) -> DataFrame:
    """One row per item and rank: item_id, rank, doc_id, score of its ``best`` documents with a score above 0.

    Documents are dealt into blocks, whose postings are kept by owner: each owner has its share of the
    terms.  A bundle of items begins in each block without scores and goes through the owners one
    after the other: cogrouped with an owner's postings of that block it adds what its terms give
    each document, in 64-bit integers, and carries the sparse scores on.  Behind the last owner
    each item's best of the block are chosen, and then the best of all.  A term, however frequent,
    is spread over the blocks, so a task has one bundle in one block at a time.

    Items are searched for in passes over the documents, each for PASS_BYTES of item texts: the items
    and terms of a pass are known to the driver and every task, all of the documents stays in tasks.
    Items that repeat id and text are one; null ids are ids like others (a document's comes first
    where scores are equal); repeated documents are ranked each; null texts have no terms.  Empty
    tables give no rows.
    """
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).where(F.col("text").isNotNull()).distinct()
    hashed = F.xxhash64(F.col("item_id").cast("string"), F.col("text"))
    asked = saved(asked.select("item_id", terms_of(F.col("text")).alias("said"), hashed.alias("hash"), F.octet_length("text").alias("bytes")).where(F.size("said") > 0))
    passes = max(1, -(-(asked.agg(F.sum("bytes")).first()[0] or 0) // PASS_BYTES))
    docs = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    mine = [asked.where(F.pmod("hash", F.lit(passes)) == i) for i in range(passes)]
    return reduce(DataFrame.unionByName, [_pass(docs, part, best, owners) for part in mine])


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of all for each benchmark item; null texts have no terms, items that repeat id and text are one, repeated documents are ranked each, empty tables give no rows."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rank_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP11_SQL = r"""
WITH said AS (SELECT row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
sizes AS (SELECT r, count(*) AS n FROM said GROUP BY r),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM sizes),
counted AS (SELECT r, doc_id, term, count(*) AS tf FROM said GROUP BY r, doc_id, term),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counted, whole GROUP BY term, docs),
asked AS (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
scored AS (SELECT item_id, doc_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // length))))::BIGINT AS score
    FROM asked JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (r), whole GROUP BY item_id, doc_id, r)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
