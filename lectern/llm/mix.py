"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import carried, maybe_among, saved, text_digest, unit_hash, word_count

#: Each source's rows are dealt by hash into BLOCKS blocks of SLICES slices.
BLOCKS, SLICES = 256, 16


def targets(sizes: DataFrame, weights: tuple[int, ...], cap: float, share: float = 1.0) -> DataFrame:
    """Add target to (source, source_size): ``share`` of all words dealt by weight, at most ``cap`` times a source's size.

    Sources take the weights in turn, by code point, null last.  What a source can't take is dealt
    again by weight; in the end target = min(cap * size, weight * level), and the level is the
    highest of those that follow from taking the first k sources, by cap / weight, as capped.
    Works on one row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    tight = Window.orderBy("_most_per_weight", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(tight), F.lit(0.0))
    everything = Window.partitionBy()
    return (
        sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
        .withColumn("_most", F.col("source_size") * F.lit(float(cap)))
        .withColumn("_most_per_weight", F.col("_most") / F.col("_weight"))
        .withColumn("_level", (F.sum("source_size").over(everything) * F.lit(float(share)) - before(F.col("_most"))) / (F.sum("_weight").over(everything) - before(F.col("_weight"))))
        .withColumn("target", F.least("_most", F.col("_weight") * F.max("_level").over(everything)))
        .drop("_weight", "_most", "_most_per_weight", "_level")
    )


def _split(node: Column, counts: Column, seed: int) -> Column:
    """How many of a node's blocks of each source go left: a multivariate hypergeometric draw of half of them, block by block."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, n: a + n)
    start = F.struct(F.floor(total / 2).cast("long").alias("room"), total.alias("left"), F.lit(0).cast("long").alias("at"), F.expr("cast(array() as array<bigint>)").alias("taken"))

    def draw(state: Column, _: Column) -> Column:
        hit = unit_hash(F.lit(seed), node, state["at"], state["left"]) * state["left"] < state["room"]
        one = F.when(hit, 1).otherwise(0).cast("long")
        return F.struct((state["room"] - one).alias("room"), (state["left"] - 1).alias("left"), state["at"].alias("at"), (state["k"] + one).alias("k"))

    def source(state: Column, n: Column) -> Column:
        begin = F.struct(state["room"].alias("room"), state["left"].alias("left"), state["at"].alias("at"), F.lit(0).cast("long").alias("k"))
        done = F.aggregate(F.array_repeat(F.lit(0), n.cast("int")), begin, draw)
        after = lambda s: F.struct(s["room"].alias("room"), s["left"].alias("left"), (s["at"] + 1).alias("at"), F.concat(state["taken"], F.array(s["k"])).alias("taken"))
        return F.transform(F.array(done), after)[0]

    return F.aggregate(counts, start, source, lambda s: s["taken"])


def split_blocks(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(source_key, ends) from (source_key, quota): for each source, where its run of blocks passes from one shard to the next.

    A binary tree over the shards (a power of two): each node deals half of its blocks to either
    side, with exact totals.  The table has a row per node.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    listed = quotas.groupBy().agg(F.array_sort(F.collect_list(F.struct("source_key", "quota"))).alias("_all")).where(F.size("_all") > 0)
    tree = listed.select(F.lit(0).alias("node"), F.col("_all.source_key").alias("keys"), F.col("_all.quota").alias("counts"))
    for level in range(shards.bit_length() - 1):
        tree = (
            tree.withColumn("_left", _split(F.col("node") + F.lit(1 << level), F.col("counts"), seed))
            .select(F.explode(F.array(
                F.struct((F.col("node") * 2).alias("node"), F.col("_left").alias("counts")),
                F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "_left", lambda a, b: a - b).alias("counts")),
            )).alias("_child"), "keys")
            .select("_child.node", "keys", "_child.counts")
        )
    leaves = tree.select("node", F.explode(F.arrays_zip("keys", "counts")).alias("_x")).select("node", F.col("_x.keys").alias("source_key"), F.col("_x.counts").alias("quota"))
    ended = leaves.withColumn("_end", F.sum("quota").over(Window.partitionBy("source_key").orderBy("node")))
    return ended.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("node", "_end"))).alias("_ends")).select("source_key", F.col("_ends._end").alias("ends"))


def _source_key(source: Column) -> Column:
    """A source's name as text that sorts by code point; null is a source of its own."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _placed(key: Column, digest: Column, number: Column, seed: int) -> Column:
    """A row's place in its source's hashed order, as hex digits: two say its block, the next its slice."""
    name = F.coalesce(F.concat(F.lit("k"), key.cast("string")), F.lit("n"))
    return F.sha2(F.concat_ws("|", F.lit(str(seed)), name, digest, number.cast("string")), 256)


def _hex(place: Column, at: int, n: int) -> Column:
    return F.conv(F.substring(place, at, n), 16, 10).cast("int")


def _numbered(df: DataFrame, key: str, text: str, source: str, seed: int) -> DataFrame:
    """(doc_id, source, size, _digest, _number, source_key, _place, _block, _slice) of each row; _number tells equal rows apart.

    Equal rows are counted before they are numbered, so however many they are they need no sort.
    """
    return saved(
        df.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), text_digest(F.col(text)).alias("_digest"))
        .groupBy("doc_id", "source", "size", "_digest").agg(F.count(F.lit(1)).alias("_equal"))
        .withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_equal") - 1, F.lit(4096).cast("long"))))  # in parts, so no long array is made
        .withColumn("_number", F.explode(F.sequence(F.col("_from"), F.least(F.col("_from") + 4095, F.col("_equal") - 1)))).drop("_from", "_equal")
        .withColumn("source_key", _source_key(F.col("source"))).withColumn("_place", _placed(F.col("doc_id"), F.col("_digest"), F.col("_number"), seed))
        .withColumn("_block", _hex(F.col("_place"), 1, 2)).withColumn("_slice", _hex(F.col("_place"), 3, 1))
    )


def _drawn(rows: DataFrame, weights: tuple[int, ...], cap: int, shards: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sources, blocks): what each source is to give, and where each draw of each of its blocks goes.

    A source's quota is counted in blocks before any row is looked at: all its blocks for each whole
    round, the first few of a last round in a fresh permutation, and one part of a block for what is
    then missing.  The splitting tree deals the quotas out among the shards.  Each shard so gets a
    run of the source's draws; a draw is a block of a round, in that round's permutation.

    sources: source_key, source_size, target, _part (the block that is taken in part), _until (how
    far), _fill (one more row for its draw), _part_shard.  blocks: source_key, _block, _shards (of its
    whole draws).
    """
    slices = saved(rows.groupBy("source_key", "_block", "_slice").agg(F.first("source").alias("source"), F.sum("size").alias("_words")))
    sizes = slices.groupBy("source_key").agg(F.first("source").alias("source"), F.sum("_words").alias("source_size"))
    blocks = slices.groupBy("source_key", "_block").agg(F.sum("_words").alias("_words"))
    wanted = saved(
        targets(sizes, weights, cap)
        .withColumn("_rounds", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
        .withColumn("_rest", F.greatest(F.col("target") - F.col("_rounds") * F.col("source_size"), F.lit(0.0)))
        .drop("source")
    )
    # Each round goes through the blocks in a permutation of its own.
    by_round = Window.partitionBy("source_key", "_round").orderBy(F.xxhash64(F.lit(seed), "source_key", "_round", "_block"), "_block")
    laid = saved(
        blocks.join(wanted.select("source_key", "_rounds", "_rest"), "source_key").withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_rounds"))))
        .withColumn("_at", F.row_number().over(by_round) - 1).withColumn("_last", F.col("_round") == F.col("_rounds"))
        .withColumn("_until", F.sum("_words").over(by_round.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_whole", ~F.col("_last") | ((F.col("_rest") > 0) & (F.col("_until") <= F.col("_rest"))))
    )
    # The block of the last round that the target ends in, the slice of it, and the row of that.
    part = laid.where("_last and not _whole and _until - _words < _rest").select("source_key", F.col("_block").alias("_part"), (F.col("_rest") - (F.col("_until") - F.col("_words"))).alias("_left"))
    begun = F.coalesce(F.sum("_words").over(Window.partitionBy("source_key").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = saved(
        slices.withColumnRenamed("_block", "_part").join(part, ["source_key", "_part"]).withColumn("_begun", begun)
        .where("_begun < _left and _begun + _words >= _left")
        .groupBy("source_key").agg(F.min(F.struct("_part", "_slice", (F.col("_left") - F.col("_begun")).alias("left"))).alias("_e"))
        .select("source_key", "_e._part", F.col("_e._slice").alias("_edge"), F.col("_e.left").alias("_left"))
    )
    so_far = F.sum("size").over(Window.partitionBy("source_key").orderBy("_place").rowsBetween(Window.unboundedPreceding, 0))
    reached = (
        rows.where("size > 0").join(edge, "source_key").where("_block = _part and _slice = _edge").withColumn("_so_far", so_far).where("_so_far <= _left")
        .groupBy("source_key").agg(F.max("_place").alias("_until"), F.max("_so_far").alias("_got"))
    )
    # What comes before the slice is in; without a row of the slice itself, nothing of the slice is.
    before = F.concat(F.lpad(F.lower(F.hex(F.col("_part").cast("long"))), 2, "0"), F.lower(F.hex(F.col("_edge").cast("long"))))
    ends = edge.join(reached, "source_key", "left").select("source_key", "_part", F.coalesce("_until", before).alias("_until"), (F.col("_left") - F.coalesce("_got", F.lit(0))).alias("_gap"))
    ends = saved(ends)
    # The one row that fills the gap best, of all that the last round doesn't take.
    off = F.abs(F.col("_gap") - F.col("size"))
    later = laid.where("_last and not _whole").select("source_key", "_block")
    fills = (
        rows.where("size > 0").join(ends.where("_gap > 0"), "source_key").where((off < F.col("_gap")) & ((F.col("_block") != F.col("_part")) | (F.col("_place") > F.col("_until"))))
        .join(saved(later), ["source_key", "_block"])
        .groupBy("source_key").agg(F.min(F.struct(off.alias("off"), "_place")).alias("_f")).select("source_key", F.col("_f._place").alias("_fill"))
    )
    parts = saved(ends.join(fills, "source_key", "left").select("source_key", "_part", "_until", "_fill"))
    quotas = saved(
        laid.groupBy("source_key").agg(F.count(F.when(F.col("_whole"), 1)).alias("_n")).join(parts.select("source_key", F.lit(1).alias("_one")), "source_key", "left")
        .select("source_key", F.col("_n").alias("_wholes"), (F.col("_n") + F.coalesce("_one", F.lit(0))).cast("long").alias("quota"))
    )
    split = saved(quotas.join(split_blocks(quotas.select("source_key", "quota"), shards, seed), "source_key"))
    shard = lambda draw: F.size(F.filter("ends", lambda end: end <= draw))
    per_round = blocks.groupBy("source_key").agg(F.count(F.lit(1)).alias("_blocks"))
    draws = laid.where("_whole").join(split, "source_key").join(per_round, "source_key").select("source_key", "_block", F.struct("_round", shard(F.col("_round") * F.col("_blocks") + F.col("_at")).alias("shard")).alias("_draw"))
    drawn = draws.groupBy("source_key", "_block").agg(F.transform(F.array_sort(F.collect_list("_draw")), lambda d: d["shard"]).alias("_shards"))  # at most ``cap`` each
    sources = wanted.join(parts, "source_key", "left").join(split, "source_key", "left").select("source_key", "source_size", "target", "_part", "_until", "_fill", shard(F.col("_wholes")).alias("_part_shard"))
    return saved(sources), saved(blocks.select("source_key", "_block").join(drawn, ["source_key", "_block"], "left"))


def _taken(rows: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """``rows`` (source_key, _block, _place, ...) with source_size, target and shards, where each copy goes."""
    some = F.coalesce("_shards", F.array().cast("array<int>"))
    partly = ((F.col("_block") == F.col("_part")) & (F.col("_place") <= F.col("_until"))) | (F.col("_place") == F.col("_fill"))
    found = rows.join(blocks, ["source_key", "_block"], "left").join(sources, "source_key", "left")
    return found.withColumn("shards", F.when(F.coalesce(partly, F.lit(False)), F.array_append(some, F.col("_part_shard"))).otherwise(some)).drop("_shards", "_part", "_until", "_fill", "_part_shard")


def mix_sources(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 20) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, copies, shards.

    A source's rows make blocks by hash.  Its quota of blocks follows from its target: all blocks in
    whole rounds, some more in a last one, and part of one more block, with one row that best fills
    what is still missing.  So a source misses its target by less than a row, and no row is taken
    more than ``cap`` times.  A splitting tree deals the quotas to ``shards`` shards (a power of two);
    a row goes where the draws of its block go, and ``shards`` has the shard of each copy.  Null text:
    size 0.  Null source: a source of its own.  Rows are told apart by key, text and, where these are
    equal too, a number.  An empty table gives none.  The number of sources is taken to be a
    catalogue's: one row of the tree holds a count for each.
    """
    rows = _numbered(df, key, text, source, seed)
    out = _taken(rows, *_drawn(rows, weights, cap, shards, seed))
    copies = F.size("shards")
    return out.select("doc_id", "source", "size", F.col("source_size").cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * copies).cast("long").alias("taken"), copies.alias("copies"), "shards")


def mixed_rows(df: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, shards: int = 16, seed: int = 20) -> DataFrame:
    """The rows of ``df``, each as often as the mix takes it: the columns of ``df`` as row, and shard and place (sort each shard by place for a local shuffle).

    Where a row goes follows from itself and the small tables of sources and blocks, so texts are not
    shuffled.  Only rows of which others may have the same key, source and text are numbered, in
    the order of a hash of their other columns, one group of such rows in one task.
    """
    rows = _numbered(df, key, text, source, seed)
    sources, blocks = _drawn(rows, weights, cap, shards, seed)
    own = carried(df, key, source_key=_source_key(df[source]))
    equal = saved(rows.where("_number = 1").select(F.xxhash64(F.col("doc_id").cast("string"), "source_key").alias("_pair"), "doc_id", "source_key", "_digest"))
    own = maybe_among(own.withColumn("_pair", F.xxhash64(F.col("_key").cast("string"), "source_key")), "_pair", equal.select("_pair"))
    own = own.withColumn("_digest", text_digest(F.col(f"_row.`{text}`")))
    single, doubt = own.where("not _maybe").withColumn("_number", F.lit(0)), own.where("_maybe")
    others = [F.col(f"_row.`{c}`") for c, kind in df.dtypes if c != text and "map<" not in kind and "variant" not in kind]
    turn = Window.partitionBy("_key", "source_key", "_digest").orderBy(F.xxhash64(*others) if others else F.lit(0))
    if not equal.isEmpty():  # else there are no texts to bring together
        single = single.unionByName(doubt.withColumn("_number", F.row_number().over(turn) - 1))
    placed = single.withColumn("_place", _placed(F.col("_key"), F.col("_digest"), F.col("_number"), seed)).withColumn("_block", _hex(F.col("_place"), 1, 2))
    taken = _taken(placed.select("_row", "source_key", "_place", "_block"), sources, blocks)
    return taken.select(F.col("_row").alias("row"), "_place", F.posexplode("shards").alias("_copy", "shard")).select("row", "shard", F.xxhash64(F.lit(seed + 1), "shard", "_place", "_copy").alias("place"))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix takes each document and which shards it goes to; null text: size 0, null source: one of its own, repeated rows are told apart, no rows of an empty table."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")
