"""URL filters: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import saved

#: At most so many distinct URLs that a rule judges are learned from, half of either verdict, chosen by hash.
LEARNED = 20_000
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
FEATURES = ("n_url", "n_host", "n_path", "depth", "labels", "digits", "hyphens", "entropy", "parameters", "escapes", "suffix_rate", "suffix_share")
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """What follows the first :// up to /, ?, # or the end, with A-Z in lower case; null or no ://: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ?, # or the end; null or no ://: empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def rule_for(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest rule that fits the host or one of its parents and begins the path; null if none does.  Of equally long rules allow goes first."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0], r[1] + r[2]))
    cases = [((host == h) | host.endswith(f".{h}")) & path.startswith(p) for _, h, p in order]
    found = [F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")) for v, h, p in order]
    return reduce(lambda out, x: F.when(x[0], x[1]).otherwise(out), list(zip(cases, found, strict=True))[::-1], F.lit(None))


def lexical(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """Add the lexical features that a URL has by itself."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u)
    letters = F.split(u, "")
    part = lambda c: F.size(F.filter(letters, lambda x: x == c)) / n
    entropy = F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - F.when(part(c) > 0, part(c) * F.log2(part(c))).otherwise(0.0))
    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns({
        "n_url": n.cast("double"), "n_host": F.length(host).cast("double"), "n_path": F.length(path).cast("double"),
        "depth": F.regexp_count(F.col(path), F.lit("/[^/]")).cast("double"), "labels": F.regexp_count(F.col(host), F.lit(r"\.")).cast("double"),
        "digits": F.when(n > 0, F.regexp_count(u, F.lit("[0-9]")) / n).otherwise(0.0), "hyphens": F.regexp_count(F.col(host), F.lit("-")).cast("double"),
        "entropy": F.when(n > 0, entropy).otherwise(0.0), "parameters": F.when(query == "", 0.0).otherwise(F.regexp_count(query, F.lit("&")) + 1.0),
        "escapes": F.regexp_count(u, F.lit("%[0-9A-Fa-f]{2}")).cast("double"), "_suffix": F.substring_index(F.col(host), ".", -2),
    })


def judge_urls(df: DataFrame, url: str = "url", keep: tuple[str, ...] = ("page_id",), rules: tuple[tuple[str, str, str], ...] = RULES, learned: int = LEARNED, threshold: float = 0.5) -> DataFrame:
    """One row per input row: the ``keep`` columns, host, path, rule, verdict, block_score.

    A URL that a rule fits gets the rule's verdict, and all such URLs are the labelled ones; the
    others get that of boosted trees learned from at most ``learned`` of them, at most half of either
    verdict; a URL that many rows hold counts once.  block_score is the
    trees' probability of block for any URL.  Suffix statistics (of the last two host labels: the
    share of blocks among the other labelled rows, smoothed, and the logged number of all) are taken over all rows.  Null URLs have
    empty parts and all features 0.  Where no rule fits any row the trees say allow, where
    all that fit say the same they say that.  Repeated rows stay; an empty table gives none.
    """
    rows = df.select(*keep, F.col(url).alias("_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows = lexical(rows.withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules)), "_url", "host", "path")
    block = F.when(F.col("_rule.verdict") == "block", 1.0).when(F.col("_rule.verdict").isNotNull(), 0.0)
    # Saved, so that it is sent to every task if it is small, and else the join can split a suffix that many rows share.
    suffixes = saved(rows.groupBy("_suffix").agg(F.coalesce(F.sum(block), F.lit(0.0)).alias("_blocked"), F.count(block).alias("_judged"), F.log1p(F.count(F.lit(1))).alias("suffix_share")))
    # A labelled row doesn't count itself, or the trees would read its label back.
    rate = ((F.col("_blocked") - F.coalesce("label", F.lit(0.0)) + 1) / (F.col("_judged") - F.when(F.col("label").isNotNull(), 1).otherwise(0) + 2)).alias("suffix_rate")
    rows = rows.withColumn("label", block)
    # A URL has one label and one set of features, so the sample is drawn of URLs; only the drawn ones are given their features.
    urls = rows.where("label is not null").select("_url", "label").distinct().select("_url", "label", F.xxhash64("_url").alias("_order"))
    drawn = [urls.where(F.col("label") == y).orderBy("_order", "_url").limit(learned // 2) for y in (0.0, 1.0)]
    drawn = drawn[0].union(drawn[1]).select("_url", "label").withColumns({"host": host_of(F.col("_url")), "path": path_of(F.col("_url"))})
    drawn = F.broadcast(lexical(drawn, "_url", "host", "path"))  # at most ``learned`` rows
    rows = rows.join(suffixes, "_suffix").select("*", rate)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    rows = assembler.transform(rows)
    sample = assembler.transform(suffixes.join(drawn, "_suffix").select("*", rate)).orderBy(F.xxhash64("_url"), "_url").select("features", "label").coalesce(1).cache()
    seen = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) == 2:
        trees = GBTClassifier(maxIter=12, maxDepth=4, maxBins=64, stepSize=0.3, seed=5).fit(sample)
        rows = trees.transform(rows).withColumn("block_score", vector_to_array("probability")[1])
    else:
        rows = rows.withColumn("block_score", F.lit(float(next(iter(seen), 0.0))))
    sample.unpersist()
    learnt = F.when(F.col("block_score") >= threshold, "block").otherwise("allow")
    return rows.select(*keep, "host", "path", F.col("_rule.rule").alias("rule"), F.coalesce("_rule.verdict", learnt).alias("verdict"), "block_score")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of all pages; a null url has empty parts, repeated rows are judged alike, no rows of an empty table."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))
