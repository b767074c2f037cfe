"""Exact statistics that stay distributed: ranks come from counts of distinct values in two levels, never from one sorted partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def cumulated(df: DataFrame, value: str, width: float = 256.0) -> DataFrame:
    """(value, n, before): rows of each value and of all smaller ones.

    Values are counted, counts summed for stretches of width, and running sums made within stretches and over
    the few stretches; only the latter sees one partition.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    counts = counts.withColumn("stretch", F.floor(F.col("value") / width))
    stretches = counts.groupBy("stretch").agg(F.sum("n").alias("total"))
    before = stretches.withColumn("earlier", F.sum("total").over(Window.orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1))).select("stretch", F.coalesce("earlier", F.lit(0)).alias("earlier"))
    inside = F.sum("n").over(Window.partitionBy("stretch").orderBy("value").rowsBetween(Window.unboundedPreceding, -1))
    return counts.withColumn("inside", F.coalesce(inside, F.lit(0))).join(before, "stretch").select("value", "n", (F.col("inside") + F.col("earlier")).alias("before"))


def nearest_ranks(df: DataFrame, value: str, shares: list[float], width: float = 256.0) -> DataFrame:
    """(share, value): the element at position int(n * share) of the ascending values, counted from 0."""
    runs = cumulated(df, value, width)
    total = runs.agg(F.sum("n").alias("all_n"))
    wanted = total.select(F.explode(F.array([F.lit(s) for s in shares])).alias("share"), "all_n")
    wanted = wanted.select("share", F.least(F.col("all_n") - 1, F.floor(F.col("all_n") * F.col("share"))).alias("at"))
    return runs.join(F.broadcast(wanted), (F.col("at") >= F.col("before")) & (F.col("at") < F.col("before") + F.col("n"))).select("share", "value")


def auc(df: DataFrame, score: str, flag: str, width: float = 256.0) -> DataFrame:
    """(flagged, others, auc): how often a flagged row outranks another, ties half. One row."""
    both = df.where(F.col(score).isNotNull() & F.col(flag).isNotNull())
    runs = cumulated(both, score, width)
    hits = both.where(F.col(flag)).groupBy(F.col(score).alias("value")).agg(F.count("*").alias("hits"))
    sums = runs.join(hits, "value", "left").agg(F.sum("n").alias("n"), F.sum("hits").alias("flagged"), F.sum(F.col("hits") * (F.col("before") + (F.col("n") + 1) / 2)).alias("ranks"))
    others = F.col("n") - F.col("flagged")
    area = (F.col("ranks") - F.col("flagged") * (F.col("flagged") + 1) / 2) / (F.col("flagged") * others)
    return sums.select("flagged", others.alias("others"), F.round(area, 6).alias("auc"))


def coverage(df: DataFrame, covered: Column, by: list[str]) -> DataFrame:
    """(by, total, covered, percent)."""
    return df.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(covered).alias("covered")).withColumn("percent", F.round(F.try_divide(F.col("covered") * 100, F.col("total")), 4))


def required_fields(fields: DataFrame, kind: str, owner: str, group: str, share: float = 0.95, least: int = 3) -> DataFrame:
    """(kind, field) of fields present in at least share of the owners of each group that has least owners."""
    groups = fields.groupBy(kind, group).agg(F.count_distinct(owner).alias("owners")).where(F.col("owners") >= least)
    seen = fields.groupBy(kind, group, "field").agg(F.count_distinct(owner).alias("with_field"))
    good = seen.join(groups, [kind, group]).where(F.col("with_field") >= share * F.col("owners")).groupBy(kind, "field").agg(F.count("*").alias("good_groups"))
    return good.join(groups.groupBy(kind).agg(F.count("*").alias("all_groups")), kind).where("good_groups = all_groups").select(kind, "field")


def top(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n): the k most frequent, ties by key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc("n"), key).limit(k)


def _is(word: str):
    return lambda x: x == word


def ranked_search(docs: DataFrame, key: str, text: str, words: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(key, score): documents that hold any of the words, by BM25. Counting is built in; the corpus figures are one row."""
    tokens = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda x: x != "")
    own = docs.select(F.col(key).alias(key), tokens.alias("tokens"))
    own = settle(own.select(key, F.size("tokens").alias("length"), *[F.size(F.filter("tokens", _is(w))).alias(f"f{k}") for k, w in enumerate(words)]))  # narrow; the texts are read once
    figures = own.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(words))])
    joined = own.where(" OR ".join(f"f{k} > 0" for k in range(len(words)))).crossJoin(F.broadcast(figures))
    score = F.lit(0.0)
    for k in range(len(words)):
        idf = F.log(1 + (F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5))
        score = score + idf * F.col(f"f{k}") * (k1 + 1) / (F.col(f"f{k}") + k1 * (1 - b + b * F.col("length") / F.col("mean")))
    return joined.select(key, F.round(score, 6).alias("score"))
