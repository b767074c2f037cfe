"""Integrity gates as queries: anti-joins, count comparisons and shape checks.

Each takes DataFrames and column names, so it serves any tables, and returns findings. References are made distinct before
they are looked up, so a reference that millions of rows share is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import shared
from .findings import findings, union


def dangling(edges: DataFrame, column: str, universe: DataFrame, key: str, rule: str) -> DataFrame:
    """References that no record answers, once each."""
    refs = edges.select(F.col(column).alias("ref")).where("ref IS NOT NULL").distinct()
    return findings(refs.join(universe.select(F.col(key).alias("ref")), "ref", "left_anti"), rule, F.col("ref"), "dangling")


def scalar_reference(records: DataFrame, key: str, column: str, universe: DataFrame, target: str, rule: str) -> DataFrame:
    """Records whose single reference is set and leads nowhere; universe may be the table itself."""
    own = records.select(F.col(key).alias("owner"), F.col(column).alias("ref")).where("ref IS NOT NULL")
    lost = own.join(universe.select(F.col(target).alias("ref")), "ref", "left_anti")
    return findings(lost, rule, F.concat_ws(" -> ", F.col("owner").cast("string"), F.substring(F.col("ref").cast("string"), 1, 60)), "dangling")


def enumeration(index: DataFrame, index_key: str, records: DataFrame, key: str, ghost: str = "index names a missing record", absent: str = "record absent from index") -> DataFrame:
    """Both directions of an index against its records; an empty index doesn't accuse every record."""
    listed, held = index.select(F.col(index_key).alias("id")).distinct(), records.select(F.col(key).alias("id")).distinct()
    some = listed.agg(F.count("*").alias("listed_n")).where("listed_n > 0")
    missing = held.join(listed, "id", "left_anti").crossJoin(F.broadcast(some)).drop("listed_n")
    return union([findings(listed.join(held, "id", "left_anti"), ghost, F.col("id"), "dangling"), findings(missing, absent, F.col("id"), "dangling")])


def one_directional(pairs: DataFrame, a: str, b: str, kind: str, rule: str = "dependency recorded on one side only") -> DataFrame:
    """(a, b, kind) rows without a reverse row of another kind."""
    d = pairs.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(kind).alias("kind"))
    r = pairs.select(F.col(a).alias("ra"), F.col(b).alias("rb"), F.col(kind).alias("rkind"))
    alone = d.join(r, (F.col("a") == F.col("rb")) & (F.col("b") == F.col("ra")) & (F.col("kind") != F.col("rkind")), "left_anti")
    return findings(alone, rule, F.concat_ws(" ", F.col("a").cast("string"), F.col("kind").cast("string"), F.col("b").cast("string")), "direction", "the reverse row is missing")


def malformed(records: DataFrame, key: str, pattern: str, rule: str) -> DataFrame:
    """Keys of a shape that the pattern doesn't cover."""
    return findings(records.where(~F.col(key).rlike(pattern)), rule, F.col(key), "integrity")


def duplicates(records: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """One finding with the number of surplus rows, where there are any. A count by key, not one distinct over all."""
    surplus = records.groupBy(*keys).agg((F.count("*") - 1).alias("more")).agg(F.sum("more").alias("more")).where("more > 0")
    return findings(surplus, rule, F.format_string("%d duplicate(s)", F.col("more")), "integrity")


def disagreement(joined: DataFrame, left: Column, right: Column, rule: str, subject: Column, detail: Column | str = "") -> DataFrame:
    """Rows of a join whose two sides state different values."""
    return findings(joined.where(left != right), rule, subject, "integrity", detail)


def count_claims(claims: DataFrame, actual: DataFrame, by: list[str], rule: str = "a stated count differs from the records") -> DataFrame:
    """claims (source, by..., claimed) against actual (by..., actual) in one join; a group without records counts 0."""
    joined = claims.join(actual, by, "left").withColumn("actual", F.coalesce("actual", F.lit(0).cast("long")))
    subject = F.concat_ws(" ", "source", *[F.col(c).cast("string") for c in by])
    return findings(joined.where("claimed <> actual"), rule, subject, "count", F.format_string("states %d, actual %d", F.col("claimed").cast("long"), F.col("actual").cast("long")))


def foreign_key_split(rows: DataFrame, key: list[str], parents: list[tuple[str, DataFrame, str]], rule: str) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, once each by key; findings for the refused ones)."""
    marked = rows
    for k, (column, parent, target) in enumerate(parents):
        known = parent.select(F.col(target).alias(f"known_{k}")).distinct()
        marked = marked.join(known, F.col(column) == F.col(f"known_{k}"), "left")
    held = [F.col(f"known_{k}").isNotNull() for k in range(len(parents))]
    everything = held[0]
    for h in held[1:]:
        everything = everything & h
    names = [F.col(c) for c in rows.columns]
    accepted = marked.where(everything).select(*names).dropDuplicates(key)
    refused = marked.where(~everything)
    return accepted, findings(refused, rule, F.concat_ws(" -> ", *[F.col(c).cast("string") for c in key]), "dangling")


def collisions(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """rows with place 1 for the winner of each key, the first by order; others lost to it."""
    return shared(rows, *key).withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)))


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return collisions(rows, key, order).where("place = 1").drop("place")
