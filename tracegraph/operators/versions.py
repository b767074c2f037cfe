"""Row and cell differences of two states of a table, histories, and three-way merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """(key, diff_type, changed): added, removed and modified rows, with the names of the changed columns, sorted."""
    columns = [c for c in before.columns if c not in key]
    a = before.select(*key, F.lit(True).alias("in_before"), *[F.col(c).alias(f"before_{c}") for c in columns])
    b = after.select(*key, F.lit(True).alias("in_after"), *[F.col(c).alias(f"after_{c}") for c in columns])
    changed = F.filter(F.array([F.when(~F.col(f"before_{c}").eqNullSafe(F.col(f"after_{c}")), F.lit(c)) for c in sorted(columns)]), lambda x: x.isNotNull())
    kind = F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "removed").otherwise("modified")
    both = a.join(b, key, "full_outer").withColumn("changed", changed).withColumn("diff_type", kind)
    return both.where((F.col("diff_type") != "modified") | (F.size("changed") > 0)).select(*key, "diff_type", F.when(F.col("diff_type") == "modified", F.array_join("changed", ",")).otherwise("").alias("changed"))


def as_of(changes: DataFrame, key: list[str], version: str, at) -> DataFrame:
    """State of an append-only change log: of each key the last row of a version not after at."""
    order = Window.partitionBy(*key).orderBy(F.desc(version))
    return changes.where(F.col(version) <= at).withColumn("back", F.row_number().over(order)).where("back = 1").drop("back")


def merge3(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: list[str]) -> DataFrame:
    """(key, columns, status, conflicts): cells changed on one side are taken, equal changes coalesce, others conflict and stay ours.

    status: merged or conflict; a row deleted on one side and untouched on the other goes; deleted here and changed there is a conflict.
    """
    columns = [c for c in base.columns if c not in key]
    side = lambda df, p: df.select(*key, F.lit(True).alias(f"in_{p}"), *[F.col(c).alias(f"{p}_{c}") for c in columns])
    j = side(base, "b").join(side(ours, "o"), key, "full_outer").join(side(theirs, "t"), key, "full_outer")
    same = lambda p, q, c: F.col(f"{p}_{c}").eqNullSafe(F.col(f"{q}_{c}"))
    changed = lambda p: ~(F.forall(F.array([same(p, "b", c) for c in columns]), lambda x: x))
    in_b, in_o, in_t = (F.coalesce(F.col(f"in_{p}"), F.lit(False)) for p in "bot")
    gone = in_b & ((~in_o & ~in_t) | (~in_o & in_t & ~changed("t")) | (in_o & ~in_t & ~changed("o")))
    half = in_b & ((~in_o & in_t & changed("t")) | (in_o & ~in_t & changed("o")))
    clash = {c: in_o & in_t & ~same("o", "t", c) & ~same("o", "b", c) & ~same("t", "b", c) for c in columns}
    if_new = ~in_b & in_o & in_t  # added on both sides: every differing cell conflicts
    clash = {c: F.when(if_new, ~same("o", "t", c)).otherwise(x) for c, x in clash.items()}
    value = {c: F.when(in_o & in_t, F.when(clash[c], F.col(f"o_{c}")).when(same("o", "b", c) & in_b, F.col(f"t_{c}")).otherwise(F.col(f"o_{c}"))).when(in_o, F.col(f"o_{c}")).otherwise(F.col(f"t_{c}")) for c in columns}
    names = F.filter(F.array([F.when(half, F.lit("*")), *[F.when(clash[c], F.lit(c)) for c in sorted(columns)]]), lambda x: x.isNotNull())
    return j.where(~gone).select(*key, *[value[c].alias(c) for c in columns], F.when(F.size(names) > 0, "conflict").otherwise("merged").alias("status"), F.array_join(names, ",").alias("conflicts"))


def refusals(requests: DataFrame, key: str, existing: DataFrame, rules: list[tuple[str, object]]) -> DataFrame:
    """requests with reason: the first rule (name, condition) that refuses a row, exists for a key that is there, null for an accepted one."""
    known = existing.select(F.col(key).alias("known_key")).distinct()
    reason = F.when(F.col("known_key").isNotNull(), "exists")
    for name, condition in rules:
        reason = reason.when(condition, name)
    return requests.join(known, F.col(key) == F.col("known_key"), "left").withColumn("reason", reason).drop("known_key")
