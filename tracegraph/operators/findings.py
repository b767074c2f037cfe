"""Findings: the one output schema of all gates, and the ratchet that compares them with a dated baseline.

A finding is (rule, subject, class, detail); rule and subject are its identity. No operator here caps its
output or sorts it; order is a matter of presentation.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "rule string, subject string, class string, detail string"
IDENTITY = ["rule", "subject"]


def findings(df: DataFrame, rule: str | Column, subject: Column, kind: str, detail: Column | str = "") -> DataFrame:
    """One finding for each row of df."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(as_column(rule).alias("rule"), subject.cast("string").alias("subject"), F.lit(kind).alias("class"), as_column(detail).alias("detail"))


def union(parts: Iterable[DataFrame]) -> DataFrame:
    """All findings of several gates, repeated ones too."""
    return reduce(lambda a, b: a.unionByName(b), parts)


def occurrences(found: DataFrame) -> DataFrame:
    """Repeated findings as one with a count; the smallest class and detail stand for the group."""
    return found.groupBy(*IDENTITY).agg(F.min("class").alias("class"), F.min("detail").alias("detail"), F.count("*").alias("occurrences"))


def replay(stored: DataFrame) -> DataFrame:
    """Stored findings as findings again; a count over one is shown in the detail."""
    detail = F.coalesce("detail", F.lit(""))
    return stored.select("rule", "subject", "class", F.when(F.col("occurrences") > 1, F.format_string("%s (x%d)", detail, F.col("occurrences"))).otherwise(detail).alias("detail"))


def by_class(found: DataFrame) -> DataFrame:
    """(class, n)."""
    return found.groupBy("class").agg(F.count("*").alias("n"))


def by_rule(found: DataFrame) -> DataFrame:
    """(rule, class, n), most frequent first."""
    return found.groupBy("rule", "class").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule", "class")


def ordered(found: DataFrame) -> DataFrame:
    """For reports: by class, rule and subject."""
    return found.orderBy("class", "rule", "subject")


def compare(found: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(rule, subject, class, status): new, kept or fixed against a baseline; without one everything is new."""
    now = occurrences(found).select(*IDENTITY, F.col("class").alias("now_class"))
    if baseline is None:
        return now.select(*IDENTITY, F.col("now_class").alias("class"), F.lit("new").alias("status"))
    then = occurrences(baseline).select(*IDENTITY, F.col("class").alias("then_class"))
    status = F.when(F.col("then_class").isNull(), "new").when(F.col("now_class").isNull(), "fixed").otherwise("kept")
    return now.join(then, IDENTITY, "full_outer").select(*IDENTITY, F.coalesce("now_class", "then_class").alias("class"), status.alias("status"))


def rebase(found: DataFrame, previous: DataFrame | None) -> DataFrame:
    """A new baseline (rule, subject, class, detail, waiver): waivers of findings that are still there are carried over."""
    now = occurrences(found).drop("occurrences")
    if previous is None:
        return now.withColumn("waiver", F.lit(None).cast("string"))
    kept = previous.where("waiver IS NOT NULL").groupBy(*IDENTITY).agg(F.min("waiver").alias("waiver"))
    return now.join(kept, IDENTITY, "left")


PASSED, FAILED, BROKEN = 0, 1, 2


def verdict(compared: DataFrame, strict: bool = False) -> tuple[int, dict[str, int]]:
    """Exit code and counts: PASSED where nothing is new, FAILED where something is; strict counts what the baseline tolerates too."""
    counts = {r["status"]: r["n"] for r in compared.groupBy("status").agg(F.count("*").alias("n")).collect()}
    return (FAILED if counts.get("new") or (strict and counts.get("kept")) else PASSED), counts


def judged(run, strict: bool = False) -> tuple[int, dict[str, int] | str]:
    """verdict() of what run gives, or BROKEN and the reason where it can't give any: a check that could not be made is no pass and no failure."""
    try:
        return verdict(run(), strict)
    except Exception as e:  # the answer
        return BROKEN, f"{type(e).__name__}: {e}"[:500]


def report(found: DataFrame, baseline: DataFrame | None, strict: bool = False, most: int = 20) -> DataFrame:
    """(ord, line) of a report for people: counts, at most `most` of the fixed findings and how many more, all new ones, the verdict."""
    compared = compare(found, baseline)
    n = compared.agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("new", "kept", "fixed")])
    waived = baseline.where("waiver IS NOT NULL").agg(F.count("*").alias("waived")) if baseline is not None and "waiver" in baseline.columns else n.select(F.lit(0).cast("long").alias("waived"))
    n = n.crossJoin(waived)
    head = F.format_string("new %d, kept %d, fixed %d, waived %d", "new", "kept", "fixed", "waived") if baseline is not None else F.format_string("no baseline: all %d findings are new", "new")
    every = F.concat_ws(" / ", "class", "rule", "subject")
    fixed = compared.where("status = 'fixed'").orderBy("class", "rule", "subject").limit(most)  # what a reader is shown
    line = lambda df, order, text: df.select(order.alias("ord"), text.alias("line"))
    failed = F.col("new") > 0 if not strict else (F.col("new") + F.col("kept")) > 0
    end = F.when(failed, F.format_string("FAIL: %d finding(s)", F.col("new") + (F.col("kept") if strict else F.lit(0)))).when(F.col("kept") > 0, F.format_string("PASS: %d finding(s) of the baseline are left", "kept")).otherwise("PASS: no findings")
    parts = [line(n, F.lit("0"), head), line(fixed, F.concat_ws(" ", F.lit("1"), every), F.concat(F.lit("fixed "), every)), line(n.where(F.col("fixed") > most), F.lit("2"), F.format_string("and %d more", F.col("fixed") - most)), line(compared.where("status = 'new'"), F.concat_ws(" ", F.lit("3"), every), F.concat(F.lit("new "), every)), line(n, F.lit("4"), end)]
    return union(parts)
