"""Retry planning: which references to merge, to skip for now and to put aside, from the state of earlier runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS, BASE, CAP = 3, 1, 64
PERMANENT = r"(?i)conflict|schema|constraint|duplicate key|not a valid|corrupt"


def failure_kind(error: Column) -> Column:
    """none, permanent or transient."""
    return F.when(F.coalesce(F.trim(error), F.lit("")) == "", "none").when(error.rlike(PERMANENT), "permanent").otherwise("transient")


def backoff(failures: Column, base: int = BASE, cap: int = CAP) -> Column:
    """Runs to wait after so many failures: doubled each time, capped."""
    doubled = F.pow(F.lit(2.0), F.least(failures, F.lit(30)).cast("double") - 1) * base
    return F.when(failures <= 0, F.lit(0)).otherwise(F.least(F.lit(float(cap)), doubled)).cast("int")


def plan(present: DataFrame, state: DataFrame, run: int, attempts: int = ATTEMPTS, base: int = BASE, cap: int = CAP) -> DataFrame:
    """(ref, action, reason) for each present ref; state (ref, attempts, last_run, last_error) of absent refs is ignored."""
    s = state.select("ref", "attempts", "last_run", failure_kind(F.col("last_error")).alias("kind"))
    wait = backoff(F.col("attempts"), base, cap)
    action = (
        F.when(F.coalesce("attempts", F.lit(0)) == 0, "merge")
        .when(F.col("kind") == "permanent", "quarantine")
        .when(F.col("attempts") >= attempts, "quarantine")
        .when(F.lit(run) - F.col("last_run") < wait, "skip")
        .otherwise("merge")
    )
    reason = (
        F.when(F.coalesce("attempts", F.lit(0)) == 0, "no failure so far")
        .when(F.col("kind") == "permanent", "permanent failure")
        .when(F.col("attempts") >= attempts, F.format_string("%d attempts", F.col("attempts")))
        .when(F.lit(run) - F.col("last_run") < wait, F.format_string("waits until run %d", (F.col("last_run") + wait).cast("int")))
        .otherwise("retry")
    )
    return present.select("ref").distinct().join(s, "ref", "left").select("ref", action.alias("action"), reason.alias("reason"))


def record_failure(state: DataFrame, failed: DataFrame, run: int) -> DataFrame:
    """State after a run: failed (ref, error) adds an attempt; refs that are new to the state join it."""
    f = failed.groupBy("ref").agg(F.min("error").alias("error"))
    joined = state.select("ref", "attempts", "last_run", "last_error").join(f, "ref", "full_outer")
    hit = F.col("error").isNotNull()
    return joined.select("ref", (F.coalesce("attempts", F.lit(0)) + F.when(hit, 1).otherwise(0)).alias("attempts"), F.when(hit, F.lit(run)).otherwise(F.col("last_run")).alias("last_run"), F.coalesce("error", "last_error").alias("last_error"))


def quarantine_name(ref: Column) -> Column:
    """Where a ref is moved to when it is put aside."""
    return F.concat(F.lit("quarantine/"), F.regexp_replace(ref, "^.*/", ""))
