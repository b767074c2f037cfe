"""Criteria of gates: coverage, thresholds and convergence, each with a reason and never passing on an empty scope."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows


def coverage_status(scope: DataFrame, key: str, covered: DataFrame, by: str) -> DataFrame:
    """One row (scope_n, uncovered, status): vacuous for an empty scope, else pass or fail."""
    bare = scope.join(covered.select(F.col(by).alias(key)).distinct().withColumn("hit", F.lit(1)), key, "left")
    n = bare.agg(F.count("*").alias("scope_n"), F.count_if(F.col("hit").isNull()).alias("uncovered"))
    return n.withColumn("status", F.when(F.col("scope_n") == 0, "vacuous").when(F.col("uncovered") > 0, "fail").otherwise("pass"))


def over_threshold(df: DataFrame, key: str, value: Column, most: float) -> DataFrame:
    """(witness, why) of rows over the limit; an absent value fails."""
    return df.where(value.isNull() | (value > most)).select(F.col(key).alias("witness"), F.when(value.isNull(), "value absent").otherwise("over the limit").alias("why"))


def novelty(found: DataFrame, by: list[str], repeated: Column) -> DataFrame:
    """(by, fresh, repeats, novelty decimal(5,4), state). passes (by) without findings have a null novelty, which satisfies no comparison."""
    n = found.groupBy(*by).agg(F.count_if(F.col("has_finding") & ~repeated).alias("fresh"), F.count_if(F.col("has_finding") & repeated).alias("repeats"))
    total = F.col("fresh") + F.col("repeats")
    return n.withColumns({"novelty": F.when(total > 0, F.col("fresh") / total).cast("decimal(5,4)"), "state": F.when(total > 0, "defined").otherwise("undefined_no_findings")})


def converged(passes: DataFrame, subject: str, order: list[str], bad: Column, classification: str, blocked: DataFrame, streak: int = 3, token: str = "NITPICK_ONLY") -> DataFrame:
    """(subject, streak, reason): the first clause that fails, or converged. blocked holds the subjects with open regressions or deferrals."""
    tail = windows.trailing_streak(passes, [subject], order, bad)
    last = passes.groupBy(subject).agg(F.max_by(classification, F.struct(*order)).alias("last"))
    stopped = blocked.select(subject).distinct().withColumn("stopped", F.lit(True))
    j = tail.join(last, subject).join(stopped, subject, "left")
    reason = F.when(F.col("streak") < streak, "1 streak too short").when(~F.col("last").eqNullSafe(F.lit(token)), "2 last pass is substantive").when(F.col("stopped"), "3 open regression or deferral").otherwise("converged")
    return j.select(subject, "streak", reason.alias("reason"))


def missing_inputs(templates: DataFrame, values: DataFrame) -> DataFrame:
    """(template, field) that a template needs and values (template, field, value) leave out or empty."""
    given = values.where("coalesce(value, '') <> ''").select("template", "field")
    return templates.where("required").select("template", "field").join(given, ["template", "field"], "left_anti")


def instantiated(templates: DataFrame, bodies: DataFrame, values: DataFrame) -> DataFrame:
    """(template, body) with {field} replaced, for templates that miss no required field."""
    refused = missing_inputs(templates, values).select("template").distinct()
    own = values.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("field", "value"))).alias("pairs"))
    filled = F.aggregate(F.coalesce("pairs", F.array().cast("array<struct<field:string,value:string>>")), F.col("body"), lambda b, p: F.replace(b, F.concat(F.lit("{"), p["field"], F.lit("}")), F.coalesce(p["value"], F.lit(""))))
    return bodies.join(refused, "template", "left_anti").join(own, "template", "left").select("template", filled.alias("body"))


def amended(records: DataFrame, key: str, changes: DataFrame, allowed: list[str], version: str) -> DataFrame:
    """records with allowed columns taken from changes where set, and the minor version raised once for a record that changes."""
    own = changes.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in allowed])
    j = records.join(own, key, "left")
    differs = F.lit(False)
    for c in allowed:
        differs = differs | (F.col(f"new_{c}").isNotNull() & ~F.col(c).eqNullSafe(F.col(f"new_{c}")))
    raised = F.concat(F.split_part(version, F.lit("."), F.lit(1)), F.lit("."), (F.split_part(version, F.lit("."), F.lit(2)).cast("int") + 1).cast("string"))
    columns = [F.coalesce(F.col(f"new_{c}"), F.col(c)).alias(c) if c in allowed else F.when(differs, raised).otherwise(F.col(version)).alias(c) if c == version else F.col(c) for c in records.columns]
    return j.select(*columns)


def trace_state(declared: Column, gap: Column, target: Column, exists: Column, ambiguous: Column) -> Column:
    """One of six states; none is folded into another."""
    return F.when(declared.isNull(), "undeclared").when(gap, "declared-gap").when(target.isNull() | (target == ""), "declared-empty").when(ambiguous, "unresolvable").when(exists, "satisfied").otherwise("dangling")
