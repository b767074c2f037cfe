"""Changes of records that can be refused."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def retire(records: DataFrame, key: str, status: str, asked: DataFrame, references: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(records with status retired where asked (key) says so, refusals (key, reason)): what is unknown, retired already or still referenced from column isn't retired."""
    a = asked.select(F.col(key).alias("asked")).distinct()
    held = a.join(references.select(F.col(column).alias("asked")).distinct().withColumn("used", F.lit(True)), "asked", "left")
    judged = held.join(records.select(F.col(key).alias("asked"), F.col(status).alias("was"), F.lit(True).alias("known")), "asked", "left")
    reason = F.when(F.col("known").isNull(), "unknown").when(F.col("was") == "retired", "retired already").when(F.col("used"), "still referenced")
    judged = judged.select("asked", reason.alias("reason"))
    going = judged.where("reason IS NULL").select(F.col("asked").alias(key), F.lit(True).alias("going"))
    out = records.join(going, key, "left").withColumn(status, F.when(F.col("going"), "retired").otherwise(F.col(status)))
    return out.select(*records.columns), judged.where("reason IS NOT NULL").select(F.col("asked").alias(key), "reason")


def routed(ids: DataFrame, column: str, zones: dict[str, tuple[str, tuple[str, ...]]]) -> DataFrame:
    """ids with the type that an id's prefix names, the type's zone and the roles that may see it; an unknown type is in no zone and seen by nobody.

    zones: prefix to (zone, roles).
    """
    rows = [(k, zone, list(roles)) for k, (zone, roles) in zones.items()]
    table = ids.sparkSession.createDataFrame(rows, "type string, zone string, roles array<string>")
    return ids.withColumn("type", F.regexp_extract(column, r"^([A-Za-z]+)", 1)).join(F.broadcast(table), "type", "left").withColumn("roles", F.coalesce("roles", F.array().cast("array<string>")))
