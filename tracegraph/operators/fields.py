"""Entity-attribute-value rows from wide ones and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def to_fields(wide: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, field, v_text) without rows for nulls; one pass, no shuffle."""
    own = wide.select(*keys, *[F.col(c).cast("string").alias(c) for c in columns])
    return own.unpivot(keys, columns, "field", "v_text").where("v_text IS NOT NULL")


def to_wide(fields: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The pivot with its columns named, so that one pass is enough."""
    return fields.groupBy(*keys).pivot("field", columns).agg(F.max("v_text"))
