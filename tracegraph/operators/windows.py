"""Positional logic over ordered rows of one owner; every window is partitioned, so no task sees more than an owner's rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def fill_down(value: Column, by: list[str], order: list[str]) -> Column:
    """The last value that was set, so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def look_ahead(value: Column, by: list[str], order: list[str], rows: int) -> Column:
    """The first value set in this row and the next ones, rows in all."""
    return F.first(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(0, rows - 1))


def toggled(mark: Column, by: list[str], order: list[str]) -> Column:
    """Is an odd number of marks so far: inside what a pair of marks encloses."""
    return F.sum(mark.cast("int")).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) % 2 == 1


def trailing_streak(df: DataFrame, by: list[str], order: list[str], bad: Column) -> DataFrame:
    """(by, streak): rows at the end of each owner that aren't bad."""
    back = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("bad_after", F.sum(bad.cast("int")).over(back)).groupBy(*by).agg(F.count_if(F.col("bad_after") == 0).alias("streak"))


def rises(df: DataFrame, value: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows whose value is over that of the row before, with it as previous."""
    return df.withColumn("previous", F.lag(value).over(Window.partitionBy(*by).orderBy(*order))).where(F.col(value) > F.col("previous"))


def last_rows_clean(df: DataFrame, by: list[str], order: list[str], bad: Column, n: int) -> DataFrame:
    """(by, status): error with under n rows, else pass or fail by the last n."""
    back = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    last = df.withColumn("back", F.row_number().over(back)).where(F.col("back") <= n)
    return last.groupBy(*by).agg(F.when(F.count("*") < n, "error").when(F.count_if(bad) > 0, "fail").otherwise("pass").alias("status"))


def broken_chain(df: DataFrame, start: str, end: str, by: list[str], order: list[str]) -> DataFrame:
    """Rows that don't start where the one before ended."""
    return df.withColumn("expected", F.lag(end).over(Window.partitionBy(*by).orderBy(*order))).where(F.col("expected").isNotNull() & ~F.col(start).eqNullSafe(F.col("expected")))


def next_by_status(df: DataFrame, by: list[str], order: list[str], status: Column) -> DataFrame:
    """The first row of each owner that the status holds for."""
    return df.where(status).withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("place = 1").drop("place")
