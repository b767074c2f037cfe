"""Positional logic over events and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows
from .base import Tables, query

_W = "PARTITION BY user_id ORDER BY ts, event_id"
BY, ORDER = ["user_id"], ["ts", "event_id"]


@query("win01_fill", f"SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading FROM events")
def fill(t: Tables):
    value = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return t.events.select("event_id", windows.fill_down(value, BY, ORDER).alias("heading"))


@query("win02_lookahead", f"""
WITH g AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS grp FROM events)
SELECT event_id, first_value(CASE WHEN value > 50 THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id, grp ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS attribute FROM g""")
def lookahead(t: Tables):
    from pyspark.sql import Window

    grp = F.sum((F.col("event_type") == "purchase").cast("int")).over(Window.partitionBy(*BY).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0))
    own = t.events.withColumn("grp", grp)
    return own.select("event_id", windows.look_ahead(F.when(F.col("value") > 50, F.col("event_id")), [*BY, "grp"], ORDER, 8).alias("attribute"))


@query("win03_lookahead_no_stop", f"SELECT event_id, first_value(CASE WHEN value > 90 THEN event_id END IGNORE NULLS) OVER ({_W} ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS attribute FROM events")
def lookahead_no_stop(t: Tables):
    return t.events.select("event_id", windows.look_ahead(F.when(F.col("value") > 90, F.col("event_id")), BY, ORDER, 8).alias("attribute"))


@query("win04_toggle", f"SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER ({_W} ROWS UNBOUNDED PRECEDING) % 2 = 1 AS inside FROM events")
def toggle(t: Tables):
    return t.events.select("event_id", windows.toggled(F.col("event_type") == "click", BY, ORDER).alias("inside"))


@query("win05_ordinals", "SELECT conv_id, turn, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS ord FROM conversations")
def ordinals(t: Tables):
    from pyspark.sql import Window

    return t.conversations.select("conv_id", "turn", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1).alias("ord"))


@query("win06_best_form", """
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'purchase' THEN 0 WHEN 'click' THEN 1 ELSE 2 END, ts, event_id) AS r FROM events) WHERE r = 1""")
def best_form(t: Tables):
    rank = F.when(F.col("event_type") == "purchase", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    return windows.next_by_status(t.events.withColumn("form", rank), BY, ["form", *ORDER], F.lit(True)).select("user_id", "event_id", "event_type")


@query("win07_streak", f"""
WITH b AS (SELECT user_id, sum(CASE WHEN value > 80 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS bad FROM events)
SELECT user_id, count(*) FILTER (bad = 0) AS streak FROM b GROUP BY 1""")
def streak(t: Tables):
    return windows.trailing_streak(t.events, BY, ORDER, F.col("value") > 80)


@query("win08_regression", f"SELECT event_id, previous FROM (SELECT event_id, value, lag(value) OVER ({_W}) AS previous FROM events) WHERE value > previous")
def regression(t: Tables):
    return windows.rises(t.events, "value", BY, ORDER).select("event_id", "previous")


@query("win09_last20", """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events)
SELECT user_id, CASE WHEN count(*) < 20 THEN 'error' WHEN count(*) FILTER (value > 95) > 0 THEN 'fail' ELSE 'pass' END AS status FROM l WHERE back <= 20 GROUP BY 1""")
def last20(t: Tables):
    return windows.last_rows_clean(t.events, BY, ORDER, F.col("value") > 95, 20)


@query("win10_chain", """
WITH c AS (SELECT conv_id, turn, turn AS a, CASE WHEN turn % 5 = 3 THEN turn + 2 ELSE turn + 1 END AS b FROM conversations), e AS (SELECT *, lag(b) OVER (PARTITION BY conv_id ORDER BY turn) AS expected FROM c)
SELECT conv_id, turn, expected FROM e WHERE expected IS NOT NULL AND a <> expected""")
def chain(t: Tables):
    own = t.conversations.select("conv_id", "turn", F.col("turn").alias("a"), (F.col("turn") + F.when(F.col("turn") % 5 == 3, 2).otherwise(1)).alias("b"))
    return windows.broken_chain(own, "a", "b", ["conv_id"], ["turn"]).select("conv_id", "turn", "expected")


@query("win11_next_action", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE r = 1")
def next_action(t: Tables):
    return windows.next_by_status(t.orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], F.col("o_orderstatus").isin("O", "P")).select("o_custkey", "o_orderkey")
