"""States of tables over time: as-of reads, histories, differences, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import versions
from .base import Tables, query

AT = "2024-01-15 00:00:00"


@query("src10_asof", f"SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value FROM events WHERE ts <= TIMESTAMP '{AT}' GROUP BY 1")
def asof(t: Tables):
    log = t.events.select("user_id", "event_type", "value", F.struct("ts", "event_id").alias("version"))
    cut = log.where(F.col("version")["ts"] <= F.lit(AT).cast("timestamp_ntz"))
    return versions.as_of(cut, ["user_id"], "version", F.struct(F.lit("9999-01-01").cast("timestamp_ntz").alias("ts"), F.lit(0).cast("long").alias("event_id"))).select("user_id", "event_type", "value")


@query("src12_history", "SELECT event_id, ts, event_type, lag(event_type) OVER (ORDER BY ts, event_id) AS before FROM events WHERE user_id = 7")
def history(t: Tables):
    from pyspark.sql import Window

    own = t.events.where("user_id = 7")
    return own.select("event_id", "ts", "event_type", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("before"))


def _sides(t: Tables):
    c = t.customer.select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("c_custkey")
    ours = c.where(k % 17 != 0).select("c_custkey", F.when(k % 5 == 0, F.lit(99)).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    theirs = c.where(k % 19 != 0).select("c_custkey", F.when(k % 7 == 0, F.when(k % 2 == 0, F.lit(99)).otherwise(F.lit(98))).otherwise(F.col("c_nationkey")).alias("c_nationkey"), F.when(k % 3 == 0, F.lit("X")).otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return c, ours, theirs


_SIDES = """WITH b AS (SELECT c_custkey AS k, c_nationkey AS n, c_mktsegment AS m FROM customer),
o AS (SELECT k, CASE WHEN k % 5 = 0 THEN 99 ELSE n END AS n, m FROM b WHERE k % 17 <> 0),
t AS (SELECT k, CASE WHEN k % 7 = 0 THEN CASE WHEN k % 2 = 0 THEN 99 ELSE 98 END ELSE n END AS n, CASE WHEN k % 3 = 0 THEN 'X' ELSE m END AS m FROM b WHERE k % 19 <> 0)"""


@query("src13_diff", f"""{_SIDES}, j AS (SELECT coalesce(o.k, t.k) AS c_custkey, o.k AS ok, t.k AS tk, concat_ws(',', CASE WHEN o.m IS DISTINCT FROM t.m THEN 'c_mktsegment' END, CASE WHEN o.n IS DISTINCT FROM t.n THEN 'c_nationkey' END) AS changed FROM o FULL JOIN t ON o.k = t.k)
SELECT c_custkey, CASE WHEN ok IS NULL THEN 'added' WHEN tk IS NULL THEN 'removed' ELSE 'modified' END AS diff_type, CASE WHEN ok IS NOT NULL AND tk IS NOT NULL THEN changed ELSE '' END AS changed FROM j WHERE ok IS NULL OR tk IS NULL OR changed <> ''""")
def diff(t: Tables):
    _, ours, theirs = _sides(t)
    return versions.diff(ours, theirs, ["c_custkey"])


@query("src14_log_join", "SELECT event_type, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, min(event_id) AS first_event FROM events GROUP BY 1, 2")
def log_join(t: Tables):
    commits = t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.min("event_id").alias("commit"))
    own = t.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")).join(commits, "day")
    return own.groupBy("event_type", "day").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"))


@query("wrt06_merge3", f"""{_SIDES}, j AS (SELECT b.k, b.n AS bn, b.m AS bm, o.k AS ok, o.n AS n1, o.m AS m1, t.k AS tk, t.n AS n2, t.m AS m2 FROM b LEFT JOIN o ON o.k = b.k LEFT JOIN t ON t.k = b.k),
x AS (SELECT *, ok IS NOT NULL AND (n1 <> bn OR m1 <> bm) AS oc, tk IS NOT NULL AND (n2 <> bn OR m2 <> bm) AS tc FROM j WHERE NOT (ok IS NULL AND tk IS NULL)),
y AS (SELECT * FROM x WHERE NOT (ok IS NULL AND NOT tc) AND NOT (tk IS NULL AND NOT oc)),
z AS (SELECT *, ok IS NOT NULL AND tk IS NOT NULL AS two, ok IS NULL OR tk IS NULL AS half FROM y)
SELECT k AS c_custkey, CASE WHEN two THEN CASE WHEN n1 = bn THEN n2 ELSE n1 END WHEN ok IS NOT NULL THEN n1 ELSE n2 END AS c_nationkey, CASE WHEN two THEN CASE WHEN m1 = bm THEN m2 ELSE m1 END WHEN ok IS NOT NULL THEN m1 ELSE m2 END AS c_mktsegment,
CASE WHEN half OR (n1 <> n2 AND n1 <> bn AND n2 <> bn) THEN 'conflict' ELSE 'merged' END AS status, CASE WHEN half THEN '*' WHEN n1 <> n2 AND n1 <> bn AND n2 <> bn THEN 'c_nationkey' ELSE '' END AS conflicts FROM z""")
def merge3(t: Tables):
    return versions.merge3(*_sides(t), ["c_custkey"])


@query("wrt01_refusals", """
SELECT r.k AS c_custkey, CASE WHEN c.c_custkey IS NOT NULL THEN 'exists' WHEN r.k % 4 = 0 THEN 'no subsystem' WHEN r.k % 4 = 1 THEN 'bad id' END AS reason
FROM (SELECT c_custkey * 3 AS k FROM customer) r LEFT JOIN customer c ON c.c_custkey = r.k""")
def refusals(t: Tables):
    requests = t.customer.select((F.col("c_custkey") * 3).alias("c_custkey"))
    existing = t.customer.select(F.col("c_custkey"))
    return versions.refusals(requests, "c_custkey", existing, [("no subsystem", F.col("c_custkey") % 4 == 0), ("bad id", F.col("c_custkey") % 4 == 1)])
