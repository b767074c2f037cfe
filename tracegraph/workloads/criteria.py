"""Criteria over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import criteria
from .base import Tables, query


@query("cri01_coverage_status", """
WITH c AS (SELECT count(*) AS scope_n, count(*) FILTER (c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)) AS uncovered FROM customer WHERE c_acctbal > 0)
SELECT *, CASE WHEN scope_n = 0 THEN 'vacuous' WHEN uncovered > 0 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def coverage_status(t: Tables):
    return criteria.coverage_status(t.customer.where("c_acctbal > 0").select("c_custkey"), "c_custkey", t.orders.where("o_totalprice > 400000"), "o_custkey")


@query("cri01_vacuous", "SELECT CAST(0 AS BIGINT) AS scope_n, CAST(0 AS BIGINT) AS uncovered, 'vacuous' AS status")
def vacuous(t: Tables):
    return criteria.coverage_status(t.customer.where("c_custkey < 0").select("c_custkey"), "c_custkey", t.orders, "o_custkey")


@query("cri05_threshold", "SELECT p_partkey AS witness, CASE WHEN p_size % 7 = 0 THEN 'value absent' ELSE 'over the limit' END AS why FROM part WHERE p_size % 7 = 0 OR p_size > 40")
def threshold(t: Tables):
    return criteria.over_threshold(t.part, "p_partkey", F.when(F.col("p_size") % 7 != 0, F.col("p_size")), 40)


@query("cri06_novelty", """
WITH f AS (SELECT user_id, count(*) FILTER (event_type = 'error' AND value >= 30) AS fresh, count(*) FILTER (event_type = 'error' AND value < 30) AS repeats FROM events GROUP BY 1)
SELECT user_id, fresh, repeats, CAST(CAST(CASE WHEN fresh + repeats > 0 THEN fresh / (fresh + repeats) END AS DECIMAL(5, 4)) AS DOUBLE) AS novelty, CASE WHEN fresh + repeats > 0 THEN 'defined' ELSE 'undefined_no_findings' END AS state FROM f""")
def novelty(t: Tables):
    return criteria.novelty(t.events.withColumn("has_finding", F.col("event_type") == "error"), ["user_id"], F.col("value") < 30).withColumn("novelty", F.col("novelty").cast("double"))


@query("cri07_converged", """
WITH b AS (SELECT user_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS bad FROM events),
s AS (SELECT user_id, count(*) FILTER (bad = 0) AS streak FROM b GROUP BY 1), l AS (SELECT user_id, arg_max(CASE WHEN value < 60 THEN 'NITPICK_ONLY' ELSE 'SUBSTANTIVE' END, (ts, event_id)) AS last FROM events GROUP BY 1)
SELECT user_id, streak, CASE WHEN streak < 3 THEN '1 streak too short' WHEN last <> 'NITPICK_ONLY' THEN '2 last pass is substantive' WHEN user_id % 5 = 0 THEN '3 open regression or deferral' ELSE 'converged' END AS reason FROM s JOIN l USING (user_id)""")
def converged(t: Tables):
    passes = t.events.withColumn("verdict", F.when(F.col("value") < 60, "NITPICK_ONLY").otherwise("SUBSTANTIVE"))
    return criteria.converged(passes, "user_id", ["ts", "event_id"], F.col("event_type") == "error", "verdict", t.events.where("user_id % 5 = 0").select("user_id"))


@query("wrt02_amend", """
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'AMENDED' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_custkey % 4 = 0 THEN 'v1.' || (c_nationkey + 1) ELSE 'v1.' || c_nationkey END AS version FROM customer""")
def amend(t: Tables):
    own = t.customer.select("c_custkey", "c_mktsegment", F.concat(F.lit("v1."), F.col("c_nationkey").cast("string")).alias("version"))
    changes = t.customer.where("c_custkey % 4 = 0").select("c_custkey", F.lit("AMENDED").alias("c_mktsegment"))
    return criteria.amended(own, "c_custkey", changes, ["c_mktsegment"], "version")


@query("wrt10_instantiate", """
SELECT CAST(p_partkey AS VARCHAR) AS template, p_name || ' of ' || p_brand AS body FROM part WHERE p_size % 3 <> 0""")
def instantiate(t: Tables):
    key = F.col("p_partkey").cast("string").alias("template")
    needs = t.part.select(key, F.explode(F.array(F.lit("name"), F.lit("brand"))).alias("field"), F.lit(True).alias("required"))
    values = t.part.select(key, F.explode(F.array(F.struct(F.lit("name").alias("field"), F.col("p_name").alias("value")), F.struct(F.lit("brand").alias("field"), F.when(F.col("p_size") % 3 != 0, F.col("p_brand")).alias("value")))).alias("s")).select("template", "s.field", "s.value")
    return criteria.instantiated(needs, t.part.select(key, F.lit("{name} of {brand}").alias("body")), values)


@query("cri08_trace_states", """
SELECT CASE WHEN k = 0 THEN 'undeclared' WHEN k = 1 THEN 'declared-gap' WHEN k = 2 THEN 'declared-empty' WHEN k = 3 THEN 'unresolvable' WHEN p_size <= 25 THEN 'satisfied' ELSE 'dangling' END AS state, count(*) AS n
FROM (SELECT l_orderkey % 6 AS k, p_size FROM lineitem JOIN part ON p_partkey = l_partkey) GROUP BY 1""")
def trace_states(t: Tables):
    k = F.col("l_orderkey") % 6
    held = t.part.where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.lit(True).alias("held"))
    j = t.lineitem.select("l_orderkey", "l_partkey").join(held, "l_partkey", "left")
    state = criteria.trace_state(F.when(k != 0, F.lit(1)), k == 1, F.when(k != 2, F.col("l_partkey").cast("string")), F.coalesce("held", F.lit(False)), k == 3)
    return j.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


@query("bas01_build", "SELECT class, count(*) AS n FROM (SELECT DISTINCT CASE WHEN o_totalprice > 400000 THEN 'count' ELSE 'type' END AS class, o_custkey FROM orders WHERE o_totalprice > 300000 AND o_orderstatus = 'F') GROUP BY 1")
def baseline_counts(t: Tables):
    from ..operators import findings as fd

    found = t.orders.where("o_totalprice > 300000 AND o_orderstatus = 'F'").select(F.when(F.col("o_totalprice") > 400000, "count").otherwise("type").alias("class"), "o_custkey")
    return fd.by_class(fd.occurrences(found.select(F.concat(F.lit("large/"), F.col("class")).alias("rule"), F.col("o_custkey").cast("string").alias("subject"), "class", F.lit("").alias("detail"))))


@query("src01_census", "SELECT source AS folder, count(*) AS files, count(*) FILTER (text LIKE 'T%') AS matched, count(*) FILTER (NOT text LIKE 'T%') AS skipped FROM documents GROUP BY 1")
def census(t: Tables):
    hit = F.col("text").startswith("T")
    return t.documents.groupBy(F.col("source").alias("folder")).agg(F.count("*").alias("files"), F.count_if(hit).alias("matched"), F.count_if(~hit).alias("skipped"))


@query("src02_census_findings", "SELECT 'folder holds none of its pattern' AS rule, source AS subject, 'integrity' AS class, '' AS detail FROM documents GROUP BY 2 HAVING count(*) FILTER (regexp_matches(text, '^[QXZ]')) = 0")
def census_findings(t: Tables):
    from ..operators import findings as fd

    n = t.documents.groupBy("source").agg(F.count_if(F.col("text").rlike("^[QXZ]")).alias("matched"))
    return fd.findings(n.where("matched = 0"), "folder holds none of its pattern", F.col("source"), "integrity")


@query("snk07_refs_csv", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' ORDER BY ALL LIMIT 100")
def refs_csv(t: Tables):
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.where("l_returnflag = 'R'").select(*columns).orderBy(*columns).limit(100)


@query("snk12_render_check", "SELECT 'c/' || c_custkey AS path, CASE WHEN c_custkey % 7 = 0 THEN 'missing' ELSE 'edited' END AS status FROM customer WHERE c_custkey % 7 = 0 OR c_custkey % 11 = 0")
def render_check(t: Tables):
    from ..sources import files

    path = F.concat(F.lit("c/"), F.col("c_custkey").cast("string")).alias("path")
    want = t.customer.select(path, F.col("c_name").alias("body"))
    have = t.customer.where("c_custkey % 7 <> 0").select(path, F.when(F.col("c_custkey") % 11 == 0, "by hand").otherwise(F.col("c_name")).alias("body"))
    return files.render_check(want, have)
