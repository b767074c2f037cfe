"""Scans, filters, joins, aggregates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import fields, findings, integrity, quarantine, statistics
from .base import Tables, query

SOME_PARTS = "p_size <= 25"  #: a universe that doesn't hold every referenced part


@query("joi01_dangling_edges", f"""
SELECT DISTINCT 'lineitem.l_partkey -> part' AS rule, CAST(l_partkey AS VARCHAR) AS subject, 'dangling' AS class, '' AS detail
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND {SOME_PARTS})
UNION ALL SELECT DISTINCT 'lineitem.l_suppkey -> supplier', CAST(l_suppkey AS VARCHAR), 'dangling', ''
FROM lineitem l WHERE NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_suppkey AND s.s_acctbal > 0)
UNION ALL SELECT DISTINCT 'orders.o_custkey -> customer', CAST(o_custkey AS VARCHAR), 'dangling', ''
FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey AND c.c_acctbal > 0)""")
def dangling_edges(t: Tables):
    return findings.union([
        integrity.dangling(t.lineitem, "l_partkey", t.part.where(SOME_PARTS), "p_partkey", "lineitem.l_partkey -> part"),
        integrity.dangling(t.lineitem, "l_suppkey", t.supplier.where("s_acctbal > 0"), "s_suppkey", "lineitem.l_suppkey -> supplier"),
        integrity.dangling(t.orders, "o_custkey", t.customer.where("c_acctbal > 0"), "c_custkey", "orders.o_custkey -> customer"),
    ])


@query("joi02_index_enumeration", """
WITH i AS (SELECT DISTINCT o_custkey * 2 AS id FROM orders WHERE o_orderstatus = 'F')
SELECT 'index names a missing record' AS rule, CAST(id AS VARCHAR) AS subject, 'dangling' AS class, '' AS detail FROM i WHERE id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'record absent from index', CAST(c_custkey AS VARCHAR), 'dangling', '' FROM customer WHERE c_custkey NOT IN (SELECT id FROM i)""")
def index_enumeration(t: Tables):
    index = t.orders.where("o_orderstatus = 'F'").select((F.col("o_custkey") * 2).alias("id"))
    return integrity.enumeration(index, "id", t.customer, "c_custkey")


@query("joi03_scalar_refs", """
SELECT 'part.next -> part' AS rule, concat_ws(' -> ', CAST(a.p_partkey AS VARCHAR), CAST(a.p_partkey * 2 + 1 AS VARCHAR)) AS subject, 'dangling' AS class, '' AS detail
FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey * 2 + 1 WHERE a.p_size > 10 AND b.p_partkey IS NULL""")
def scalar_refs(t: Tables):
    own = t.part.withColumn("next", F.when(F.col("p_size") > 10, F.col("p_partkey") * 2 + 1))
    return integrity.scalar_reference(own, "p_partkey", "next", t.part, "p_partkey", "part.next -> part")


_PAIRS = "SELECT DISTINCT l_partkey AS a, l_suppkey AS b, l_returnflag AS k FROM lineitem"


@query("joi04_one_directional", f"""
WITH d AS ({_PAIRS}) SELECT 'dependency recorded on one side only' AS rule, concat_ws(' ', CAST(a AS VARCHAR), k, CAST(b AS VARCHAR)) AS subject, 'direction' AS class, 'the reverse row is missing' AS detail
FROM d WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.a = d.b AND r.b = d.a AND r.k <> d.k)""")
def one_directional(t: Tables):
    pairs = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.col("l_returnflag").alias("k")).distinct()
    return integrity.one_directional(pairs, "a", "b", "k")


@query("joi05_prefix_agreement", """
SELECT 'name disagrees with nation' AS rule, c_name || ' -> ' || n_name AS subject, 'integrity' AS class, 'registered under ' || CAST(n_nationkey AS VARCHAR) AS detail
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE CAST(split_part(c_name, '#', 2) AS INTEGER) % 25 <> n_nationkey""")
def prefix_agreement(t: Tables):
    j = t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    stated = F.expr("try_cast(substring_index(c_name, '#', -1) AS int)") % 25
    return integrity.disagreement(j, stated, F.col("n_nationkey"), "name disagrees with nation", F.concat_ws(" -> ", "c_name", "n_name"), F.concat(F.lit("registered under "), F.col("n_nationkey").cast("string")))


@query("joi06_undeclared_traces", """
SELECT DISTINCT o_custkey, l_partkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN customer ON c_custkey = o_custkey
WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM lineitem d JOIN orders e ON e.o_orderkey = d.l_orderkey WHERE d.l_returnflag <> 'R' AND d.l_partkey = lineitem.l_partkey AND e.o_custkey = orders.o_custkey)""")
def undeclared_traces(t: Tables):
    j = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), F.col("l_orderkey") == F.col("o_orderkey"))
    traced = j.where("l_returnflag = 'R'").select("o_custkey", "l_partkey").distinct().join(t.customer.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return traced.join(j.where("l_returnflag <> 'R'").select("o_custkey", "l_partkey"), ["o_custkey", "l_partkey"], "left_anti")


@query("joi07_refs_by_kind", f"""
SELECT 'a trace names a part with no record' AS rule, CAST(l_orderkey AS VARCHAR) || ' -> ' || CAST(l_partkey AS VARCHAR) AS subject, 'dangling' AS class, '' AS detail FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {SOME_PARTS})
UNION ALL SELECT 'a trace names a supplier with no record', CAST(l_orderkey AS VARCHAR) || ' -> ' || CAST(l_suppkey AS VARCHAR), 'dangling', '' FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""")
def refs_by_kind(t: Tables):
    parts = []
    for kind, column, universe, key in (("part", "l_partkey", t.part.where(SOME_PARTS), "p_partkey"), ("supplier", "l_suppkey", t.supplier.where("s_acctbal > 0"), "s_suppkey")):
        refs = t.lineitem.select("l_orderkey", F.col(column).alias("ref")).distinct()
        lost = refs.join(universe.select(F.col(key).alias("ref")), "ref", "left_anti")
        parts.append(findings.findings(lost, f"a trace names a {kind} with no record", F.concat_ws(" -> ", F.col("l_orderkey").cast("string"), F.col("ref").cast("string")), "dangling"))
    return findings.union(parts)


@query("joi08_cross_zone", """
SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def cross_zone(t: Tables):
    walled = t.events.select("user_id").distinct()  # ids only: no other column of the walled side is read
    return walled.join(t.customer.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id")), "user_id", "left_anti")


@query("joi09_full_chain", """
SELECT r_name, n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(*) AS lines,
  count(DISTINCT p_type) AS types, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, round(sum(l_extendedprice), 2) AS price
FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2""")
def full_chain(t: Tables):
    """Lines are added up by order where the join has them together; then customers, and what kinds of parts there are, once each by nation."""
    c = t.customer.join(F.broadcast(t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))), F.col("c_nationkey") == F.col("n_nationkey"))
    owned = t.orders.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey", "r_name", "n_name")
    lines = t.lineitem.join(t.supplier.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    by_order = lines.join(owned, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("r_name", "n_name", "o_orderkey").agg(
        F.count("*").alias("lines"), F.sum("l_extendedprice").alias("price"), F.collect_set("c_custkey").alias("owners"), F.collect_set(F.struct("p_type", "p_brand")).alias("kinds"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    row = lambda c, kind, n, lines, price: F.struct(c.alias("c_custkey"), kind.alias("kind"), n.alias("orders"), lines.alias("lines"), price.alias("price"))
    no_kind, nothing = F.struct(none("string").alias("p_type"), none("string").alias("p_brand")), (none("int"), none("long"), none("double"))
    rows = F.concat(F.array(row(none("long"), no_kind, F.lit(1), F.col("lines"), F.col("price"))), F.transform("owners", lambda c: row(c, no_kind, *nothing)), F.transform("kinds", lambda k: row(none("long"), k, *nothing)))
    each = by_order.select("r_name", "n_name", F.explode(rows).alias("x")).select("r_name", "n_name", "x.*")
    once = each.groupBy("r_name", "n_name", "c_custkey", "kind").agg(F.sum("orders").alias("orders"), F.sum("lines").alias("lines"), F.sum("price").alias("price"))
    return once.groupBy("r_name", "n_name").agg(
        F.count("c_custkey").alias("customers"), F.sum("orders").alias("orders"), F.sum("lines").alias("lines"), F.size(F.collect_set("kind.p_type")).cast("long").alias("types"),
        F.array_join(F.sort_array(F.collect_set("kind.p_brand")), ",").alias("brands"), F.round(F.sum("price"), 2).alias("price"),
    )


@query("joi10_rollup", """
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(DISTINCT o_orderkey) AS orders, count(DISTINCT l_partkey) AS parts
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'F' LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def rollup(t: Tables):
    j = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.orders.where("o_orderstatus = 'F'"), F.col("o_custkey") == F.col("c_custkey"), "left")
    j = j.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.groupBy("n_name").agg(F.count_distinct("c_custkey").alias("customers"), F.count_distinct("o_orderkey").alias("orders"), F.count_distinct("l_partkey").alias("parts"))


@query("joi11_coverage_exists", """
SELECT n_name, count(*) AS customers, CAST(sum(CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) THEN 1 ELSE 0 END) AS BIGINT) AS covered
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def coverage_exists(t: Tables):
    flag = t.orders.where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    j = t.customer.join(flag, "c_custkey", "left").join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(F.coalesce("hit", F.lit(False))).alias("covered"))


@query("joi12_correlated_counts", """
SELECT s_suppkey, (SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey) AS lines, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey) AS parts FROM supplier""")
def correlated_counts(t: Tables):
    per = t.lineitem.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("lines"), F.count_distinct("l_partkey").alias("parts"))
    zero = F.lit(0).cast("long")
    return t.supplier.select("s_suppkey").join(per, "s_suppkey", "left").select("s_suppkey", F.coalesce("lines", zero).alias("lines"), F.coalesce("parts", zero).alias("parts"))


@query("joi13_first_by_order", """
SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate, o_orderkey LIMIT 1) AS first_order FROM customer""")
def first_by_order(t: Tables):
    first = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("first_order"))
    return t.customer.select("c_custkey").join(first, "c_custkey", "left")


_CLAIMS = "SELECT 'nation ' || n_name AS source, n_nationkey AS key, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey - 6 ELSE 0 END AS claimed FROM nation"


@query("joi14_count_claims", f"""
SELECT 'a stated count differs from the records' AS rule, source || ' ' || key AS subject, 'count' AS class, 'states ' || claimed || ', actual ' || actual AS detail
FROM (SELECT c.*, (SELECT count(*) FROM customer WHERE c_nationkey = c.key) AS actual FROM ({_CLAIMS}) c) WHERE claimed <> actual""")
def count_claims(t: Tables):
    actual = t.customer.groupBy(F.col("c_nationkey").alias("key")).agg(F.count("*").alias("actual"))
    wrong = F.when(F.col("n_nationkey") % 3 == 0, F.col("n_nationkey") - 6).otherwise(0)
    claims = t.nation.join(actual.withColumnRenamed("key", "n_nationkey"), "n_nationkey", "left").select(F.concat(F.lit("nation "), F.col("n_name")).alias("source"), F.col("n_nationkey").alias("key"), (F.coalesce("actual", F.lit(0)) + wrong).alias("claimed"))
    return integrity.count_claims(claims, actual, ["key"])


@query("joi15_alignment", """
WITH i AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_quantity > 48 GROUP BY 1), r AS (SELECT p_partkey AS k FROM part WHERE p_size <= 40)
SELECT coalesce(i.k, r.k) AS k, CASE WHEN r.k IS NULL THEN 'row-without-record' WHEN i.k IS NULL THEN 'record-absent' WHEN n > 1 THEN 'row-duplicated' ELSE 'aligned' END AS status FROM i FULL JOIN r ON i.k = r.k""")
def alignment(t: Tables):
    i = t.lineitem.where("l_quantity > 48").groupBy(F.col("l_partkey").alias("k")).agg(F.count("*").alias("n"))
    r = t.part.where("p_size <= 40").select(F.col("p_partkey").alias("k"), F.lit(1).alias("held"))
    status = F.when(F.col("held").isNull(), "row-without-record").when(F.col("n").isNull(), "record-absent").when(F.col("n") > 1, "row-duplicated").otherwise("aligned")
    return i.join(r, "k", "full_outer").select("k", status.alias("status"))


def _by_year(t: Tables, after: str, before: str):
    return findings.findings(t.orders.where(f"o_orderdate >= '{after}' AND o_orderdate < '{before}' AND o_totalprice > 300000"), "large order", F.col("o_custkey"), "count")


@query("joi16_baseline_diff", """
WITH d AS (SELECT min(o_orderdate) AS lo FROM orders),
n AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_orderdate >= '1994-01-01' AND o_orderdate < '1997-01-01' AND o_totalprice > 300000),
b AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_orderdate >= '1992-01-01' AND o_orderdate < '1996-01-01' AND o_totalprice > 300000)
SELECT 'large order' AS rule, coalesce(n.subject, b.subject) AS subject, 'count' AS class, CASE WHEN b.subject IS NULL THEN 'new' WHEN n.subject IS NULL THEN 'fixed' ELSE 'kept' END AS status FROM n FULL JOIN b ON n.subject = b.subject""")
def baseline_diff(t: Tables):
    return findings.compare(_by_year(t, "1994-01-01", "1997-01-01"), _by_year(t, "1992-01-01", "1996-01-01"))


@query("joi17_version_lookup", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN p_size IS NULL THEN 'target-unknown' WHEN p_size = l_quantity THEN 'current' WHEN p_size < l_quantity THEN 'ahead-never-existed' WHEN l_returnflag = 'R' THEN 'lagging-pinned-ok' ELSE 'lagging-floating' END AS verdict, count(*) AS n
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey AND p_retailprice > 1000 GROUP BY 1, 2, 3, 4, 5""")
def version_lookup(t: Tables):
    known = t.part.where("p_retailprice > 1000").select(F.col("p_partkey").alias("l_partkey"), "p_size")
    cited = F.col("l_quantity")
    verdict = F.when(F.col("p_size").isNull(), "target-unknown").when(F.col("p_size") == cited, "current").when(F.col("p_size") < cited, "ahead-never-existed").when(F.col("l_returnflag") == "R", "lagging-pinned-ok").otherwise("lagging-floating")
    return t.lineitem.join(known, "l_partkey", "left").groupBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query("joi18_ambiguous_lookup", """
WITH k AS (SELECT p_brand || '/' || p_size AS key, count(DISTINCT p_type) AS owners, min(p_type) AS owner FROM part GROUP BY 1)
SELECT s_suppkey, CASE WHEN k.key IS NULL THEN 'dangling' WHEN owners > 1 THEN 'unresolvable' ELSE 'resolved' END AS status, CASE WHEN owners = 1 THEN owner END AS owner
FROM supplier LEFT JOIN k ON k.key = 'Brand#' || (s_suppkey % 5 + 1) || (s_nationkey % 6 + 1) || '/' || (s_suppkey % 50 + 1)""")
def ambiguous_lookup(t: Tables):
    keys = t.part.groupBy(F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("key")).agg(F.count_distinct("p_type").alias("owners"), F.min("p_type").alias("owner"))
    text = lambda c: c.cast("string")
    own = t.supplier.select("s_suppkey", F.concat(F.lit("Brand#"), text(F.col("s_suppkey") % 5 + 1), text(F.col("s_nationkey") % 6 + 1), F.lit("/"), text(F.col("s_suppkey") % 50 + 1)).alias("key"))
    status = F.when(F.col("owners").isNull(), "dangling").when(F.col("owners") > 1, "unresolvable").otherwise("resolved")
    return own.join(keys, "key", "left").select("s_suppkey", status.alias("status"), F.when(F.col("owners") == 1, F.col("owner")).alias("owner"))


@query("joi19_using", """
SELECT l_orderkey, count(*) AS lines, count(o_totalprice) AS matched FROM lineitem LEFT JOIN (SELECT o_orderkey AS l_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O') USING (l_orderkey) GROUP BY 1""")
def using(t: Tables):
    o = t.orders.where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return t.lineitem.select("l_orderkey").join(o, ["l_orderkey"], "left").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count("o_totalprice").alias("matched"))


@query("joi20_cascade_delete", """
SELECT l_returnflag, count(*) AS lines FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) GROUP BY 1""")
def cascade_delete(t: Tables):
    orders = t.orders.join(t.customer.where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    kept = t.lineitem.join(orders.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("lines"))


@query("joi21_refused_delete", """
SELECT p_partkey, n AS inbound, n > 0 AS refused FROM (SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AS n FROM part WHERE p_size = 1)""")
def refused_delete(t: Tables):
    inbound = t.lineitem.where("l_quantity > 45").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return t.part.where("p_size = 1").select("p_partkey").join(inbound, "p_partkey", "left").select("p_partkey", n.alias("inbound"), (n > 0).alias("refused"))


@query("joi22_context", """
SELECT DISTINCT o_orderkey, p_brand, s_nationkey FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey WHERE o_orderpriority = '1-URGENT'""")
def context(t: Tables):
    o = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    j = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("p_partkey") == F.col("l_partkey")).join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"))
    return j.select("o_orderkey", "p_brand", "s_nationkey").distinct()


@query("joi23_blockers", """
SELECT a.o_orderkey AS order_key, count(b.o_orderkey) AS blockers FROM orders a LEFT JOIN orders b ON b.o_custkey = a.o_custkey AND b.o_orderdate < a.o_orderdate AND b.o_orderstatus = 'O' GROUP BY 1""")
def blockers(t: Tables):
    a = t.orders.select(F.col("o_orderkey").alias("order_key"), "o_custkey", F.col("o_orderdate").alias("day"))
    b = t.orders.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("other"), F.col("o_orderdate").alias("earlier"))
    return a.join(b, (F.col("other") == F.col("o_custkey")) & (F.col("earlier") < F.col("day")), "left").groupBy("order_key").agg(F.count("earlier").alias("blockers"))


@query("joi24_attestation", """
SELECT DISTINCT a.l_orderkey FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_returnflag = 'A' AND b.l_returnflag = 'R' AND a.l_suppkey <> b.l_suppkey""")
def attestation(t: Tables):
    a = t.lineitem.where("l_returnflag = 'A'").select("l_orderkey", F.col("l_suppkey").alias("one"))
    b = t.lineitem.where("l_returnflag = 'R'").select("l_orderkey", F.col("l_suppkey").alias("two"))
    return a.join(b, "l_orderkey").where("one <> two").select("l_orderkey").distinct()


@query("agg01_counts", " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("customer", "orders", "lineitem", "part", "supplier")))
def counts(t: Tables):
    return findings.union([getattr(t, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in ("customer", "orders", "lineitem", "part", "supplier")])


@query("agg02_group_keep_empty", """
SELECT n_name, count(c_custkey) AS n, n_nationkey * 10 AS claimed FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = n_nationkey GROUP BY 1, 3""")
def group_keep_empty(t: Tables):
    per = t.customer.where("c_acctbal > 9900").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    return t.nation.join(per, "n_nationkey", "left").select("n_name", F.coalesce("n", F.lit(0).cast("long")).alias("n"), (F.col("n_nationkey") * 10).alias("claimed"))


@query("agg03_dup", """
SELECT 'line numbers repeat' AS rule, (count(*) - count(DISTINCT (l_orderkey, l_linenumber))) || ' duplicate(s)' AS subject, 'integrity' AS class, '' AS detail FROM lineitem HAVING count(*) > count(DISTINCT (l_orderkey, l_linenumber))""")
def dup(t: Tables):
    return integrity.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"], "line numbers repeat")


@query("agg04_edge_total", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + 2 * (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM nation) AS edges")
def edge_total(t: Tables):
    per = [(t.customer, 1), (t.supplier, 1), (t.orders, 1), (t.lineitem, 2), (t.nation, 1)]
    return findings.union([df.agg((F.count("*") * k).alias("n")) for df, k in per]).agg(F.sum("n").alias("edges"))


@query("agg05_coverage", """
SELECT n_name, count(*) AS total, CAST(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) AS BIGINT) AS covered, round(sum(CASE WHEN c_acctbal > 5000 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4) AS percent
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1""")
def coverage(t: Tables):
    return statistics.coverage(t.customer.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")), F.col("c_acctbal") > 5000, ["n_name"])


@query("agg06_worst_ratio", """
SELECT p_brand, count(*) AS total, CAST(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) AS BIGINT) AS covered, round(sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END) * 100.0::DOUBLE / count(*), 4) AS percent
FROM part GROUP BY 1 ORDER BY percent, p_brand LIMIT 5""")
def worst_ratio(t: Tables):
    return statistics.coverage(t.part, F.col("p_size") > 25, ["p_brand"]).orderBy("percent", "p_brand").limit(5)


@query("agg07_group_distinct", "SELECT l_suppkey, l_partkey FROM lineitem GROUP BY 1, 2")
def group_distinct(t: Tables):
    return t.lineitem.groupBy("l_suppkey", "l_partkey").agg(F.lit(1).alias("one")).drop("one")


@query("agg08_listagg", "SELECT p_type, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS brands FROM part GROUP BY 1")
def listagg(t: Tables):
    return t.part.groupBy("p_type").agg(F.array_join(F.sort_array(F.collect_set("p_brand")), ", ").alias("brands"))


@query("agg09_setfold", """
SELECT s_suppkey, coalesce(string_agg(DISTINCT CAST(l_partkey AS VARCHAR), ', ' ORDER BY CAST(l_partkey AS VARCHAR)), '') AS parts FROM supplier LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity = 50) ON l_suppkey = s_suppkey GROUP BY 1""")
def setfold(t: Tables):
    sets = t.lineitem.where("l_quantity = 50").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.array_join(F.sort_array(F.collect_set(F.col("l_partkey").cast("string"))), ", ").alias("parts"))
    return t.supplier.select("s_suppkey").join(sets, "s_suppkey", "left").select("s_suppkey", F.coalesce("parts", F.lit("")).alias("parts"))


_FIELDS = ["p_brand", "p_name", "p_size", "p_type"]


@query("agg10_pivot_eav", "SELECT p_partkey, " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _FIELDS) + " FROM part")
def pivot_eav(t: Tables):
    return fields.to_wide(fields.to_fields(t.part, ["p_partkey"], _FIELDS), ["p_partkey"], _FIELDS)


@query("agg11_eav_filter", "SELECT p_brand AS v_text, count(*) AS n FROM part GROUP BY 1")
def eav_filter(t: Tables):
    return fields.to_fields(t.part, ["p_partkey"], _FIELDS).where("field = 'p_brand'").groupBy("v_text").agg(F.count("*").alias("n"))


@query("agg12_bool_aggregates", """
SELECT o_custkey, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS merged, bool_and(o_orderstatus = 'F') AS all_merged, coalesce(round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2), 0) AS pending FROM orders GROUP BY 1""")
def bool_aggregates(t: Tables):
    f = F.col("o_orderstatus") == "F"
    return t.orders.groupBy("o_custkey").agg(F.count_if(f).alias("merged"), F.bool_and(f).alias("all_merged"), F.coalesce(F.round(F.sum(F.when(F.col("o_orderstatus") == "P", F.col("o_totalprice"))), 2), F.lit(0.0)).alias("pending"))


@query("agg13_next_id", "SELECT n_nationkey, coalesce(max(c_custkey), 0) + 1 AS next_id FROM nation LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 9900) ON c_nationkey = n_nationkey GROUP BY 1")
def next_id(t: Tables):
    return t.nation.join(t.customer.where("c_acctbal > 9900"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy("n_nationkey").agg((F.coalesce(F.max("c_custkey"), F.lit(0)) + 1).alias("next_id"))


_ALL = f"""SELECT 'part' AS rule, 'dangling' AS class FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE {SOME_PARTS})
UNION ALL SELECT 'price', 'count' FROM orders WHERE o_totalprice > 300000"""


@query("agg14_by_rule", f"SELECT rule, class, count(*) AS n FROM ({_ALL}) GROUP BY 1, 2")
def by_rule(t: Tables):
    lost = t.lineitem.select("l_partkey").join(t.part.where(SOME_PARTS), F.col("p_partkey") == F.col("l_partkey"), "left_anti")
    found = findings.union([findings.findings(lost, "part", F.col("l_partkey"), "dangling"), findings.findings(t.orders.where("o_totalprice > 300000"), "price", F.col("o_custkey"), "count")])
    return findings.by_rule(found)


@query("agg15_occurrences", "SELECT 'price' AS rule, CAST(o_custkey AS VARCHAR) AS subject, 'count' AS class, '' AS detail, count(*) AS occurrences FROM orders WHERE o_totalprice > 300000 GROUP BY 2")
def occurrences(t: Tables):
    return findings.occurrences(findings.findings(t.orders.where("o_totalprice > 300000"), "price", F.col("o_custkey"), "count"))


@query("agg17_severity_buckets", "SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1, 2")
def severity_buckets(t: Tables):
    return t.orders.where("o_orderstatus <> 'P'").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))


SHARES = [0.5, 0.9, 0.99, 0.999]


@query("agg18_percentiles", "WITH s AS (SELECT n_chars, row_number() OVER (ORDER BY n_chars) - 1 AS pos, count(*) OVER () AS n FROM documents) " + " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS share, n_chars AS value FROM s WHERE pos = least(n - 1, CAST(floor(n * {p}) AS BIGINT))" for p in SHARES))
def percentiles(t: Tables):
    return statistics.nearest_ranks(t.documents, "n_chars", SHARES)


@query("agg19_median", """
WITH s AS (SELECT o_orderstatus, o_totalprice, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) - 1 AS pos, count(*) OVER (PARTITION BY o_orderstatus) AS n FROM orders)
SELECT o_orderstatus, min(o_totalprice) AS least, max(CASE WHEN pos = n // 2 THEN o_totalprice END) AS median, round(avg(o_totalprice), 4) AS mean FROM s GROUP BY 1""")
def median(t: Tables):
    cents = t.orders.select("o_orderstatus", "o_totalprice")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY o_totalprice DESC)")
    # the element n // 2 of the ascending order is the lower median of the descending one
    return cents.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("least"), upper.alias("median"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


_KINDS = "SELECT o_orderpriority AS kind, o_orderstatus AS grp, o_orderkey AS owner, unnest(CASE WHEN o_totalprice > 20000 THEN ['price', 'date'] ELSE ['date'] END) AS field FROM orders"


@query("agg20_required_fields", f"""
WITH f AS ({_KINDS}), g AS (SELECT kind, grp, count(DISTINCT owner) AS owners FROM f GROUP BY 1, 2 HAVING count(DISTINCT owner) >= 3),
s AS (SELECT kind, grp, field, count(DISTINCT owner) AS n FROM f GROUP BY 1, 2, 3)
SELECT s.kind, field FROM s JOIN g ON s.kind = g.kind AND s.grp = g.grp WHERE n >= 0.95 * owners GROUP BY s.kind, field HAVING count(*) = (SELECT count(*) FROM g WHERE g.kind = s.kind)""")
def required_fields(t: Tables):
    f = t.orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_orderstatus").alias("grp"), F.col("o_orderkey").alias("owner"), F.explode(F.when(F.col("o_totalprice") > 20000, F.array(F.lit("price"), F.lit("date"))).otherwise(F.array(F.lit("date")))).alias("field"))
    return statistics.required_fields(f, "kind", "owner", "grp")


@query("agg21_top", "SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_partkey LIMIT 20")
def top(t: Tables):
    return statistics.top(t.lineitem, "l_partkey", 20)


@query("agg22_auc", """
WITH d AS (SELECT n_chars AS s, quality = 0 AS f FROM labels JOIN documents USING (doc_id)), c AS (SELECT s, count(*) AS n, sum(CASE WHEN f THEN 1 ELSE 0 END) AS h FROM d GROUP BY 1),
r AS (SELECT n, h, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2.0 AS rank FROM c), a AS (SELECT sum(n) AS n, sum(h) AS h, sum(h * rank) AS ranks FROM r)
SELECT CAST(h AS BIGINT) AS flagged, CAST(n - h AS BIGINT) AS others, round((ranks - h * (h + 1) / 2.0)::DOUBLE / (h * (n - h)), 6) AS auc FROM a""")
def auc(t: Tables):
    return statistics.auc(t.labels.join(t.documents.select("doc_id", "n_chars"), "doc_id").withColumn("bad", F.col("quality") == 0), "n_chars", "bad")


@query("agg23_whole_rollup", "SELECT count(*) AS pairs, CAST(sum(n) AS BIGINT) AS lines FROM (SELECT o_custkey, l_partkey, count(*) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2)")
def whole_rollup(t: Tables):
    j = t.orders.select("o_orderkey", "o_custkey").join(t.lineitem.select("l_orderkey", "l_partkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy("o_custkey", "l_partkey").agg(F.count("*").alias("n")).agg(F.count("*").alias("pairs"), F.sum("n").alias("lines"))


@query("agg24_first_rule", """
SELECT CASE WHEN regexp_matches(p_type, 'BRASS|TIN') THEN 'metal' WHEN regexp_matches(p_type, '^(STANDARD|SMALL)') THEN 'plain' WHEN regexp_matches(p_name, '[0-9]$') THEN 'numbered' ELSE 'other' END AS rule, count(*) AS n FROM part GROUP BY 1""")
def first_rule(t: Tables):
    rule = F.when(F.col("p_type").rlike("BRASS|TIN"), "metal").when(F.col("p_type").rlike("^(STANDARD|SMALL)"), "plain").when(F.col("p_name").rlike("[0-9]$"), "numbered").otherwise("other")
    return t.part.groupBy(rule.alias("rule")).agg(F.count("*").alias("n"))


@query("agg25_duplicate_groups", "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) AS BIGINT) AS members FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicate_groups(t: Tables):
    return t.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1").agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("members"))


@query("agg26_distinct", "SELECT DISTINCT l_shipdate, l_linestatus FROM lineitem")
def distinct(t: Tables):
    return t.lineitem.select("l_shipdate", "l_linestatus").distinct()


@query("flt01_defaults", "SELECT c_custkey, coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, '') AS segment, coalesce(CASE WHEN c_nationkey > 5 THEN c_nationkey END, -1) AS nation FROM customer")
def defaults(t: Tables):
    return t.customer.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.lit("")).alias("segment"), F.coalesce(F.when(F.col("c_nationkey") > 5, F.col("c_nationkey")), F.lit(-1)).alias("nation"))


@query("flt02_set_and_nonempty", "SELECT event_id FROM events WHERE nullif(substr(props, 1, CAST(event_id % 3 AS INTEGER)), '') IS NOT NULL AND substr(props, 1, CAST(event_id % 3 AS INTEGER)) <> ''")
def set_and_nonempty(t: Tables):
    own = t.events.select("event_id", F.expr("substr(props, 1, cast(event_id % 3 AS int))").alias("x"))
    return own.where("nullif(x, '') IS NOT NULL AND x <> ''").select("event_id")


@query("flt03_malformed_ids", "SELECT 'malformed p_name' AS rule, p_name AS subject, 'integrity' AS class, '' AS detail FROM part WHERE NOT regexp_matches(p_name, '^[A-Za-z]+ ?#?[0-9]*[02468]$')")
def malformed_ids(t: Tables):
    return integrity.malformed(t.part, "p_name", r"^[A-Za-z]+ ?#?[0-9]*[02468]$", "malformed p_name")


@query("flt04_in_list", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def in_list(t: Tables):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).select("o_orderkey", "o_orderpriority")


@query("flt06_prefix_number", "SELECT c_custkey FROM customer WHERE CAST(split_part(substr(c_name, 10), '.', 1) AS INTEGER) % 10 <> c_nationkey % 10")
def prefix_number(t: Tables):
    return t.customer.where("try_cast(substring_index(substring(c_name, 10), '.', 1) AS int) % 10 <> c_nationkey % 10").select("c_custkey")


@query("flt07_scope", "SELECT source LIKE 'src1%' AS excluded, count(*) AS n FROM documents GROUP BY 1")
def scope(t: Tables):
    return t.documents.groupBy(F.col("source").startswith("src1").alias("excluded")).agg(F.count("*").alias("n"))


@query("flt08_header_subset", "SELECT p_partkey FROM part WHERE list_has_all(string_split(p_type, ' '), ['BRASS']) OR list_has_all(string_split(p_type, ' '), ['STANDARD'])")
def header_subset(t: Tables):
    words = F.split("p_type", " ")
    holds = lambda *x: F.size(F.array_except(F.array(*[F.lit(w) for w in x]), words)) == 0
    return t.part.where(holds("BRASS") | holds("STANDARD")).select("p_partkey")


@query("flt10_expired", "SELECT event_id FROM events WHERE user_id % 4 = 0 OR ts + INTERVAL 1 DAY < TIMESTAMP '2024-02-01 00:00:00'")
def expired(t: Tables):
    return t.events.where("user_id % 4 = 0 OR ts + INTERVAL '1' DAY < TIMESTAMP_NTZ '2024-02-01 00:00:00'").select("event_id")


@query("flt11_null_threshold", """
SELECT doc_id, CASE WHEN quality IS NULL THEN 'no value, which fails' WHEN quality < 1 THEN 'under the threshold' ELSE 'ok' END AS reason FROM documents LEFT JOIN labels USING (doc_id)""")
def null_threshold(t: Tables):
    q = F.col("quality")
    return t.documents.select("doc_id").join(t.labels.select("doc_id", "quality"), "doc_id", "left").select("doc_id", F.when(q.isNull(), "no value, which fails").when(q < 1, "under the threshold").otherwise("ok").alias("reason"))


@query("flt12_three_valued", """
SELECT doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 'run' WHEN NOT (quality = 1 AND toxic = 0) THEN 'skipped' ELSE 'blocked' END AS outcome FROM documents LEFT JOIN labels USING (doc_id)""")
def three_valued(t: Tables):
    condition = (F.col("quality") == 1) & (F.col("toxic") == 0)
    return t.documents.select("doc_id").join(t.labels, "doc_id", "left").select("doc_id", F.when(condition, "run").when(~condition, "skipped").otherwise("blocked").alias("outcome"))


@query("flt14_first_wins", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_wins(t: Tables):
    return integrity.first_wins(t.events.select("user_id", "event_type", "event_id"), ["user_id", "event_type"], ["event_id"])


@query("flt15_collisions", """
SELECT l_orderkey, l_linenumber, CASE WHEN place = 1 THEN 'winner' ELSE 'loser' END AS fate, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) AS place FROM lineitem) GROUP BY 1, 2, 3""")
def collisions(t: Tables):
    ranked = integrity.collisions(t.lineitem, ["l_orderkey", "l_linenumber"], ["l_partkey", "l_suppkey", "l_extendedprice"])
    return ranked.groupBy("l_orderkey", "l_linenumber", F.when(F.col("place") == 1, "winner").otherwise("loser").alias("fate")).agg(F.count("*").alias("n"))


@query("flt16_id_coercion", """
SELECT c_custkey, nullif(regexp_extract(v, '[0-9]{9}'), '') AS id, CASE WHEN NOT regexp_matches(v, '[0-9]{9}') THEN 'not an id' WHEN regexp_extract(v, '[0-9]{9}') <> trim(v) THEN 'id plus prose' ELSE 'id' END AS kind
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment WHEN c_custkey % 3 = 1 THEN split_part(c_name, '#', 2) || ' ' || c_mktsegment ELSE split_part(c_name, '#', 2) END AS v FROM customer)""")
def id_coercion(t: Tables):
    number = F.substring_index("c_name", "#", -1)
    own = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.concat_ws(" ", number, "c_mktsegment")).otherwise(number).alias("v"))
    found = F.regexp_extract("v", "[0-9]{9}", 0)
    return own.select("c_custkey", F.nullif(found, F.lit("")).alias("id"), F.when(found == "", "not an id").when(found != F.trim("v"), "id plus prose").otherwise("id").alias("kind"))


@query("src05_first_declaration", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents)
SELECT word, arg_min(doc_id, (doc_id, n)) AS doc_id FROM (SELECT regexp_extract(line, '^([A-Z][a-z]{3,}) ', 1) AS word, doc_id, n FROM l) WHERE word <> '' GROUP BY 1""")
def first_declaration(t: Tables):
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    return lines.select(F.regexp_extract("line", "^([A-Z][a-z]{3,}) ", 1).alias("word"), "doc_id", "n").where("word <> ''").groupBy("word").agg(F.min_by("doc_id", F.struct("doc_id", "n")).alias("doc_id"))


@query("src06_priority_sources", """
WITH u AS (SELECT c_nationkey AS k, 3 AS p, min(c_name) AS name FROM customer WHERE c_acctbal > 9000 GROUP BY 1 UNION ALL SELECT n_nationkey, 1, n_name FROM nation WHERE n_nationkey < 10 UNION ALL SELECT s_nationkey, 2, min(s_name) FROM supplier GROUP BY 1)
SELECT k, arg_min(name, p) AS name, min(p) AS p FROM u GROUP BY 1""")
def priority_sources(t: Tables):
    a = t.nation.where("n_nationkey < 10").select(F.col("n_nationkey").alias("k"), F.lit(1).alias("p"), F.col("n_name").alias("name"))
    b = t.supplier.groupBy(F.col("s_nationkey").alias("k")).agg(F.min("s_name").alias("name")).select("k", F.lit(2).alias("p"), "name")
    c = t.customer.where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.min("c_name").alias("name")).select("k", F.lit(3).alias("p"), "name")
    return integrity.first_wins(findings.union([a, b, c]), ["k"], ["p"])


@query("src07_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def scan(t: Tables):
    return t.orders.select("o_orderkey", "o_orderstatus")


@query("src08_key_lookup", "SELECT * FROM orders WHERE o_orderkey = 77")
def key_lookup(t: Tables):
    return t.orders.where("o_orderkey = 77")


@query("src09_prefix_scan", "SELECT p_partkey, p_brand FROM part WHERE p_brand LIKE 'Brand#1%' ORDER BY p_partkey LIMIT 50")
def prefix_scan(t: Tables):
    return t.part.where(F.col("p_brand").startswith("Brand#1")).select("p_partkey", "p_brand").orderBy("p_partkey").limit(50)


@query("src20_substring_scan", "SELECT doc_id FROM documents WHERE text LIKE '%License%'")
def substring_scan(t: Tables):
    return t.documents.where(F.col("text").contains("License")).select("doc_id")


_WORDS = ["license", "public"]
_F = ", ".join(f"len(list_filter(ws, lambda w: w = '{w}')) AS f{k}" for k, w in enumerate(_WORDS))


@query("src21_ranked_search", f"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents), f AS (SELECT doc_id, len(ws) AS n, {_F} FROM w),
a AS (SELECT count(*) AS docs, avg(n) AS mean, {", ".join(f"count(*) FILTER (f{k} > 0) AS d{k}" for k in range(2))} FROM f)
SELECT doc_id, round({" + ".join(f"ln(1 + (docs - d{k} + 0.5::DOUBLE) / (d{k} + 0.5::DOUBLE)) * f{k} * 2.2::DOUBLE / (f{k} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * n / mean))" for k in range(2))}, 6) AS score FROM f, a WHERE f0 > 0 OR f1 > 0""")
def ranked_search(t: Tables):
    return statistics.ranked_search(t.documents, "doc_id", "text", _WORDS)


@query("srt02_score_order", "SELECT l_suppkey, count(*) AS score FROM lineitem GROUP BY 1 ORDER BY score DESC, l_suppkey LIMIT 10")
def score_order(t: Tables):
    return statistics.top(t.lineitem, "l_suppkey", 10).withColumnRenamed("n", "score")


@query("srt04_hub", "SELECT l_suppkey, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, l_suppkey LIMIT 1")
def hub(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("n")).orderBy(F.desc("n"), "l_suppkey").limit(1)


@query("srt05_stride", "SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r % 25 = 0")
def stride(t: Tables):
    from pyspark.sql import Window

    ranked = t.documents.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")))
    return ranked.where("r % 25 = 0").select("source", "doc_id")


@query("set01_union_all", "SELECT count(*) AS n, 'c' AS t FROM customer UNION ALL SELECT count(*), 's' FROM supplier")
def union_all(t: Tables):
    return t.customer.agg(F.count("*").alias("n")).withColumn("t", F.lit("c")).unionByName(t.supplier.agg(F.count("*").alias("n")).withColumn("t", F.lit("s")))


@query("set03_set_equality", """
WITH a AS (SELECT l_orderkey, list_sort(list(l_linenumber)) AS x FROM lineitem GROUP BY 1), b AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber)) AS y FROM lineitem GROUP BY 1)
SELECT l_orderkey, x = y AS same FROM a JOIN b USING (l_orderkey)""")
def set_equality(t: Tables):
    return t.lineitem.groupBy("l_orderkey").agg((F.sort_array(F.collect_list("l_linenumber")) == F.sort_array(F.collect_set("l_linenumber"))).alias("same"))


@query("set04_collapse", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def collapse(t: Tables):
    return t.lineitem.select("l_partkey", "l_suppkey").dropDuplicates(["l_partkey", "l_suppkey"])


_STATE = "SELECT 'ref-' || s_suppkey AS ref, CAST(s_suppkey % 5 AS INTEGER) AS attempts, CAST(20 - s_suppkey % 7 AS INTEGER) AS last_run, CASE WHEN s_suppkey % 11 = 0 THEN 'merge conflict' ELSE 'network timeout' END AS last_error FROM supplier WHERE s_suppkey % 2 = 0"


@query("qua01_failure_kind", "SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'none' WHEN s_suppkey % 3 = 1 THEN 'permanent' ELSE 'transient' END AS kind FROM supplier")
def failure_kind(t: Tables):
    error = F.when(F.col("s_suppkey") % 3 == 0, "").when(F.col("s_suppkey") % 3 == 1, "Constraint failed").otherwise("timeout")
    return t.supplier.select("s_suppkey", quarantine.failure_kind(error).alias("kind"))


@query("qua02_backoff", "SELECT s_suppkey, CASE WHEN s_suppkey % 12 = 0 THEN 0 ELSE CAST(least(64, pow(2, s_suppkey % 12 - 1)) AS INTEGER) END AS wait FROM supplier")
def backoff(t: Tables):
    return t.supplier.select("s_suppkey", quarantine.backoff(F.col("s_suppkey") % 12).alias("wait"))


@query("qua03_plan", f"""
WITH s AS ({_STATE}), p AS (SELECT 'ref-' || s_suppkey AS ref FROM supplier WHERE s_suppkey % 3 <> 1), w AS (SELECT p.ref, coalesce(attempts, 0) AS a, last_error = 'merge conflict' AS bad, last_run, CAST(least(64, pow(2, attempts - 1)) AS INTEGER) AS wait FROM p LEFT JOIN s ON s.ref = p.ref)
SELECT ref, CASE WHEN a = 0 THEN 'merge' WHEN bad THEN 'quarantine' WHEN a >= 3 THEN 'quarantine' WHEN 21 - last_run < wait THEN 'skip' ELSE 'merge' END AS action,
  CASE WHEN a = 0 THEN 'no failure so far' WHEN bad THEN 'permanent failure' WHEN a >= 3 THEN a || ' attempts' WHEN 21 - last_run < wait THEN 'waits until run ' || (last_run + wait) ELSE 'retry' END AS reason FROM w""")
def plan(t: Tables):
    k = F.col("s_suppkey")
    ref = F.concat(F.lit("ref-"), k.cast("string")).alias("ref")
    state = t.supplier.where("s_suppkey % 2 = 0").select(ref, (k % 5).cast("int").alias("attempts"), (20 - k % 7).cast("int").alias("last_run"), F.when(k % 11 == 0, "merge conflict").otherwise("network timeout").alias("last_error"))
    return quarantine.plan(t.supplier.where("s_suppkey % 3 <> 1").select(ref), state, 21)


@query("snk02_fk_split", f"""
WITH r AS (SELECT DISTINCT l_orderkey, l_partkey, EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND {SOME_PARTS}) AND EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus = 'F') AS ok FROM lineitem)
SELECT ok AS accepted, count(*) AS n FROM r GROUP BY 1""")
def fk_split(t: Tables):
    rows = t.lineitem.select("l_orderkey", "l_partkey")
    accepted, refused = integrity.foreign_key_split(rows, ["l_orderkey", "l_partkey"], [("l_partkey", t.part.where(SOME_PARTS), "p_partkey"), ("l_orderkey", t.orders.where("o_orderstatus = 'F'"), "o_orderkey")], "edge to a missing record")
    return accepted.agg(F.count("*").alias("n")).withColumn("accepted", F.lit(True)).unionByName(refused.select("subject").distinct().agg(F.count("*").alias("n")).withColumn("accepted", F.lit(False)))


@query("snk03_upsert", "SELECT user_id, count(*) AS occurrences, max(ts) AS last_seen FROM events GROUP BY 1")
def upsert(t: Tables):
    return t.events.groupBy("user_id").agg(F.count("*").alias("occurrences"), F.max("ts").alias("last_seen"))


@query("snk10_rebase", """
SELECT 'price' AS rule, CAST(o_custkey AS VARCHAR) AS subject, 'count' AS class, '' AS detail, CASE WHEN o_custkey % 2 = 0 AND max(o_totalprice) > 350000 THEN 'agreed' END AS waiver FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey""")
def rebase(t: Tables):
    now = findings.findings(t.orders.where("o_totalprice > 300000"), "price", F.col("o_custkey"), "count")
    before = findings.findings(t.orders.where("o_totalprice > 350000"), "price", F.col("o_custkey"), "count").withColumn("waiver", F.when(F.col("subject").cast("long") % 2 == 0, "agreed"))
    return findings.rebase(now, before)


@query("snk11_render", """
SELECT 'nation/' || n_nationkey || '.md' AS path, '# ' || n_name || chr(10) || chr(10) || string_agg('- ' || s_name, chr(10) ORDER BY s_name) AS body FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name""")
def render(t: Tables):
    j = F.broadcast(t.nation).join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_nationkey", "n_name").agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("- "), F.col("s_name")))), "\n").alias("rows")).select(F.concat(F.lit("nation/"), F.col("n_nationkey").cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col("n_name"), F.lit("\n\n"), F.col("rows")).alias("body"))
