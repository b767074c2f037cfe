"""The gates of a validated store, each over typed tables made of the driver's tables, with its SQL.

Parts are contracts, suppliers properties, customers stories and nations subsystems; line items and orders are the edges, claims and reviews between them. No table is cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import findings
from ..plans import validate
from .base import Tables, query

_P = "'BC-' || (p_size % 30) || '.01.' || p_partkey"
_WITH = f"""WITH ss AS (SELECT 'SS-' || n_nationkey AS id, n_nationkey AS bc_prefix FROM nation),
bc AS (SELECT {_P} AS id, 'SS-' || (p_size % 25) AS ss_id, 'CAP-' || p_size AS capability, CASE WHEN p_retailprice > 980 THEN 'BC-1.01.' || p_size END AS replacement, p_partkey AS k, p_retailprice AS price FROM part WHERE p_brand <> 'Brand#11'),
vp AS (SELECT CASE WHEN s_nationkey = 3 THEN 'vp-' ELSE 'VP-' END || s_suppkey AS id, 'SS-' || (s_nationkey + 2) AS scope, 'BC-' || (s_suppkey % 30) || '.01.' || s_suppkey AS source_bc, s_suppkey AS k FROM supplier),
st AS (SELECT 'S-' || c_nationkey || '.' || (c_custkey // 2) AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'E-' || c_nationkey END AS epic_id, c_custkey AS k FROM customer WHERE c_acctbal > 0),
l AS (SELECT l_suppkey, l_orderkey, {_P} AS bc, l_quantity, l_returnflag FROM lineitem JOIN part ON p_partkey = l_partkey)"""


def store(t: Tables) -> dict[str, DataFrame]:
    """The typed tables."""
    text = lambda c: F.col(c).cast("string")
    bc_id = F.concat(F.lit("BC-"), (F.col("p_size") % 30).cast("string"), F.lit(".01."), text("p_partkey"))
    line = t.lineitem.join(t.part.select("p_partkey", bc_id.alias("bc")), F.col("p_partkey") == F.col("l_partkey"))
    story = F.concat(F.lit("S-"), text("c_nationkey"), F.lit("."), text("c_custkey"))
    ordered = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    named = t.part.where("p_brand <> 'Brand#11'")
    return {
        "subsystem": t.nation.select(F.concat(F.lit("SS-"), text("n_nationkey")).alias("id"), F.col("n_nationkey").cast("int").alias("bc_prefix")),
        "bc": named.select(bc_id.alias("id"), F.concat(F.lit("SS-"), (F.col("p_size") % 25).cast("string")).alias("ss_id"), F.concat(F.lit("CAP-"), text("p_size")).alias("capability"), F.when(F.col("p_retailprice") > 980, F.concat(F.lit("BC-1.01."), text("p_size"))).alias("replacement")),
        "vp": t.supplier.select(F.concat(F.when(F.col("s_nationkey") == 3, "vp-").otherwise("VP-"), text("s_suppkey")).alias("id"), F.concat(F.lit("SS-"), (F.col("s_nationkey") + 2).cast("string")).alias("scope"), F.concat(F.lit("BC-"), (F.col("s_suppkey") % 30).cast("string"), F.lit(".01."), text("s_suppkey")).alias("source_bc")),
        "story": t.customer.where("c_acctbal > 0").select(F.concat(F.lit("S-"), text("c_nationkey"), F.lit("."), F.expr("c_custkey div 2").cast("string")).alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.concat(F.lit("E-"), text("c_nationkey"))).alias("epic_id")),
        "cap": t.part.select(F.concat(F.lit("CAP-"), text("p_size")).alias("id")).where("id <> 'CAP-7'").distinct(),
        "epic": t.nation.where("n_regionkey <> 2").select(F.concat(F.lit("E-"), text("n_nationkey")).alias("id")),
        "index_entry": t.part.where("p_retailprice < 990").select(bc_id.alias("id")),
        "vp_bc": line.select(F.concat(F.lit("VP-"), text("l_suppkey")).alias("id"), F.col("bc").alias("target")).distinct(),
        "story_dep": ordered.select(story.alias("id"), F.concat(F.lit("S-"), text("c_nationkey"), F.lit("."), (F.col("c_custkey") + 1).cast("string")).alias("target"), F.when(F.col("o_orderstatus") == "F", "blocks").otherwise("depends_on").alias("kind")).distinct(),
        "claim": named.groupBy((F.col("p_size") % 25).alias("g")).agg(F.count_if(F.col("p_retailprice") < 950).alias("claimed")).select(F.lit("index").alias("source"), F.lit("bc_count_ss").alias("kind"), F.concat(F.lit("SS-"), text("g")).alias("subject"), "claimed"),
        "review_finding": t.lineitem.select(F.concat(F.lit("review-"), text("l_orderkey")).alias("review"), F.when(F.col("l_tax") > 0.01, "HIGH").otherwise("").alias("severity"), (F.col("l_returnflag") != "N").alias("owned")),
        "review_claim": t.orders.select(F.lit("frontmatter").alias("source"), F.lit("review_finding_count").alias("kind"), F.concat(F.lit("review-"), text("o_orderkey")).alias("subject"), F.month("o_orderdate").cast("long").alias("claimed")),
        "sub_artifact_ref": line.select(F.concat(F.lit("VP-"), text("l_suppkey")).alias("id"), F.lit("ac").alias("kind"), F.concat(F.lit("AC-"), F.col("l_quantity").cast("int").cast("string")).alias("sub_id"), F.lit("bc").alias("target_kind"), F.col("bc").alias("target_id")),
        "version_cite": t.orders.select(F.concat(F.lit("cycles/"), text("o_orderkey"), F.lit(".md")).alias("path"), F.col("o_orderpriority").alias("target"), F.lit("1.0").alias("cited"), F.when(F.col("o_orderstatus") == "P", "ahead-never-existed").when(F.col("o_orderpriority") == "1-URGENT", "lagging-floating").otherwise("current").alias("verdict")),
        "prose_ref": t.orders.select(F.when(F.col("o_orderstatus") == "P", "unresolvable").when(F.col("o_orderpriority") == "5-LOW", "dangling").otherwise("resolved").alias("status")),
    }


def _gate(name: str, sql: str):
    return query(name, f"{_WITH} {sql}")


@_gate("gate_stated_counts", "SELECT 'a stated count differs from the records' AS rule, 'index bc_count_ss ' || ss_id AS subject, 'count' AS class, 'states ' || count(*) FILTER (WHERE price < 950) || ', actual ' || count(*) AS detail FROM bc GROUP BY ss_id HAVING count(*) FILTER (WHERE price < 950) <> count(*)")
def stated_counts(t: Tables):
    return validate.stated_counts(store(t))


@_gate("gate_index_enumeration", f"SELECT CASE WHEN bc.id IS NULL THEN 'index names a missing record' ELSE 'record absent from index' END AS rule, coalesce(bc.id, i.id) AS subject, 'dangling' AS class, '' AS detail FROM bc FULL JOIN (SELECT {_P} AS id FROM part WHERE p_retailprice < 990) i ON i.id = bc.id WHERE bc.id IS NULL OR i.id IS NULL")
def index_enumeration(t: Tables):
    return validate.index_enumeration(store(t))


@_gate("gate_dangling_edges", "SELECT DISTINCT 'dangling vp_bc.target' AS rule, l.bc AS subject, 'dangling' AS class, '' AS detail FROM l WHERE NOT EXISTS (SELECT 1 FROM bc WHERE bc.id = l.bc) UNION ALL SELECT DISTINCT 'dangling vp_bc.id', 'VP-' || l_suppkey, 'dangling', '' FROM l WHERE NOT EXISTS (SELECT 1 FROM vp WHERE id = 'VP-' || l_suppkey)")
def dangling_edges(t: Tables):
    return validate.dangling_edges(store(t), {"vp_bc": validate.PARENTS["vp_bc"]})


@_gate("gate_malformed_ids", "SELECT 'malformed vp id' AS rule, id AS subject, 'integrity' AS class, '' AS detail FROM vp WHERE id LIKE 'vp-%'")
def malformed_ids(t: Tables):
    return validate.malformed_ids(store(t))


@_gate("gate_duplicate_ids", "SELECT 'duplicate ' || kind || ' ids' AS rule, sum(n - 1) || ' duplicate(s)' AS subject, 'integrity' AS class, '' AS detail FROM (SELECT 'bc' AS kind, id, count(*) AS n FROM bc GROUP BY id UNION ALL SELECT 'vp', id, count(*) FROM vp GROUP BY id UNION ALL SELECT 'story', id, count(*) FROM st GROUP BY id) GROUP BY kind HAVING sum(n - 1) > 0")
def duplicate_ids(t: Tables):
    return validate.duplicate_ids(store(t))


@_gate("gate_prefix_agreement", "SELECT 'a contract''s prefix is not its subsystem''s' AS rule, bc.id || ' -> ' || ss_id AS subject, 'integrity' AS class, 'registered as BC-' || bc_prefix AS detail FROM bc JOIN ss ON ss.id = ss_id WHERE CAST(split_part(substr(bc.id, 4), '.', 1) AS INTEGER) <> bc_prefix")
def prefix_agreement(t: Tables):
    return validate.prefix_agreement(store(t))


@_gate("gate_scalar_refs", """, r AS (SELECT 'bc.capability -> missing cap' AS rule, id, capability AS ref FROM bc WHERE capability NOT IN (SELECT 'CAP-' || p_size FROM part WHERE p_size <> 7)
UNION ALL SELECT 'bc.replacement -> missing bc', id, replacement FROM bc WHERE replacement IS NOT NULL AND replacement NOT IN (SELECT id FROM bc)
UNION ALL SELECT 'story.epic_id -> missing epic', id, epic_id FROM st WHERE epic_id IS NOT NULL AND epic_id NOT IN (SELECT 'E-' || n_nationkey FROM nation WHERE n_regionkey <> 2)
UNION ALL SELECT 'vp.scope -> missing subsystem', id, scope FROM vp WHERE scope NOT IN (SELECT id FROM ss) UNION ALL SELECT 'vp.source_bc -> missing bc', id, source_bc FROM vp WHERE source_bc NOT IN (SELECT id FROM bc))
SELECT rule, id || ' -> ' || ref AS subject, 'dangling' AS class, '' AS detail FROM r""")
def scalar_refs(t: Tables):
    return validate.scalar_refs(store(t))


@_gate("gate_dependency_direction", """, d AS (SELECT DISTINCT 'S-' || c_nationkey || '.' || c_custkey AS a, 'S-' || c_nationkey || '.' || (c_custkey + 1) AS b, CASE WHEN o_orderstatus = 'F' THEN 'blocks' ELSE 'depends_on' END AS k FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT 'dependency recorded on one side only' AS rule, concat_ws(' ', a, k, b) AS subject, 'direction' AS class, 'the reverse row is missing' AS detail FROM d WHERE NOT EXISTS (SELECT 1 FROM d r WHERE r.a = d.b AND r.b = d.a AND r.k <> d.k)""")
def dependency_direction(t: Tables):
    return validate.dependency_direction(store(t))


@_gate("gate_review_counts", """, f AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag <> 'N') AS n FROM lineitem GROUP BY 1)
SELECT 'a review''s stated count differs from its findings' AS rule, 'frontmatter review_finding_count review-' || o_orderkey AS subject, 'count' AS class, 'states ' || month(o_orderdate) || ', actual ' || coalesce(n, 0) AS detail FROM orders LEFT JOIN f ON l_orderkey = o_orderkey WHERE month(o_orderdate) <> coalesce(n, 0)
UNION ALL SELECT 'findings of no known severity', count(*) || ' row(s)', 'type', '' FROM lineitem WHERE l_tax <= 0.01 HAVING count(*) > 0""")
def review_counts(t: Tables):
    tables = store(t)
    return validate.review_counts(tables | {"claim": tables["review_claim"]})


@_gate("gate_sub_artifact_refs", "SELECT DISTINCT 'a trace of a ac names a missing bc' AS rule, 'VP-' || l_suppkey || ' AC-' || CAST(l_quantity AS INTEGER) || ' -> ' || l.bc AS subject, 'dangling' AS class, '' AS detail FROM l WHERE l.bc NOT IN (SELECT id FROM bc)")
def sub_artifact_refs(t: Tables):
    return validate.sub_artifact_refs(store(t), ("bc",))


@_gate("gate_undeclared_traces", ", d AS (SELECT DISTINCT 'VP-' || l_suppkey AS id, bc FROM l WHERE l_returnflag = 'R') SELECT DISTINCT 'a criterion traces to a contract that its story doesn''t declare' AS rule, 'VP-' || l_suppkey || ' AC-' || CAST(l_quantity AS INTEGER) || ' -> ' || l.bc AS subject, 'dangling' AS class, '' AS detail FROM l WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.id = 'VP-' || l_suppkey AND d.bc = l.bc) AND 'VP-' || l_suppkey IN (SELECT id FROM vp)")
def undeclared_traces(t: Tables):
    tables = store(t)
    declared = t.lineitem.where("l_returnflag = 'R'").join(t.part, F.col("p_partkey") == F.col("l_partkey")).select(F.concat(F.lit("VP-"), F.col("l_suppkey").cast("string")).alias("id"), F.concat(F.lit("BC-"), (F.col("p_size") % 30).cast("string"), F.lit(".01."), F.col("p_partkey").cast("string")).alias("target")).distinct()
    return validate.undeclared_traces(tables | {"story": tables["vp"], "story_bc": declared})


@_gate("gate_version_cites", "SELECT CASE WHEN o_orderstatus = 'P' THEN 'a cite names a version that never was' ELSE 'a floating cite lags behind' END AS rule, 'cycles/' || o_orderkey || '.md -> ' || o_orderpriority || ' v1.0' AS subject, CASE WHEN o_orderstatus = 'P' THEN 'integrity' ELSE 'count' END AS class, '' AS detail FROM orders WHERE o_orderstatus = 'P' OR o_orderpriority = '1-URGENT'")
def version_cites(t: Tables):
    return validate.version_cites(store(t))


@_gate("gate_prose_refs", ", s AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'u' WHEN o_orderpriority = '5-LOW' THEN 'd' ELSE 'r' END AS s FROM orders), n AS (SELECT count(*) AS n, count(*) FILTER (WHERE s = 'u') AS u, count(*) FILTER (WHERE s = 'd') AS d FROM s) SELECT 'section references without a stated owner' AS rule, u || ' of ' || n AS subject, 'type' AS class, '' AS detail FROM n WHERE u > 0 UNION ALL SELECT 'section references to a section that the owner lacks', d || ' of ' || n, 'dangling', '' FROM n WHERE d > 0")
def prose_refs(t: Tables):
    return validate.prose_refs(store(t))


@_gate("gate_cross_zone", "SELECT 'a walled scenario names a missing contract' AS rule, vp.id || ' -> ' || source_bc AS subject, 'cross-zone' AS class, '' AS detail FROM vp WHERE source_bc NOT IN (SELECT id FROM bc)")
def cross_zone(t: Tables):
    """Of the walled table only ids and targets are read."""
    tables = store(t)
    return validate.cross_zone(tables, tables["vp"].withColumnRenamed("source_bc", "target"))[0]


@_gate("gate_cross_zone_skipped", "SELECT 'the cross-zone gate was skipped' AS rule, 'the walled zone is not there' AS subject, 'skip' AS class, '' AS detail")
def cross_zone_skipped(t: Tables):
    return validate.skipped(store(t), None)


@_gate("gate_found_at_ingest", "SELECT 'large order' AS rule, CAST(o_custkey AS VARCHAR) AS subject, 'count' AS class, CASE WHEN count(*) > 1 THEN ' (x' || count(*) || ')' ELSE '' END AS detail FROM orders WHERE o_totalprice > 200000 GROUP BY o_custkey")
def found_at_ingest(t: Tables):
    return validate.found_at_ingest({"finding": findings.occurrences(findings.findings(t.orders.where("o_totalprice > 200000"), "large order", F.col("o_custkey"), "count"))})


@_gate("gate_metrics", "SELECT 'bc' AS name, count(*) AS n FROM bc UNION ALL SELECT 'vp', count(*) FROM vp UNION ALL SELECT 'story', count(*) FROM st UNION ALL SELECT 'subsystem', count(*) FROM ss UNION ALL SELECT 'edges', count(DISTINCT (l_suppkey, bc)) FROM l UNION ALL SELECT 'bc_without_vp', count(*) FROM bc WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.bc = bc.id)")
def metrics(t: Tables):
    return validate.metrics(store(t), ("bc", "vp", "story", "subsystem"), ("vp_bc",), ("vp",))
