"""Filters, reports, sinks, writes and text functions that the other modules don't bind."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..functions import reviews
from ..functions.columns import arrow, structs
from ..graph import kernels, project, traverse
from ..operators import findings, quarantine, writes
from ..plans.ingest import text_funnel
from . import graphs
from .base import ORACLE, Tables, query, spread


@query("src15_system_tables", "SELECT 'main' AS branch, CAST(2 AS BIGINT) AS head, CAST(2 AS BIGINT) AS commits UNION ALL SELECT 'wave', 3, 1")
def system_tables(t: Tables):
    """The branch table of a store that nations were published to."""
    import uuid

    from ..session import settle
    from ..sources import snapshots

    settle(t.nation.limit(0))  # so that a checkpoint folder is set
    store = snapshots.Store(t.spark, f"{t.spark.sparkContext.getCheckpointDir()}/store-{uuid.uuid4().hex}")
    store.publish({"nation": t.nation.where("n_regionkey <> 1")}, "first")
    store.publish({"nation": t.nation}, "second")
    store.publish({"nation": t.nation}, "wave", "wave")
    return store.branches()


@query("src17_baseline_document", "SELECT 'large order' AS rule, CAST(o_custkey AS VARCHAR) AS subject, 'count' AS class, CASE WHEN max(o_totalprice) > 350000 THEN 'agreed' END AS waiver FROM orders WHERE o_totalprice > 300000 GROUP BY o_custkey")
def baseline_document(t: Tables):
    """A baseline that was written as JSON lines, read back."""
    import uuid

    from ..session import settle
    from ..sources import files

    settle(t.nation.limit(0))
    path = f"{t.spark.sparkContext.getCheckpointDir()}/baseline-{uuid.uuid4().hex}"
    found = findings.findings(t.orders.where("o_totalprice > 300000"), "large order", F.col("o_custkey"), "count").withColumn("detail", F.lit("x"))
    waived = findings.findings(t.orders.where("o_totalprice > 350000"), "large order", F.col("o_custkey"), "count").withColumn("waiver", F.lit("agreed"))
    files.write_json(findings.rebase(found, waived), path)
    return files.baseline(t.spark, path).select("rule", "subject", "class", "waiver")


@query("snk04_fingerprint", "SELECT true AS same_in_any_order, false AS same_after_a_change")
def fingerprint(t: Tables):
    """The fingerprint of orders doesn't see their order or partitioning, and sees one changed value."""
    from ..sources.snapshots import fingerprint as of

    own = t.orders.select("o_orderkey", "o_totalprice")
    first = of({"orders": own})
    other = of({"orders": own.repartition(7, "o_totalprice").select("o_totalprice", "o_orderkey")})
    changed = of({"orders": own.withColumn("o_totalprice", F.when(F.col("o_orderkey") == 1, 0.0).otherwise(F.col("o_totalprice")))})
    return t.spark.createDataFrame([(first == other, first == changed)], "same_in_any_order boolean, same_after_a_change boolean")


@query("snk06_json_report", "SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def json_report(t: Tables):
    import uuid

    from ..session import settle
    from ..sources import files

    settle(t.nation.limit(0))
    path = f"{t.spark.sparkContext.getCheckpointDir()}/report-{uuid.uuid4().hex}"
    files.write_json(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), path)
    return files.records(t.spark, path, "status string, n long")


_EVENT_RANKS = ORACLE["gra13_pagerank"].replace(graphs._SUPPLY, graphs._EVENTS)


@query("snk08_centralities", f"""WITH e AS ({graphs._EVENTS}), d AS (SELECT node, count(*) AS degree FROM (SELECT src AS node FROM e UNION ALL SELECT dst FROM e) GROUP BY 1)
SELECT node, split_part(node, ':', 2) AS type, betweenness, rank AS pagerank, degree FROM d JOIN ({ORACLE['gra12_betweenness']}) USING (node) JOIN ({_EVENT_RANKS}) USING (node)""")
def centralities(t: Tables):
    """What the centralities sink writes."""
    e = graphs.transitions(t)
    between = kernels.betweenness_scores(e).select("node", F.round("betweenness", 6).alias("betweenness"))
    ranks = traverse.pagerank(e, tolerance=0.0, most=graphs._RANKS).select("node", F.round("rank", 9).alias("pagerank"))
    return project.centralities(e, between, ranks).select("node", F.split_part("node", F.lit(":"), F.lit(2)).alias("type"), "betweenness", "pagerank", "degree")


_NOW = "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subject FROM orders WHERE o_orderdate >= '1994-01-01' AND o_orderdate < '1997-01-01' AND o_totalprice > 300000"
_THEN = "SELECT CAST(o_custkey AS VARCHAR) AS subject, max(o_totalprice) > 350000 AS waived FROM orders WHERE o_orderdate >= '1992-01-01' AND o_orderdate < '1996-01-01' AND o_totalprice > 300000 GROUP BY 1"
_COMPARED = f"WITH a AS ({_NOW}), b AS ({_THEN}), c AS (SELECT coalesce(a.subject, b.subject) AS subject, CASE WHEN b.subject IS NULL THEN 'new' WHEN a.subject IS NULL THEN 'fixed' ELSE 'kept' END AS status FROM a FULL JOIN b ON a.subject = b.subject)"


def _both(t: Tables):
    large = lambda after, before: t.orders.where(f"o_orderdate >= '{after}' AND o_orderdate < '{before}' AND o_totalprice > 300000")
    now = findings.findings(large("1994-01-01", "1997-01-01"), "large order", F.col("o_custkey"), "count")
    old = large("1992-01-01", "1996-01-01")
    waived = findings.findings(old.where("o_totalprice > 350000"), "large order", F.col("o_custkey"), "count").withColumn("waiver", F.lit("agreed"))
    return now, findings.rebase(findings.findings(old, "large order", F.col("o_custkey"), "count"), waived)


@query("bas02_compare", f"{_COMPARED} SELECT status, count(*) AS n FROM c GROUP BY 1")
def compared(t: Tables):
    return findings.compare(*_both(t)).groupBy("status").agg(F.count("*").alias("n"))


@query("bas03_verdict", f"{_COMPARED} SELECT mode, CASE mode WHEN 'broken' THEN 2 WHEN 'strict' THEN CAST(bool_or(status <> 'fixed') AS INTEGER) ELSE CAST(bool_or(status = 'new') AS INTEGER) END AS code FROM c, (SELECT unnest(['ratchet', 'strict', 'broken']) AS mode) GROUP BY mode")
def verdicts(t: Tables):
    now, before = _both(t)
    codes = {"ratchet": findings.judged(lambda: findings.compare(now, before)), "strict": findings.judged(lambda: findings.compare(now, before), strict=True), "broken": findings.judged(lambda: t.spark.table("a table that isn't there"))}
    return t.spark.createDataFrame([(k, v[0]) for k, v in codes.items()], "mode string, code int")


@query("snk13_report", f"""{_COMPARED}, n AS (SELECT count(*) FILTER (WHERE status = 'new') AS a, count(*) FILTER (WHERE status = 'kept') AS k, count(*) FILTER (WHERE status = 'fixed') AS f, (SELECT count(*) FROM b WHERE waived) AS w FROM c), x AS (SELECT 'count / large order / ' || subject AS s, status FROM c)
SELECT '0' AS ord, 'new ' || a || ', kept ' || k || ', fixed ' || f || ', waived ' || w AS line FROM n UNION ALL (SELECT '1 ' || s, 'fixed ' || s FROM x WHERE status = 'fixed' ORDER BY s LIMIT 20) UNION ALL SELECT '2', 'and ' || (f - 20) || ' more' FROM n WHERE f > 20
UNION ALL SELECT '3 ' || s, 'new ' || s FROM x WHERE status = 'new' UNION ALL SELECT '4', CASE WHEN a > 0 THEN 'FAIL: ' || a || ' finding(s)' WHEN k > 0 THEN 'PASS: ' || k || ' finding(s) of the baseline are left' ELSE 'PASS: no findings' END FROM n""")
def human_report(t: Tables):
    return findings.report(*_both(t))


@query("flt05_parameter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
def parameter(t: Tables):
    t.orders.createOrReplaceTempView("orders_by_parameter")
    return t.spark.sql("SELECT o_orderkey, o_totalprice FROM orders_by_parameter WHERE o_custkey = :customer", args={"customer": 7})


@query("flt09_active", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'O' GROUP BY 1")
def active(t: Tables):
    return t.orders.where("o_orderstatus = 'O'").groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("flt13_labels", "SELECT CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middling' ELSE 'small' END AS label, count(*) AS n FROM orders GROUP BY 1")
def labels(t: Tables):
    return t.orders.groupBy(F.when(F.col("o_totalprice") > 300000, "large").when(F.col("o_totalprice") > 100000, "middling").otherwise("small").alias("label")).agg(F.count("*").alias("n"))


@query("flt17_pruned", "SELECT DISTINCT s_nationkey AS target FROM supplier WHERE s_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9950)")
def pruned(t: Tables):
    """Of the walled table one column is read."""
    return t.supplier.select(F.col("s_nationkey").alias("target")).distinct().join(t.customer.where("c_acctbal > 9950").select(F.col("c_nationkey").alias("target")).distinct(), "target", "left_anti")


@query("flt18_routing", "SELECT name, regexp_extract(name, '^([A-Za-z]+)', 1) AS type, CASE split_part(name, '#', 1) WHEN 'Customer' THEN 'walled' WHEN 'Supplier' THEN 'open' END AS zone, CASE split_part(name, '#', 1) WHEN 'Customer' THEN 'auditor' WHEN 'Supplier' THEN 'auditor,builder' ELSE '' END AS roles FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier UNION ALL SELECT r_name FROM region)")
def routing(t: Tables):
    names = t.customer.select(F.col("c_name").alias("name")).union(t.supplier.select("s_name")).union(t.region.select("r_name"))
    return writes.routed(names, "name", {"Customer": ("walled", ("auditor",)), "Supplier": ("open", ("auditor", "builder"))}).select("name", "type", "zone", F.array_join("roles", ",").alias("roles"))


@query("agg16_agreement", "SELECT l_returnflag AS spec, count(*) AS cells, round(100.0 * count(*) FILTER (WHERE l_shipdate < DATE '1995-06-17' AND l_linestatus = 'F' OR l_shipdate >= DATE '1995-06-17' AND l_linestatus = 'O') / count(*), 1) AS agreement FROM lineitem GROUP BY 1")
def agreement(t: Tables):
    """Share of cells in which what is written is what the dates say."""
    from ..plans.shadow import agreement as of

    derived = F.when(F.col("l_shipdate") < F.lit("1995-06-17").cast("date"), "F").otherwise("O")
    cells = t.lineitem.select(F.col("l_returnflag").alias("spec"), F.when(F.col("l_linestatus") == derived, "agree").otherwise("disagree").alias("outcome"))
    return of(cells.groupBy("spec", "outcome").agg(F.count("*").alias("n")), "spec")


_LARGE = "SELECT 'large order' AS rule, CAST(o_custkey AS VARCHAR) AS subject, 'count' AS class, '' AS detail FROM orders WHERE o_totalprice > 300000"


@query("srt01_total_order", f"SELECT DISTINCT * FROM ({_LARGE})")
def total_order(t: Tables):
    return findings.ordered(findings.findings(t.orders.where("o_totalprice > 300000"), "large order", F.col("o_custkey"), "count").distinct())


@query("srt03_report_cap", f"SELECT DISTINCT * FROM ({_LARGE}) ORDER BY class, rule, subject LIMIT 200")
def report_cap(t: Tables):
    """A report of the first 200 findings; gates themselves have no cap."""
    return findings.ordered(findings.findings(t.orders.where("o_totalprice > 300000"), "large order", F.col("o_custkey"), "count").distinct()).limit(200)


@query("set02_difference", "SELECT *, 'removed' AS change FROM (SELECT o_custkey AS node FROM orders WHERE year(o_orderdate) = 1995 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996) UNION ALL SELECT *, 'added' FROM (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1996 EXCEPT SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995)")
def set_difference(t: Tables):
    of = lambda year: t.orders.where(F.year("o_orderdate") == year).select(F.col("o_custkey").alias("node"))
    return project.difference(of(1995), of(1996), ["node"])


@query("gra19_chain", "SELECT r_name, count(DISTINCT n_nationkey) AS nations, count(DISTINCT s_suppkey) AS suppliers, count(DISTINCT l_orderkey) AS orders FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1")
def chain(t: Tables):
    """What a region touches, level by level; each level is counted by itself, so no join multiplies another's rows."""
    supplied = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"))
    touched = supplied.select("n_regionkey", "s_suppkey").join(t.lineitem.select("l_suppkey", "l_orderkey"), F.col("l_suppkey") == F.col("s_suppkey")).select("n_regionkey", "l_orderkey").distinct().groupBy("n_regionkey").agg(F.count("*").alias("orders"))
    nations = t.nation.groupBy("n_regionkey").agg(F.count("*").alias("nations"))
    suppliers = supplied.groupBy("n_regionkey").agg(F.count("*").alias("suppliers"))
    r = t.region.select("r_name", F.col("r_regionkey").alias("n_regionkey"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return r.join(nations, "n_regionkey", "left").join(suppliers, "n_regionkey", "left").join(touched, "n_regionkey", "left").select("r_name", zero("nations"), zero("suppliers"), zero("orders"))


@query("wrt03_retire", """WITH a AS (SELECT p_partkey AS k FROM part WHERE p_size > 25 UNION SELECT p_partkey + 1000000000 FROM part WHERE p_size = 50), j AS (SELECT k, CASE WHEN p_partkey IS NULL THEN 'unknown' WHEN p_brand = 'Brand#11' THEN 'retired already' WHEN EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = k AND l_returnflag = 'R') THEN 'still referenced' END AS reason FROM a LEFT JOIN part ON p_partkey = k)
SELECT k AS p_partkey, coalesce(reason, 'done') AS outcome FROM j""")
def retired(t: Tables):
    records = t.part.select("p_partkey", F.when(F.col("p_brand") == "Brand#11", "retired").otherwise("active").alias("status"))
    asked = t.part.where("p_size > 25").select("p_partkey").union(t.part.where("p_size = 50").select(F.col("p_partkey") + 1000000000))
    after, refused = writes.retire(records, "p_partkey", "status", asked, t.lineitem.where("l_returnflag = 'R'"), "l_partkey")
    done = after.where("status = 'retired'").join(records.where("status = 'active'").select("p_partkey"), "p_partkey", "left_semi")
    return refused.withColumnRenamed("reason", "outcome").unionByName(done.select("p_partkey", F.lit("done").alias("outcome")))


@query("qua04_record_failure", "WITH s AS (SELECT 'ref-' || s_suppkey AS ref, CAST(s_nationkey AS INTEGER) AS attempts, 3 AS last_run, 'old' AS last_error FROM supplier WHERE s_acctbal > 0), f AS (SELECT 'ref-' || s_suppkey AS ref FROM supplier WHERE s_nationkey < 9) SELECT coalesce(s.ref, f.ref) AS ref, coalesce(attempts, 0) + CASE WHEN f.ref IS NULL THEN 0 ELSE 1 END AS attempts, CASE WHEN f.ref IS NULL THEN last_run ELSE 8 END AS last_run, CASE WHEN f.ref IS NULL THEN last_error ELSE 'lost' END AS last_error FROM s FULL JOIN f ON s.ref = f.ref")
def record_failure(t: Tables):
    ref = F.concat(F.lit("ref-"), F.col("s_suppkey").cast("string")).alias("ref")
    state = t.supplier.where("s_acctbal > 0").select(ref, F.col("s_nationkey").cast("int").alias("attempts"), F.lit(3).alias("last_run"), F.lit("old").alias("last_error"))
    return quarantine.record_failure(state, t.supplier.where("s_nationkey < 9").select(ref, F.lit("lost").alias("error")), 8)


# text functions over texts that the tables' columns are written into


@arrow("array<string>")
def _cells(rows: pd.Series) -> pd.Series:
    return pd.Series([md.split_cells(r) for r in rows])


@query("txt09_split_cells", "SELECT p_partkey, CAST(3 AS INTEGER) AS cells, p_name || '|' || p_brand AS middle FROM part")
def split_cells(t: Tables):
    row = F.concat(F.lit("| "), "p_type", F.lit(" | "), "p_name", F.lit("\\|"), "p_brand", F.lit(" | "), F.col("p_size").cast("string"), F.lit(" |"))
    return spread(t.part).select("p_partkey", _cells(row).alias("c")).select("p_partkey", F.size("c").alias("cells"), F.replace(F.trim(F.get("c", F.lit(1))), F.lit("\\|"), F.lit("|")).alias("middle"))


@arrow("string")
def _target(s: pd.Series) -> pd.Series:
    return s.map(reviews.cite_target)


@query("txt33_cite_target", "SELECT c_custkey, upper(c_name) AS target FROM customer")
def cite_target(t: Tables):
    return spread(t.customer).select("c_custkey", _target(F.concat(F.lit("  "), "c_name", F.lit(".md "))).alias("target"))


def _resolved(body, wanted):
    """struct<name, section, found>."""

    def run(bodies: pa.Array, texts: pa.Array) -> pa.Array:
        found = [reviews.resolve_section(w, reviews.item_sections(reviews.section_names(b), b)) for b, w in zip(bodies.to_pylist(), texts.to_pylist())]
        names, sections, hits = zip(*found) if found else ((), (), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(sections, pa.int32()), pa.array(hits, pa.bool_())], ["name", "section", "found"])

    run.__annotations__ = {"bodies": pa.Array, "texts": pa.Array, "return": pa.Array}  # Spark reads the types themselves
    return F.arrow_udf(run, "struct<name:string,section:int,found:boolean>")(body, wanted)


@query("txt23_sections", """SELECT p_partkey, CASE WHEN p_size <= 10 THEN 'costs and prices' WHEN p_size <= 20 THEN '§2' WHEN p_size <= 30 THEN 'parts' WHEN p_size <= 40 THEN '' ELSE 'E-' || p_size END AS name,
CAST(CASE WHEN p_size <= 10 THEN 1 WHEN p_size <= 20 THEN 2 WHEN p_size <= 30 THEN 2 WHEN p_size <= 40 THEN -1 ELSE 3 END AS INTEGER) AS section, p_size NOT BETWEEN 31 AND 40 AS found FROM part""")
def sections(t: Tables):
    """By the prefix of a heading, by number, by an item within a section, not at all, and by a labelled item."""
    size = F.col("p_size")
    body = F.concat(F.lit("# Top\n\n## Costs and prices\n\ntext\n\n## Parts\n\nmore\n\n## Events\n\n- E-"), size.cast("string"), F.lit(": it happens\n"))
    wanted = F.when(size <= 10, "Costs and").when(size <= 20, "2").when(size <= 30, "Part 12").when(size <= 40, "Nothing of the kind").otherwise(F.concat(F.lit("E-"), size.cast("string")))
    return spread(t.part.select("p_partkey", "p_size")).select("p_partkey", _resolved(body, wanted).alias("r")).select("p_partkey", "r.*")


_REF = pa.struct([("raw", pa.string()), ("target", pa.string()), ("section", pa.int32()), ("status", pa.string()), ("line", pa.int32())])
_FOUND = pa.struct([("target", pa.string()), ("cited", pa.string()), ("pin", pa.string()), ("verdict", pa.string()), ("line", pa.int32())])


def _prose(kind, body, version):
    """struct<refs, cites>."""

    def run(kinds: pa.Array, bodies: pa.Array, versions: pa.Array) -> pa.Array:
        found = [reviews.prose_references(k, b, {"PART-INDEX": v}, reviews.section_names(b), {"PART-INDEX": {"prices": 1}}) for k, b, v in zip(kinds.to_pylist(), bodies.to_pylist(), versions.to_pylist())]
        return pa.StructArray.from_arrays([structs([r for r, _ in found], _REF), structs([c for _, c in found], _FOUND)], ["refs", "cites"])

    run.__annotations__ = {"kinds": pa.Array, "bodies": pa.Array, "versions": pa.Array, "return": pa.Array}
    schema = "struct<refs:array<struct<raw:string,target:string,section:int,status:string,line:int>>,cites:array<struct<target:string,cited:string,pin:string,verdict:string,line:int>>>"
    once = F.arrow_udf(run, schema).asNondeterministic()  # else a filter on empty lists runs it a second time, before the rows are spread
    return once(kind, body, version)


_CITE = "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'review' ELSE 'story' END AS kind, month(o_orderdate) AS actual FROM orders"


def _texts(t: Tables):
    """(o_orderkey, kind, body, version): eight marks in each text, three of them in code."""
    body = F.concat(F.lit("## Terms\n\nSee PART-INDEX v1."), F.dayofmonth("o_orderdate").cast("string"), F.lit(" and §Terms, PART-INDEX §Prices, PART-INDEX §Order "), F.col("o_orderkey").cast("string"), F.lit(".\n`PART-INDEX v9.99`\n```\nPART-INDEX v8.88 §Lost\n```\n§Alone in the text.\n"))
    kind = F.when(F.col("o_orderstatus") == "F", "review").otherwise("story")
    return spread(t.orders.select("o_orderkey", "o_orderstatus", "o_orderdate")).select("o_orderkey", kind.alias("kind"), body.alias("body"), F.concat(F.lit("1."), F.month("o_orderdate").cast("string")).alias("version"))


def _cited(t: Tables):
    return _texts(t).select("o_orderkey", _prose(F.col("kind"), F.col("body"), F.col("version")).alias("x"))


@query("txt22_version_cites", f"SELECT o_orderkey, '1.' || day AS cited, CASE WHEN day = actual THEN 'current' WHEN actual < day THEN 'ahead-never-existed' WHEN kind = 'review' THEN 'lagging-pinned-ok' ELSE 'lagging-floating' END AS verdict FROM ({_CITE.replace(' FROM orders', ', day(o_orderdate) AS day FROM orders')})")
def version_cites(t: Tables):
    """One cite of each text; those in code are none."""
    return _cited(t).select("o_orderkey", F.inline("x.cites")).select("o_orderkey", "cited", "verdict")


@query("txt25_section_owners", "SELECT o_orderkey, raw, status FROM orders, LATERAL (VALUES ('§Terms', 'resolved'), ('§prices', 'resolved'), ('§Order ' || o_orderkey, 'dangling'), ('§Alone in the text', 'unresolvable')) AS v(raw, status)")
def section_owners(t: Tables):
    return _cited(t).select("o_orderkey", F.inline("x.refs")).select("o_orderkey", F.when(F.lower("raw") == "§prices", "§prices").otherwise(F.col("raw")).alias("raw"), "status")


@query("txt37_funnel", "SELECT stage, n FROM (SELECT count(*) AS o FROM orders), LATERAL (VALUES ('marks', 8 * o), ('in code', 3 * o), ('version cites', o), ('section references', 4 * o), ('resolved', 2 * o), ('dangling', o), ('unresolvable', o)) AS v(stage, n)")
def funnel(t: Tables):
    """How many marks there are in the texts, and what becomes of them."""
    return text_funnel(_texts(t).select("body", _prose(F.col("kind"), F.col("body"), F.col("version")).alias("x")).select("body", "x.refs", "x.cites"))


@arrow("struct<parts:array<struct<kind:string,sub_id:string,statement:string,form:string,line:int>>,refs:array<struct<kind:string,sub_id:string,target_kind:string,target_id:string,clause:string>>>")
def _parts(bodies: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([reviews.sub_artifacts(b)[:2] for b in bodies], columns=["parts", "refs"])


@query("txt20_sub_artifacts", "SELECT p_partkey, 'AC-001' AS sub_id, 'bc' AS target_kind, 'BC-1.01.' || p_partkey AS target_id, 'postcondition 2' AS clause FROM part UNION ALL SELECT p_partkey, 'EC-002', 'vp', 'VP-' || p_size, '' FROM part")
def sub_artifacts(t: Tables):
    body = F.concat(F.lit("### AC-001: traces to BC-1.01."), F.col("p_partkey").cast("string"), F.lit(" postcondition 2\n```\n### AC-009: BC-9.09.009\n```\n| EC-002 | checked by VP-"), F.col("p_size").cast("string"), F.lit(" and `VP-999` |\n"))
    return spread(t.part).select("p_partkey", _parts(body).alias("x")).select("p_partkey", F.inline("x.refs")).select("p_partkey", "sub_id", "target_kind", "target_id", "clause")


@arrow("array<string>")
def _wrapped(bodies: pd.Series) -> pd.Series:
    return pd.Series([md.frontmatter(b).many("items") for b in bodies])


@query("txt03_coercion", "SELECT p_partkey, p_brand AS first, CAST(2 AS INTEGER) AS n FROM part")
def coercion(t: Tables):
    """A list over several lines of frontmatter."""
    body = F.concat(F.lit("---\nitems:\n  - "), "p_brand", F.lit("\n  - \"x, y\"\nnone: []\n---\ntext\n"))
    return spread(t.part).select("p_partkey", _wrapped(body).alias("i")).select("p_partkey", F.get("i", F.lit(0)).alias("first"), F.size("i").alias("n"))
