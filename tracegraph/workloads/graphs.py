"""The typed graph of the star schema, traversals and kernels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..graph import kernels, project, traverse
from .base import Tables, query


def typed(t: Tables) -> tuple[DataFrame, DataFrame]:
    """(declared nodes, edges). Parts over size 45 are referenced but not declared; brands lead back to their own part for self-edges."""
    sources = [project.NodeSource("region", t.region, "r_regionkey"), project.NodeSource("nation", t.nation, "n_nationkey"), project.NodeSource("customer", t.customer, "c_custkey"), project.NodeSource("supplier", t.supplier, "s_suppkey"), project.NodeSource("part", t.part.where("p_size <= 45"), "p_partkey")]
    links = [
        project.EdgeSource("lies_in", t.nation, "nation", "n_nationkey", "region", "n_regionkey"),
        project.EdgeSource("lives_in", t.customer, "customer", "c_custkey", "nation", "c_nationkey"),
        project.EdgeSource("sits_in", t.supplier, "supplier", "s_suppkey", "nation", "s_nationkey"),
        project.EdgeSource("supplies", t.lineitem.where("l_returnflag <> 'N'"), "supplier", "l_suppkey", "part", "l_partkey"),
    ]
    return project.nodes(sources), project.edges(links)


_NODES = """SELECT 'region' AS type, CAST(r_regionkey AS VARCHAR) AS key FROM region UNION ALL SELECT 'nation', CAST(n_nationkey AS VARCHAR) FROM nation UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier UNION ALL SELECT 'part', CAST(p_partkey AS VARCHAR) FROM part WHERE p_size <= 45"""
_EDGES = """SELECT 'nation' AS st, CAST(n_nationkey AS VARCHAR) AS sk, 'region' AS dt, CAST(n_regionkey AS VARCHAR) AS dk, 'lies_in' AS link FROM nation
UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'nation', CAST(c_nationkey AS VARCHAR), 'lives_in' FROM customer
UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'nation', CAST(s_nationkey AS VARCHAR), 'sits_in' FROM supplier
UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), 'part', CAST(l_partkey AS VARCHAR), 'supplies' FROM lineitem WHERE l_returnflag <> 'N'"""
_WITH = f"WITH n AS ({_NODES}), e AS ({_EDGES}), ends AS (SELECT st AS type, sk AS key FROM e UNION ALL SELECT dt, dk FROM e)"


@query("gra01_projection", f"{_WITH} SELECT type, key, bool_or(d) AS declared FROM (SELECT *, true AS d FROM n UNION ALL SELECT *, false FROM ends) GROUP BY 1, 2")
def projection(t: Tables):
    return project.all_nodes(*typed(t))


@query("gra02_direction", """
SELECT src, dst, count(*) AS n FROM (SELECT CASE WHEN k = 'blocks' THEN b ELSE a END AS src, CASE WHEN k = 'blocks' THEN a ELSE b END AS dst
FROM (SELECT l_partkey AS a, l_suppkey AS b, CASE WHEN l_returnflag = 'R' THEN 'blocks' ELSE 'depends_on' END AS k FROM lineitem)) GROUP BY 1, 2""")
def direction(t: Tables):
    d = t.lineitem.select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), F.when(F.col("l_returnflag") == "R", "blocks").otherwise("depends_on").alias("k"))
    return project.oriented(d, "a", "b", "k").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query("gra03_self_edges", "SELECT count(*) AS n FROM (SELECT p_partkey AS a, p_partkey // 2 AS b FROM part) WHERE a <> b")
def self_edges(t: Tables):
    own = t.part.select("p_partkey", F.expr("p_partkey div 2").alias("half"))
    return project.edges([project.EdgeSource("half", own, "part", "p_partkey", "part", "half")]).agg(F.count("*").alias("n"))


@query("gra04_pins", f"WITH e AS ({_EDGES}) SELECT link, CASE link WHEN 'sits_in' THEN 'floating' WHEN 'supplies' THEN 'pinned' ELSE 'as_of' END AS pin_policy, count(*) AS n FROM e GROUP BY 1, 2")
def pins(t: Tables):
    return project.pinned(typed(t)[1], {"sits_in": "floating", "supplies": "pinned"}).groupBy("link", "pin_policy").agg(F.count("*").alias("n"))


@query("gra05_counts", f"{_WITH} SELECT 'node' AS what, type, count(*) AS n FROM (SELECT * FROM n UNION SELECT * FROM ends) GROUP BY 2 UNION ALL SELECT 'edge', link, count(*) FROM e GROUP BY 2")
def counts(t: Tables):
    return project.counts(*typed(t))


@query("gra06_dangling", f"{_WITH} SELECT DISTINCT type, key FROM ends WHERE (type, key) NOT IN (SELECT (type, key) FROM n)")
def dangling(t: Tables):
    return project.undeclared(*typed(t))


@query("gra07_degree", f"{_WITH} SELECT type, key, count(*) AS degree_multi, CAST(sum(first) AS BIGINT) AS degree_simple FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY st, sk, dt, dk) = 1 THEN 1 ELSE 0 END AS first FROM e) x, LATERAL (SELECT st AS type, sk AS key UNION ALL SELECT dt, dk) GROUP BY 1, 2")
def degree(t: Tables):
    return project.degrees(typed(t)[1])


@query("gra08_simple", f"{_WITH}, u AS (SELECT st, sk, dt, dk FROM e UNION SELECT dt, dk, st, sk FROM e) SELECT st AS src_type, dt AS dst_type, count(*) AS n FROM u GROUP BY 1, 2")
def simple(t: Tables):
    return project.undirected(typed(t)[1]).groupBy("src_type", "dst_type").agg(F.count("*").alias("n"))


def forest(t: Tables) -> DataFrame:
    """(src, dst): part k depends on part k div 2."""
    return t.part.where("p_partkey > 1").select(F.col("p_partkey").alias("src"), F.expr("p_partkey div 2").alias("dst"))


_FOREST = "SELECT p_partkey AS src, p_partkey // 2 AS dst FROM part WHERE p_partkey > 1"


@query("gra11_waves", f"WITH RECURSIVE e AS ({_FOREST}), w AS (SELECT 1 AS node, 1 AS wave UNION ALL SELECT src, wave + 1 FROM w JOIN e ON dst = node) SELECT CAST(node AS BIGINT) AS node, wave FROM w")
def waves(t: Tables):
    return kernels.schedule(forest(t)).select(F.col("node").cast("long").alias("node"), F.col("wave").cast("int").alias("wave"))


@query("gra15_diff", f"{_WITH}, a AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_shipdate < '1997-01-01'), b AS (SELECT DISTINCT l_suppkey AS src, l_partkey AS dst FROM lineitem WHERE l_shipdate >= '1993-01-01') SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def diff(t: Tables):
    pairs = lambda x: t.lineitem.where(x).select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"))
    return project.difference(pairs("l_shipdate < '1997-01-01'"), pairs("l_shipdate >= '1993-01-01'"), ["src", "dst"])


@query("gra18_scope", f"{_WITH}, s AS (SELECT 'nation' AS type, '3' AS key), r AS (SELECT type, key, 1 AS seed FROM s UNION ALL SELECT dt, dk, 0 FROM e JOIN s ON st = type AND sk = key UNION ALL SELECT st, sk, 0 FROM e JOIN s ON dt = type AND dk = key) SELECT type, key, max(seed) = 1 AS seed FROM r GROUP BY 1, 2")
def scope(t: Tables):
    seeds = t.spark.createDataFrame([("nation", "3")], "type string, key string")
    return project.scope(typed(t)[1], seeds)


@query("snk09_dot", f"""{_WITH}, s AS (SELECT 'nation' AS type, '3' AS key), r AS (SELECT type, key FROM s UNION SELECT dt, dk FROM e JOIN s ON st = type AND sk = key UNION SELECT st, sk FROM e JOIN s ON dt = type AND dk = key),
a AS (SELECT r.*, EXISTS (SELECT 1 FROM n WHERE n.type = r.type AND n.key = r.key) AS declared FROM r),
inside AS (SELECT e.* FROM e SEMI JOIN r ON st = r.type AND sk = r.key SEMI JOIN r AS q ON dt = q.type AND dk = q.key)
SELECT '0' AS ord, 'digraph g {{' AS line UNION ALL SELECT '3', '}}' UNION ALL SELECT '1 ' || type || ':' || key, '  "' || type || ':' || key || '"' || CASE WHEN declared THEN '' ELSE ' [style=dashed, color=red]' END || ';' FROM a
UNION ALL SELECT '2 ' || concat_ws(':', st, sk, dt, dk, link), '  "' || st || ':' || sk || '" -> "' || dt || ':' || dk || '" [label="' || link || '"];' FROM inside""")
def dot(t: Tables):
    seeds = t.spark.createDataFrame([("nation", "3")], "type string, key string")
    return project.dot(*typed(t), seeds)


def transitions(t: Tables) -> DataFrame:
    """(src, dst): what kind of event of a user followed which, over all events; a graph with cycles, in as many components as there are users."""
    own = t.events.withColumn("next", F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    node = lambda kind: F.concat_ws(":", "user_id", kind)
    return own.where("next IS NOT NULL AND next <> event_type").select(node("event_type").alias("src"), node("next").alias("dst")).distinct()


def supply(t: Tables) -> DataFrame:
    """(src, dst) of every line item: a part leads to its supplier, a returned one from it. Keys are whole, and typed, as parts and suppliers share numbers."""
    back = F.col("l_returnflag") == "R"
    part, supplier = F.concat(F.lit("part:"), "l_partkey"), F.concat(F.lit("supplier:"), "l_suppkey")
    return t.lineitem.select(F.when(back, supplier).otherwise(part).alias("src"), F.when(back, part).otherwise(supplier).alias("dst")).distinct()


_SUPPLY = "SELECT DISTINCT CASE WHEN l_returnflag = 'R' THEN s ELSE p END AS src, CASE WHEN l_returnflag = 'R' THEN p ELSE s END AS dst FROM (SELECT l_returnflag, 'part:' || l_partkey AS p, 'supplier:' || l_suppkey AS s FROM lineitem)"
_EVENTS = "SELECT DISTINCT user_id || ':' || event_type AS src, user_id || ':' || next AS dst FROM (SELECT user_id, event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) WHERE next <> event_type"
_CLOSURE = f"WITH RECURSIVE e AS ({_EVENTS}), c AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM c JOIN e ON node = src)"
_BOTH_WAYS = f"WITH RECURSIVE d AS ({_EVENTS}), e AS (SELECT * FROM d UNION SELECT dst, src FROM d)"


@query("gra09_scc", f"{_CLOSURE}, p AS (SELECT a.root, a.node FROM c a JOIN c b ON a.root = b.node AND a.node = b.root) SELECT root AS node, min(node) AS component FROM p GROUP BY 1 HAVING count(DISTINCT node) > 1")
def scc(t: Tables):
    return kernels.strong_components(transitions(t))


def ordering(t: Tables) -> DataFrame:
    """(src, dst): a customer leads to its orders, an order to its lines; a tree for each customer, over all orders and line items."""
    order = F.concat(F.lit("order:"), F.col("o_orderkey").cast("string"))
    first = t.orders.select(F.concat(F.lit("customer:"), F.col("o_custkey").cast("string")).alias("src"), order.alias("dst"))
    line = F.concat_ws(":", F.lit("line"), F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return first.union(t.lineitem.select(F.concat(F.lit("order:"), F.col("l_orderkey").cast("string")), line))  # what is cut doesn't change with parallel edges


@query("gra10_articulation", """WITH e AS (SELECT 'customer:' || o_custkey AS a, 'order:' || o_orderkey AS b FROM orders UNION SELECT 'order:' || l_orderkey, 'line:' || l_orderkey || ':' || l_linenumber FROM lineitem),
d AS (SELECT node, count(*) AS n FROM (SELECT a AS node FROM e UNION ALL SELECT b FROM e) GROUP BY 1) SELECT node FROM d WHERE n > 1""")
def articulation(t: Tables):
    """In a tree every node with two neighbours cuts; the SQL says that, the kernel finds it by search."""
    return kernels.articulation_points(ordering(t))


@query("gra10_articulation_supply")
def articulation_supply(t: Tables):
    return kernels.articulation_points(supply(t))


@query("gra12_betweenness", f"""WITH RECURSIVE e AS ({_EVENTS}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
w AS (SELECT node AS root, node, 0 AS depth FROM v UNION ALL SELECT root, dst, depth + 1 FROM w JOIN e ON src = w.node WHERE depth < 5),
m AS (SELECT root, node, min(depth) AS d, count(*) FILTER (WHERE depth = least) AS n FROM (SELECT *, min(depth) OVER (PARTITION BY root, node) AS least FROM w) GROUP BY 1, 2),
b AS (SELECT x.node, sum(x.n * y.n / z.n) AS s FROM m x JOIN m y ON y.root = x.node JOIN m z ON z.root = x.root AND z.node = y.node WHERE x.d > 0 AND y.d > 0 AND x.d + y.d = z.d GROUP BY 1)
SELECT v.node, round(coalesce(s, 0.0), 6) AS betweenness, CAST(NULL AS VARCHAR) AS refused FROM v LEFT JOIN b USING (node)""")
def betweenness(t: Tables):
    return kernels.betweenness_scores(transitions(t)).withColumn("betweenness", F.round("betweenness", 6))


_RANKS = 20


@query("gra13_pagerank", f"""WITH RECURSIVE e AS ({_SUPPLY}), v AS (SELECT src AS node FROM e UNION SELECT dst FROM e), n AS (SELECT count(*) AS n FROM v),
o AS (SELECT node, out FROM v LEFT JOIN (SELECT src AS node, count(*) AS out FROM e GROUP BY 1) USING (node)),
r AS (SELECT 0 AS turn, node, 1.0 / n AS rank FROM v, n UNION ALL (
  WITH now AS (SELECT turn, node, rank, out FROM r JOIN o USING (node) WHERE turn < {_RANKS}), lost AS (SELECT coalesce(sum(rank) FILTER (WHERE out IS NULL), 0.0) AS lost FROM now),
  got AS (SELECT dst AS node, sum(rank / out) AS got FROM now JOIN e ON src = node GROUP BY 1)
  SELECT turn + 1, now.node, 0.15 / n + 0.85 * (lost / n + coalesce(got, 0.0)) FROM now LEFT JOIN got ON got.node = now.node, n, lost))
SELECT node, round(rank, 9) AS rank FROM r WHERE turn = {_RANKS}""")
def pagerank(t: Tables):
    """As many rounds as the SQL takes; the operator itself goes on to a tolerance."""
    return traverse.pagerank(supply(t), tolerance=0.0, most=_RANKS).select("node", F.round("rank", 9).alias("rank"))


@query("gra14_communities")
def communities(t: Tables):
    return kernels.community_labels(supply(t))


@query("gra16_components", f"{_BOTH_WAYS}, c AS (SELECT src AS root, dst AS node FROM e UNION SELECT root, dst FROM c JOIN e ON node = src) SELECT root AS node, least(root, min(node)) AS component FROM c GROUP BY root")
def components(t: Tables):
    return traverse.components(transitions(t))


@query("rec01_reach", f"WITH RECURSIVE e AS ({_FOREST}), c AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT root, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 5) SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2")
def reach(t: Tables):
    e = forest(t)
    return traverse.reach(e, e.select(F.col("src").alias("root")), 5)


@query("rec02_terminates", f"{_CLOSURE} SELECT root, count(*) AS reached FROM c GROUP BY root")
def terminates(t: Tables):
    """What each node reaches, itself included only by a cycle; without a bound on depth."""
    e = transitions(t)
    return traverse.reach(e, e.select(F.col("src").alias("root"))).groupBy("root").agg(F.count("*").alias("reached"))


@query("rec03_cycles", f"{_CLOSURE} SELECT DISTINCT node FROM c WHERE root = node")
def cycles(t: Tables):
    return traverse.on_cycles(transitions(t))


@query("rec04_closure", f"WITH RECURSIVE e AS ({_EVENTS}), c AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION SELECT root, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 8) SELECT root, node, min(depth) AS depth FROM c GROUP BY 1, 2")
def closure(t: Tables):
    return traverse.closure(transitions(t), 8)


@query("rec04_paths", f"WITH RECURSIVE e AS ({_EVENTS}), c AS (SELECT src AS root, dst AS node, 1 AS depth FROM e UNION ALL SELECT root, dst, depth + 1 FROM c JOIN e ON node = src WHERE depth < 4) SELECT root, node, count(*) AS paths FROM c GROUP BY 1, 2")
def paths(t: Tables):
    return traverse.path_counts(transitions(t), 4)


@query("rec05_impact", f"WITH RECURSIVE e AS ({_FOREST}), c AS (SELECT dst AS root, src AS node, 1 AS depth FROM e WHERE dst IN (3, 5, 11) UNION ALL SELECT root, src, depth + 1 FROM c JOIN e ON node = dst) SELECT root, node, depth FROM c")
def impact(t: Tables):
    back = forest(t).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return traverse.reach(back, t.spark.createDataFrame([(3,), (5,), (11,)], "root long"))
