"""The typed multigraph as two DataFrames, rebuilt from tables on every use.

nodes (type, key) holds declared nodes; edges (src_type, src_key, dst_type, dst_key, link) keeps parallel edges and drops
self-edges. An edge may name a node that nothing declares.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared

PINS = {"index_cite": "floating", "review_cite": "pinned"}  #: other links are read as of a version


@dataclass(frozen=True)
class NodeSource:
    """A table that declares nodes of a type."""

    type: str
    table: DataFrame
    key: str


@dataclass(frozen=True)
class EdgeSource:
    """A table whose rows are edges."""

    link: str
    table: DataFrame
    src_type: str
    src: str
    dst_type: str
    dst: str


def _key(name: str) -> Column:
    return F.col(name).cast("string")


def nodes(sources: list[NodeSource]) -> DataFrame:
    """(type, key), once each; no source at all is an error, as an empty graph would look clean."""
    if not sources:
        raise ValueError("no table declares nodes")
    parts = [s.table.select(F.lit(s.type).alias("type"), _key(s.key).alias("key")).where("key IS NOT NULL AND key <> ''") for s in sources]
    return reduce(DataFrame.unionByName, parts).distinct()


def edges(sources: list[EdgeSource]) -> DataFrame:
    """All edges, parallel ones too, without self-edges."""
    parts = [
        s.table.select(F.lit(s.src_type).alias("src_type"), _key(s.src).alias("src_key"), F.lit(s.dst_type).alias("dst_type"), _key(s.dst).alias("dst_key"), F.lit(s.link).alias("link"))
        for s in sources
    ]
    every = reduce(DataFrame.unionByName, parts).where("src_key IS NOT NULL AND src_key <> '' AND dst_key IS NOT NULL AND dst_key <> ''")
    return every.where("NOT (src_type = dst_type AND src_key = dst_key)")


def oriented(dependencies: DataFrame, a: str, b: str, kind: str) -> DataFrame:
    """(src, dst) so that src depends on dst: 'a blocks b' turns round. A pair stated by both sides gives two rows."""
    swap = F.col(kind) == "blocks"
    return dependencies.select(F.when(swap, F.col(b)).otherwise(F.col(a)).alias("src"), F.when(swap, F.col(a)).otherwise(F.col(b)).alias("dst"))


def pinned(graph: DataFrame, pins: dict[str, str] = PINS) -> DataFrame:
    """Edges with their pin policy; a link without one is read as of a version."""
    policy = F.lit(None).cast("string")
    for link, pin in pins.items():
        policy = F.when(F.col("link") == link, pin).otherwise(policy)
    return graph.withColumn("pin_policy", F.coalesce(policy, F.lit("as_of")))


def _ends(graph: DataFrame) -> DataFrame:
    return graph.select(F.explode(F.array(F.struct(F.col("src_type").alias("type"), F.col("src_key").alias("key")), F.struct(F.col("dst_type").alias("type"), F.col("dst_key").alias("key")))).alias("e")).select("e.type", "e.key")


def all_nodes(declared: DataFrame, graph: DataFrame) -> DataFrame:
    """(type, key, declared) of declared nodes and of those that edges name."""
    marked = declared.withColumn("d", F.lit(1)).unionByName(_ends(graph).withColumn("d", F.lit(0)))
    return marked.groupBy("type", "key").agg((F.max("d") == 1).alias("declared"))


def undeclared(declared: DataFrame, graph: DataFrame) -> DataFrame:
    """(type, key) of nodes that edges name and nothing declares."""
    return _ends(graph).distinct().join(declared, ["type", "key"], "left_anti")


def counts(declared: DataFrame, graph: DataFrame) -> DataFrame:
    """(what, type, n): nodes by type, edges by link."""
    n = all_nodes(declared, graph).groupBy(F.col("type")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "type", "n")
    return n.unionByName(graph.groupBy(F.col("link").alias("type")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "type", "n"))


def simple(graph: DataFrame) -> DataFrame:
    """Distinct pairs, whatever the link."""
    return graph.select("src_type", "src_key", "dst_type", "dst_key").distinct()


def undirected(pairs: DataFrame) -> DataFrame:
    """Distinct pairs both ways; pairs need not be distinct. Each is made distinct one way round, whichever it was stated, and turned after that."""
    a, b = (F.struct(F.col(f"{x}_type").alias("type"), F.col(f"{x}_key").alias("key")) for x in ("src", "dst"))
    one = pairs.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).select(F.col("a.type").alias("at"), F.col("a.key").alias("ak"), F.col("b.type").alias("bt"), F.col("b.key").alias("bk"))
    one = shared(one, "ak", "bk").distinct()
    way = lambda x, y: F.struct(F.col(f"{x}t").alias("src_type"), F.col(f"{x}k").alias("src_key"), F.col(f"{y}t").alias("dst_type"), F.col(f"{y}k").alias("dst_key"))
    own = F.col("at").eqNullSafe(F.col("bt")) & F.col("ak").eqNullSafe(F.col("bk"))
    return one.select(F.explode(F.when(own, F.array(way("a", "b"))).otherwise(F.array(way("a", "b"), way("b", "a")))).alias("p")).select("p.*")


def degrees(graph: DataFrame) -> DataFrame:
    """(type, key, degree_multi, degree_simple): edges at a node, with parallel ones and as distinct directed pairs."""
    pair = ["src_type", "src_key", "dst_type", "dst_key"]
    weighed = graph.groupBy(*pair).agg(F.count("*").alias("n"))
    ends = weighed.select(F.explode(F.array(F.struct(F.col("src_type").alias("type"), F.col("src_key").alias("key")), F.struct(F.col("dst_type").alias("type"), F.col("dst_key").alias("key")))).alias("e"), "n")
    return ends.groupBy("e.type", "e.key").agg(F.sum("n").alias("degree_multi"), F.count("*").alias("degree_simple"))


def centralities(pairs: DataFrame, betweenness: DataFrame, ranks: DataFrame) -> DataFrame:
    """(node, betweenness, pagerank, degree) of edges (src, dst); betweenness stays null where it was refused or not asked for."""
    degree = pairs.select(F.explode(F.array("src", "dst")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
    return degree.join(betweenness.select("node", "betweenness"), "node", "left").join(ranks.select("node", "pagerank"), "node", "left").select("node", "betweenness", "pagerank", "degree")


def scope(graph: DataFrame, seeds: DataFrame) -> DataFrame:
    """(type, key, seed) of the seeds and what is one edge away from them."""
    s = seeds.select("type", "key").distinct()
    out = graph.join(s.select(F.col("type").alias("src_type"), F.col("key").alias("src_key")), ["src_type", "src_key"], "left_semi").select(F.col("dst_type").alias("type"), F.col("dst_key").alias("key"))
    into = graph.join(s.select(F.col("type").alias("dst_type"), F.col("key").alias("dst_key")), ["dst_type", "dst_key"], "left_semi").select(F.col("src_type").alias("type"), F.col("src_key").alias("key"))
    return s.withColumn("s", F.lit(1)).unionByName(out.union(into).withColumn("s", F.lit(0))).groupBy("type", "key").agg((F.max("s") == 1).alias("seed"))


def difference(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(columns, change): rows, as sets, that were added or removed. One grouping of both; nulls are equal, as in EXCEPT."""
    both = before.select(*columns, F.lit(False).alias("new")).unionByName(after.select(*columns, F.lit(True).alias("new")))
    held = shared(both, *columns).groupBy(*columns).agg(F.min("new").alias("new"), F.max("new").alias("last")).where("new = last")
    return held.select(*columns, F.when(F.col("new"), "added").otherwise("removed").alias("change"))


def dot(declared: DataFrame, graph: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(ord, line) of a Graphviz text of the whole graph or of the scope of seeds; undeclared nodes are dashed."""
    quote = lambda t, k: F.concat(F.lit('"'), F.regexp_replace(F.concat_ws(":", t, k), r'(["\\])', r"\\$1"), F.lit('"'))
    n, e = all_nodes(declared, graph), graph
    if seeds is not None:
        inside = scope(graph, seeds).select("type", "key")
        n = n.join(inside, ["type", "key"], "left_semi")
        e = e.join(inside.toDF("src_type", "src_key"), ["src_type", "src_key"], "left_semi").join(inside.toDF("dst_type", "dst_key"), ["dst_type", "dst_key"], "left_semi")
    style = F.when(F.col("declared"), F.lit("")).otherwise(F.lit(" [style=dashed, color=red]"))
    node_lines = n.select(F.concat(F.lit("1 "), F.concat_ws(":", "type", "key")).alias("ord"), F.concat(F.lit("  "), quote(F.col("type"), F.col("key")), style, F.lit(";")).alias("line"))
    edge_lines = e.select(F.concat(F.lit("2 "), F.concat_ws(":", "src_type", "src_key", "dst_type", "dst_key", "link")).alias("ord"), F.concat(F.lit("  "), quote(F.col("src_type"), F.col("src_key")), F.lit(" -> "), quote(F.col("dst_type"), F.col("dst_key")), F.lit(' [label="'), F.col("link"), F.lit('"];')).alias("line"))
    frame = graph.sparkSession.createDataFrame([("0", "digraph g {"), ("3", "}")], "ord string, line string")
    return frame.unionByName(node_lines).unionByName(edge_lines)
