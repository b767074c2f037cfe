"""Text functions over document lines, and strings made from keys where documents lack the structure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns
from ..operators import integrity
from .base import Tables, query, spread


@query("txt04_first_line", "SELECT doc_id, trim(regexp_extract('# ' || text, '^# ([^\\n]*)', 1)) AS title FROM documents")
def first_line(t: Tables):
    return t.documents.select("doc_id", columns.first_line(F.concat(F.lit("# "), F.col("text"))).alias("title"))


@query("txt05_trunc", "SELECT doc_id, substr(text, 1, 40) AS head, length(substr(text, 1, 40)) AS n FROM documents")
def trunc(t: Tables):
    head = columns.truncated(F.col("text"), 40)
    return t.documents.select("doc_id", head.alias("head"), F.length(head).cast("long").alias("n"))


@query("txt06_canonical", "SELECT c_custkey, upper(c_mktsegment || '-' || c_name) AS id FROM customer")
def canonical(t: Tables):
    return t.customer.select("c_custkey", F.upper(F.concat_ws("-", "c_mktsegment", "c_name")).alias("id"))


_DOC = "'intro' || chr(10) || '## One ' || p_brand || chr(10) || p_name || chr(10) || '### Two' || chr(10) || p_type || chr(10)"


def _doc():
    return F.concat(F.lit("intro\n## One "), F.col("p_brand"), F.lit("\n"), F.col("p_name"), F.lit("\n### Two\n"), F.col("p_type"), F.lit("\n"))


@query("txt07_sections", f"""
SELECT p_partkey, s.ord, s.heading, s.body FROM part, LATERAL (SELECT unnest([{{'ord': 0, 'heading': '', 'body': 'intro' || chr(10)}}, {{'ord': 1, 'heading': 'One ' || p_brand, 'body': '## One ' || p_brand || chr(10) || p_name || chr(10)}}, {{'ord': 2, 'heading': 'Two', 'body': '### Two' || chr(10) || p_type || chr(10)}}]) AS s)""")
def sections(t: Tables):
    return spread(t.part).select("p_partkey", F.inline(columns.sections(_doc()))).select("p_partkey", "ord", "heading", "body")


@query("txt07_lossless", f"SELECT count(*) AS docs, count(*) AS lossless FROM (SELECT {_DOC} FROM part)")
def lossless(t: Tables):
    own = spread(t.part).select(_doc().alias("d")).withColumn("s", columns.sections(F.col("d")))
    return own.agg(F.count("*").alias("docs"), F.count_if(F.array_join(F.col("s.body"), "") == F.col("d")).alias("lossless"))


def _table():
    return F.concat(F.lit("## Parts\n| ID | Title | Size |\n|---|:--|--:|\n| "), F.col("p_partkey").cast("string"), F.lit(" | **"), F.col("p_name"), F.lit("** | "), F.col("p_size").cast("string"), F.lit(" |\n"))


@query("txt08_tables", "SELECT p_partkey, 'Parts' AS heading, CAST(p_partkey AS VARCHAR) AS id, p_name AS title, CAST(p_size AS BIGINT) AS size FROM part")
def tables(t: Tables):
    rows = spread(t.part).select("p_partkey", F.inline(columns.tables(_table()))).select("p_partkey", "heading", F.explode("rows.cells").alias("c"))
    return rows.select("p_partkey", "heading", F.get("c", F.lit(0)).alias("id"), columns.normal_cell(F.get("c", F.lit(1))).alias("title"), columns.leading_int(F.get("c", F.lit(2))).alias("size"))


@query("txt11_normalize", "SELECT p_partkey, trim(regexp_replace(p_name || ' (' || p_brand || ')  ~', '[ ]+', ' ', 'g')) AS cell FROM part")
def normalize(t: Tables):
    raw = F.concat(F.lit("  **["), F.col("p_name"), F.lit("](http://x)**  (`"), F.col("p_brand"), F.lit("`)  ~"))
    return t.part.select("p_partkey", columns.normal_cell(raw).alias("cell"))


@query("txt12_leading_int", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size * 1000 END AS n FROM (SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part)")
def leading_int(t: Tables):
    raw = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("**"), F.format_number(F.col("p_size") * 1000, 0), F.lit("** items"))).otherwise(F.lit("TBD"))
    return t.part.select("p_partkey", columns.leading_int(raw).alias("n"))


@query("txt13_lists", "SELECT p_partkey, p_brand || ';' || p_size AS members FROM part")
def lists(t: Tables):
    raw = F.concat(F.col("p_brand"), F.lit(" , TBD; "), F.col("p_size").cast("string"), F.lit(", n/a"))
    return t.part.select("p_partkey", F.array_join(columns.split_list(raw), ";").alias("members"))


@query("txt15_mask", "SELECT p_partkey, p_name || repeat(' ', length(p_brand) + 4) || p_type AS masked FROM part")
def mask(t: Tables):
    raw = F.concat(F.col("p_name"), F.lit("`"), F.col("p_brand"), F.lit("`  "), F.col("p_type"))
    return spread(t.part).select("p_partkey", columns.mask_code(raw).alias("masked"))


@query("txt16_findings", "SELECT p_partkey, 'F-' || p_partkey AS finding_id, p_name AS statement, CASE p_size % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE '' END AS severity, p_size % 2 = 0 AS owned FROM part")
def findings(t: Tables):
    size = F.col("p_size")
    doc = F.concat(F.when(size % 2 == 0, "# New findings\n").otherwise("# Fix verification\n"), F.lit("### F-"), F.col("p_partkey").cast("string"), F.lit(": "), F.col("p_name"), F.lit("\n"), F.when(size % 3 == 0, "- Severity: high\n").when(size % 3 == 1, "**Severity:** LOW\n").otherwise("text\n"))
    return spread(t.part).select("p_partkey", F.inline(columns.review_findings(doc))).select("p_partkey", "finding_id", "statement", "severity", "owned")


@query("txt18_level", "SELECT o_orderkey, CASE CAST(substr(o_orderpriority, 1, 1) AS INTEGER) WHEN 1 THEN 'CRIT' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'MED' WHEN 5 THEN 'LOW' ELSE '' END AS level FROM orders")
def level(t: Tables):
    word = F.when(F.col("o_orderpriority").startswith("1"), "critical").when(F.col("o_orderpriority").startswith("3"), "M").otherwise(F.split_part("o_orderpriority", F.lit("-"), F.lit(2)))
    word = F.when(F.col("o_orderpriority").startswith("4"), "whatever").otherwise(word)
    return t.orders.select("o_orderkey", columns.level(word).alias("level"))


@query("txt19_distribution", "SELECT p_partkey, CAST(p_size AS BIGINT) AS high, CAST(p_partkey % 9 AS BIGINT) AS low FROM part")
def distribution(t: Tables):
    raw = F.concat(F.col("p_size").cast("string"), F.lit("H/"), (F.col("p_partkey") % 9).cast("string"), F.lit(" low"))
    counts = F.transform(F.regexp_extract_all(raw, F.lit(r"(\d+)[ \t]*([a-zA-Z]+)"), F.lit(0)), lambda x: F.struct(columns.level(F.regexp_extract(x, "([A-Za-z]+)", 1)).alias("level"), F.regexp_extract(x, r"(\d+)", 1).cast("long").alias("n")))
    of = lambda k: F.aggregate(F.filter(counts, lambda s: s["level"] == k), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    return t.part.select("p_partkey", of("HIGH").alias("high"), of("LOW").alias("low"))


@query("txt21_sub_kind", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ac' WHEN 1 THEN 'pc' ELSE '' END AS kind, CASE p_size % 3 WHEN 0 THEN 'AC-' || p_size WHEN 1 THEN 'PC-' || p_size ELSE 'Z' || p_size END AS sub_id FROM part")
def sub_kind(t: Tables):
    size = F.col("p_size").cast("string")
    name = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("AC-"), size)).when(F.col("p_size") % 3 == 1, F.concat(F.lit("PC"), size)).otherwise(F.concat(F.lit("Z"), size))
    return t.part.select("p_partkey", columns.sub_kind(name).alias("s")).select("p_partkey", "s.kind", "s.sub_id")


@query("txt26_version_less", "SELECT p_partkey, p_size % 7 < p_partkey % 7 OR (p_size % 7 = p_partkey % 7 AND p_size < 25) AS less FROM part")
def version_less(t: Tables):
    v = lambda a, b: F.concat_ws(".", a.cast("string"), b.cast("string"))
    return t.part.select("p_partkey", columns.version_less(v(F.col("p_size") % 7, F.col("p_size")), v(F.col("p_partkey") % 7, F.lit(25))).alias("less"))


@query("txt28_ledger_split", "SELECT o_orderkey, e.ord, e.entry, e.date FROM orders, LATERAL (SELECT unnest([{'ord': 0, 'entry': strftime(o_orderdate, '%Y-%m-%d') || ' (v1) ' || o_orderstatus || ' ', 'date': strftime(o_orderdate, '%Y-%m-%d')}, {'ord': 1, 'entry': ' ' || o_orderpriority || ']', 'date': ''}]) AS e)")
def ledger_split(t: Tables):
    raw = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" (v1) "), F.col("o_orderstatus"), F.lit(" [Prior: "), F.col("o_orderpriority"), F.lit("]"))
    return t.orders.select("o_orderkey", F.inline(columns.ledger_entries(raw)))


@query("txt29_cut_last", "SELECT c_custkey, c_mktsegment || '|' || c_nationkey AS before, c_name AS after FROM customer")
def cut_last(t: Tables):
    raw = F.concat_ws("|", "c_mktsegment", F.col("c_nationkey").cast("string"), "c_name")
    return t.customer.select("c_custkey", columns.cut_last(raw, "|").alias("x")).select("c_custkey", "x.before", "x.after")


@query("txt30_commas", "SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) AS n FROM orders")
def commas(t: Tables):
    return t.orders.select("o_orderkey", columns.commas(F.format_number(F.round("o_totalprice"), 0)).alias("n"))


_INDEX = """SELECT p_partkey, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN '' WHEN 3 THEN substr(p_name, 1, length(p_name) - 2) WHEN 4 THEN p_name || ' more' WHEN 5 THEN 'S-1.1: ' || p_name WHEN 6 THEN p_name ELSE 'something else' END AS authored, CASE WHEN p_partkey % 9 = 6 THEN '' ELSE p_name END AS derived FROM part"""


@query("txt32_cell_outcomes", f"""
SELECT CASE k WHEN 0 THEN 'agree' WHEN 1 THEN CASE WHEN same THEN 'agree' ELSE 'agree-casefold' END WHEN 2 THEN 'index-placeholder' WHEN 3 THEN 'title-abbreviates' WHEN 4 THEN 'title-elaborates' WHEN 5 THEN 'agree' WHEN 6 THEN 'store-empty' ELSE 'disagree' END AS outcome, count(*) AS n
FROM (SELECT p_partkey % 9 AS k, upper(derived) = derived AS same FROM ({_INDEX})) GROUP BY 1""")
def cell_outcomes(t: Tables):
    k, name = F.col("p_partkey") % 9, F.col("p_name")
    authored = F.when(k == 0, name).when(k == 1, F.upper(name)).when(k == 2, "").when(k == 3, F.substring(name, F.lit(1), F.length(name) - 2)).when(k == 4, F.concat(name, F.lit(" more"))).when(k == 5, F.concat(F.lit("S-1.1: "), name)).when(k == 6, name).otherwise("something else")
    outcome = columns.compare_cell("title")(authored, F.when(k == 6, "").otherwise(name))
    return spread(t.part).select(outcome.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("n"))


@query("txt27_pin_policy", "SELECT source, CASE WHEN source LIKE '%1%' THEN 'pinned' ELSE 'floating' END AS pin, count(*) AS n FROM documents GROUP BY 1")
def pin_policy(t: Tables):
    kind = F.when(F.col("source").contains("1"), "adversarial-review").otherwise("story")
    return t.documents.groupBy("source", columns.pin_policy(kind).alias("pin")).agg(F.count("*").alias("n"))


@query("txt34_hashes", "SELECT c_custkey, sha256(c_name) AS h256, sha1(c_name) AS h1 FROM customer")
def hashes(t: Tables):
    return t.customer.select("c_custkey", F.sha2("c_name", 256).alias("h256"), F.sha1("c_name").alias("h1"))


@query("txt31_claims", r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), c AS (SELECT doc_id, CAST(regexp_extract(line, 'version ([0-9]+)', 1) AS BIGINT) AS claimed FROM l WHERE regexp_matches(line, 'version [0-9]+'))
SELECT doc_id, claimed, count(*) AS times FROM c GROUP BY 1, 2""")
def claims(t: Tables):
    lines = t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    found = lines.where(F.col("line").rlike("version [0-9]+")).select("doc_id", F.regexp_extract("line", "version ([0-9]+)", 1).cast("long").alias("claimed"))
    return found.groupBy("doc_id", "claimed").agg(F.count("*").alias("times"))


@query("txt01_frontmatter", "SELECT p_partkey, p_name AS title, p_brand || ',' || p_type AS tags, true AS tags_listed FROM part")
def frontmatter(t: Tables):
    doc = F.concat(F.lit("---\ntitle: \""), F.col("p_name"), F.lit("\"  # note\ntags: ["), F.col("p_brand"), F.lit(",\n  '"), F.col("p_type"), F.lit("']\nnone: null\n---\nbody"))
    own = spread(t.part).select("p_partkey", F.map_from_entries(F.transform(columns.frontmatter(doc), lambda s: F.struct(s["key"], s))).alias("f"))
    return own.select("p_partkey", F.col("f")["title"]["scalar"].alias("title"), F.array_join(F.col("f")["tags"]["items"], ",").alias("tags"), F.col("f")["tags"]["is_list"].alias("tags_listed"))


@query("txt36_norm_kind", "SELECT DISTINCT regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g') AS kind, first_value(1) OVER () AS one FROM part")
def norm_kind(t: Tables):
    return integrity.first_wins(t.part.select(F.regexp_replace(F.lower("p_type"), "[^a-z0-9]+", "-").alias("kind"), F.lit(1).alias("one")), ["kind"], ["one"])
