"""A tree of markdown documents to typed tables, edges, claims and findings.

The tree is read once; frontmatter and body are taken apart in one Arrow-batched pass that is settled, as a dozen
tables come from it. Everything after is joins and built-in expressions. A document that can't be read as what it claims
to be becomes a finding; nothing is skipped without one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns, reviews
from ..functions import markdown as md
from ..operators import findings as fd
from ..operators import integrity
from ..session import importable, settle

BC, SS = md.ID, r"SS-\d+"
KINDS = {"bc": ("specs/behavioral-contracts/", rf"(?i)^({BC})"), "vp": ("specs/verification-properties/", r"(?i)^(VP-\d+)"), "story": ("stories/", r"(?i)^(S-[\d.]+)")}
INDEX, ARCH, PRD = "specs/behavioral-contracts/BC-INDEX.md", "specs/architecture/ARCH-INDEX.md", "specs/prd.md"
NFR_CATALOG = "phase-0-ingestion/pass-4-nfr-catalog.md"
NFR = r"NFR-[A-Z]+-[0-9]+"
UNIVERSES = {"cap": (["specs/domain-spec/capabilities.md"], r"CAP-\d+"), "di": (["specs/domain-spec/invariants.md"], r"DI-\d+"), "fr": ([PRD], r"FR-\d+"), "nfr": ([NFR_CATALOG, PRD], NFR)}
#: edge table -> (owner kind, frontmatter key, id pattern, target table, column of the target)
EDGES = {
    "VP.bcs": ("vp_bc", "vp", "bcs", BC, "bc"), "VP.source_bc": ("vp_bc", "vp", "source_bc", BC, "bc"), "VP.domain_invariants": ("vp_di", "vp", "domain_invariants", r"DI-\d+", "di"), "VP.nfrs": ("vp_nfr", "vp", "nfrs", NFR, "nfr"),
    "story.behavioral_contracts": ("story_bc", "story", "behavioral_contracts", BC, "bc"), "story.verification_properties": ("story_vp", "story", "verification_properties", r"VP-\d+", "vp"), "story.functional_requirements": ("story_fr", "story", "functional_requirements", r"FR-[-A-Z0-9]*\d+", "fr"), "story.subsystems": ("story_subsystem", "story", "subsystems", SS, "subsystem"),
    "story.depends_on": ("story_dep", "story", "depends_on", r"S-[\d.]+", "story"), "story.blocks": ("story_dep", "story", "blocks", r"S-[\d.]+", "story"),
}


@columns.arrow("struct<body:string,fields:array<struct<key:string,is_list:boolean,scalar:string,items:array<string>>>,notes:array<struct<key:string,kind:string,lost:int>>>")
def taken_apart(texts: pd.Series) -> pd.DataFrame:
    out = []
    for s in texts:
        f = md.frontmatter(s)
        out.append((f.body, [{"key": k, "is_list": isinstance(v, list), "scalar": f.one(k), "items": f.many(k)} for k, v in f.values.items()], [dict(zip(("key", "kind", "lost"), n)) for n in f.notes]))
    return pd.DataFrame(out, columns=["body", "fields", "notes"])


def documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, base, text, body, fields, notes) of every markdown file under root but those of .git; a tree without one is an error."""
    importable(spark)
    raw = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    own = raw.select(F.regexp_replace(path, "^.*?" + re.escape(root.strip("/")) + "/", "").alias("path"), F.col("value").alias("text")).where("NOT (path LIKE '.git/%' OR path LIKE '%/.git/%')")
    own = own.select("path", F.substring_index("path", "/", -1).alias("base"), "text", taken_apart(F.col("text")).alias("d"))
    own = settle(own.select("path", "base", "text", "d.body", F.map_from_entries(F.transform("d.fields", lambda s: F.struct(s["key"], s))).alias("fields"), "d.notes"))
    if own.isEmpty():
        raise ValueError(f"{root} holds no markdown")
    return own


def one(key: str) -> Column:
    return F.coalesce(F.col("fields")[key]["scalar"], F.lit(""))


def many(key: str) -> Column:
    return F.coalesce(F.col("fields")[key]["items"], F.array().cast("array<string>"))


def empty_as_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def typed(docs: DataFrame, kind: str) -> DataFrame:
    """Documents of a kind, by folder and file name, with their id."""
    folder, pattern = KINDS[kind]
    key = F.upper(F.rtrim(F.regexp_extract("base", pattern, 1), F.lit(".")))
    return docs.where(F.col("path").startswith(folder) & (F.upper("base") != "BC-INDEX.MD")).withColumn("id", key).where("id <> ''")


def census(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((kind, md_files, matched, skipped, forms), findings): a folder whose files all fail the pattern, ids of several spellings."""
    parts = []
    for kind, (folder, pattern) in KINDS.items():
        name = F.regexp_extract("base", pattern, 1)
        form = F.when(name != "", F.regexp_extract(name, r"^([^\d-]+-?)", 1))
        parts.append(docs.where(F.col("path").startswith(folder)).agg(F.lit(kind).alias("kind"), F.count("*").alias("md_files"), F.count_if(name != "").alias("matched"), F.count_if(name == "").alias("skipped"), F.array_sort(F.collect_set(form)).alias("forms"), F.slice(F.array_sort(F.collect_set(F.when(name == "", F.col("base")))), 1, 10).alias("sample")))
    counts = fd.union(parts).where("md_files > 0")
    none = fd.findings(counts.where("matched = 0"), "a folder of typed documents holds none of its name pattern", F.concat_ws(" ", "kind", F.array_join("sample", ", ")), "integrity")
    spelled = fd.findings(counts.where("size(forms) > 1"), "one id type is spelled in several ways", F.concat_ws(" ", "kind", F.array_join("forms", " ")), "integrity")
    return counts, none.unionByName(spelled)


def lines(docs: DataFrame, column: str = "text") -> DataFrame:
    """(path, n, line)."""
    return docs.select("path", F.posexplode(F.split(F.regexp_replace(column, "\r", ""), "\n")).alias("n", "line"))


def declared(docs: DataFrame, paths: list[str], pattern: str) -> DataFrame:
    """(id, name) that headings, bold text or table rows of the documents at paths declare; the first in order of paths and lines wins."""
    order = F.array_position(F.array(*[F.lit(p) for p in paths]), F.col("path"))
    found = _declarations(docs.where(F.col("path").isin(paths)), pattern).withColumn("source", order)
    return integrity.first_wins(found, ["id"], ["source", "n"]).select("id", "name")


def declared_last(docs: DataFrame, pattern: str) -> DataFrame:
    """(id, name) that any of docs declares: of several documents the last in order of paths, and its first line, wins."""
    return _declarations(docs, pattern).groupBy("id").agg(F.max_by("name", F.struct("path", -F.col("n"))).alias("name"))


def _declarations(docs: DataFrame, pattern: str) -> DataFrame:
    own = lines(docs).withColumn("line", F.trim("line"))
    shapes = [rf"^#+\s+({pattern})[:\s—-]*(.*)$", rf"^\*{{2}}({pattern})\s*[—:-]*\s*(.*?)\*{{2}}", rf"^\|\s*\**({pattern})\**\s*\|(.*)$"]
    pick = lambda g: F.coalesce(*[F.when(F.col("line").rlike(s), F.regexp_extract("line", s, g)) for s in shapes])
    return own.select(pick(1).alias("id"), F.substring(F.trim(F.split_part(pick(2), F.lit("|"), F.lit(1))), 1, 400).alias("name"), "path", "n").where("id IS NOT NULL")


def subsystems(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((id, bc_prefix, name), findings) from the architecture index, then folder names, then what contracts claim."""
    row = r"\|\s*(SS-\d+)\s*\|([^|]+)\|\s*BC-(\d+)\s*\|"
    index = lines(docs.where(F.col("path") == ARCH)).where(F.col("line").rlike(row)).select(F.regexp_extract("line", row, 1).alias("id"), F.regexp_extract("line", row, 3).cast("int").alias("bc_prefix"), F.trim(F.regexp_extract("line", row, 2)).alias("name"), F.lit(1).alias("source"), "n")
    number = F.regexp_extract("path", r"/ss-(\d+)[^/]*/", 1).try_cast("int")
    folder = docs.where(F.col("path").startswith(KINDS["bc"][0])).select(number.alias("bc_prefix")).where("bc_prefix IS NOT NULL").distinct().select(F.format_string("SS-%02d", "bc_prefix").alias("id"), "bc_prefix", F.format_string("SS-%02d", "bc_prefix").alias("name"), F.lit(2).alias("source"), F.lit(0).alias("n"))
    claim = typed(docs, "bc").select(F.trim(F.coalesce(empty_as_null(one("subsystem")), one("ss"))).alias("id")).where(F.col("id").rlike(rf"^{SS}$")).distinct()
    claim = claim.select("id", F.substring("id", 4, 9).cast("int").alias("bc_prefix"), F.col("id").alias("name"), F.lit(3).alias("source"), F.lit(0).alias("n"))
    every = integrity.first_wins(fd.union([index, folder, claim]), ["id"], ["source", "n"])
    late = every.where("source = 3").agg(F.count("*").alias("k")).where("k > 0")
    return every.select("id", "bc_prefix", "name"), fd.findings(late, "subsystems are declared only by contracts", F.format_string("%d recovered from contracts", "k"), "integrity")


def coerced(owners: DataFrame, key: str, pattern: str, label: str) -> tuple[DataFrame, DataFrame]:
    """((id, target), findings) of a list field: no id at all, or an id with prose around it, is a type finding; the id is kept."""
    items = owners.select("id", F.explode(many(key)).alias("v")).withColumn("target", F.regexp_extract("v", f"({pattern})", 1))
    subject = F.concat_ws(" -> ", "id", F.substring("v", 1, 60))
    none = fd.findings(items.where("target = ''"), f"{label} value is not an id", subject, "type")
    prose = fd.findings(items.where("target <> '' AND target <> trim(v)"), f"{label} holds an id plus prose", subject, "type")
    return items.where("target <> ''").select("id", "target"), none.unionByName(prose)


def claims(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((source, kind, subject, claimed), (id)): counts that the index documents state, and the contracts that the index lists."""
    index = docs.where(F.col("path") == INDEX)
    stated = index.select(F.lit("BC-INDEX frontmatter").alias("source"), F.lit("bc_total").alias("kind"), F.lit("").alias("subject"), one("total_bcs").alias("v"), F.lit(-1).alias("n")).where("v <> ''")
    own = lines(index, "body").withColumn("line", F.trim("line"))
    shapes = [("BC-INDEX Total row", "bc_total", r"^\|\s*\**Total\**\s*\|[^|]*\|\s*\**([\d,]+)", None), ("BC-INDEX subsystem row", "bc_count_ss", r"^\|\s*SS-\d+[^|]*\|\s*BC-\d+\s*\|\s*([\d,]+)", r"^\|\s*(SS-\d+)"), ("BC-INDEX section heading", "bc_count_ss", r"^#+\s+SS-\d+\b.*?—\s*([\d,]+)\s+BCs", r"(SS-\d+)")]
    parts = [stated]
    for source, kind, value, subject in shapes:
        parts.append(own.where(F.col("line").rlike(value)).select(F.lit(source).alias("source"), F.lit(kind).alias("kind"), (F.regexp_extract("line", subject, 1) if subject else F.lit("")).alias("subject"), F.regexp_extract("line", value, 1).alias("v"), "n"))
    total = r"\*\*Total BCs:\s*\**([\d,]+)"
    arch = lines(docs.where(F.col("path") == ARCH)).where(F.col("line").rlike(total)).select(F.lit("ARCH-INDEX total").alias("source"), F.lit("bc_total").alias("kind"), F.lit("").alias("subject"), F.regexp_extract("line", total, 1).alias("v"), "n")
    every = integrity.first_wins(fd.union([*parts, arch]), ["source", "kind", "subject"], ["n"])
    listed = own.select(F.regexp_extract("line", rf"^\|\s*\[?({BC})\]?", 1).alias("id")).where("id <> ''").distinct()
    return every.select("source", "kind", "subject", columns.commas(F.col("v")).alias("claimed")), listed


@columns.arrow("struct<rows:array<struct<kind:string,sub_id:string,statement:string,form:string,line:int>>,refs:array<struct<kind:string,sub_id:string,target_kind:string,target_id:string,clause:string>>>")
def _parts(bodies: pd.Series) -> pd.DataFrame:
    found = [reviews.sub_artifacts(b or "") for b in bodies]
    return pd.DataFrame({"rows": [f[0] for f in found], "refs": [f[1] for f in found]})


def prose(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(section references, version cites). Versions and section names of owners are looked up by the keys that documents mention,
    so a document is sent only the names it needs, not the names of the whole corpus."""
    own = docs.where(one("document_type") != "").select("path", one("document_type").alias("kind"), F.upper(F.regexp_replace("base", r"\.md$", "")).alias("name"), one("version").alias("version"), "body")
    versions = own.where(F.col("version").rlike(r"^\d+\.\d+$")).groupBy("name").agg(F.max_by("version", "path").alias("version"))  # the last document of a name in order of paths
    short = F.regexp_extract("name", r"^((?:S|E|TD|CAP|DI|N?FR|VP|BC|ADR)-\d+(?:\.\d+){0,2})(?:$|-)", 1)
    keys = own.select("path", "body", F.explode(F.array_distinct(F.array(short, F.col("name")))).alias("name")).where("name <> ''")
    single = keys.groupBy("name").agg(F.count_distinct("path").alias("owners"), F.min("path").alias("path")).where("owners = 1").select("name", "path")  # a key of two documents names neither
    mentioned = own.select("path", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("body", F.lit(r"([A-Za-z][\w.-]*)"), F.lit(1)), lambda w: F.upper(F.regexp_replace(w, r"\.md$", ""))))).alias("name"))
    asked = mentioned.join(single.withColumnRenamed("path", "owner"), "name").join(own.select(F.col("path").alias("owner"), F.col("body").alias("owner_body")), "owner")
    known = asked.groupBy("path").agg(F.collect_list(F.struct("name", "owner_body")).alias("owners"))
    cited = mentioned.join(versions, "name").groupBy("path").agg(F.collect_list(F.struct("name", "version")).alias("versions"))
    joined = own.join(known, "path", "left").join(cited, "path", "left")

    @columns.arrow("struct<refs:array<struct<raw:string,target:string,section:int,status:string,line:int>>,cites:array<struct<target:string,cited:string,pin:string,verdict:string,line:int>>>")
    def extract(kinds: pd.Series, bodies: pd.Series, owners: pd.Series, versions: pd.Series) -> pd.DataFrame:
        out = []
        for kind, body, near, held in zip(kinds, bodies, owners, versions):
            others = {o["name"]: reviews.item_sections(reviews.section_names(o["owner_body"]), o["owner_body"]) for o in (near if near is not None else ())}
            known_versions = {o["name"]: o["version"] for o in (held if held is not None else ())}
            out.append(reviews.prose_references(kind, body, known_versions, reviews.section_names(body), others))
        return pd.DataFrame(out, columns=["refs", "cites"])

    found = settle(joined.select("path", "kind", extract(F.col("kind"), F.col("body"), F.col("owners"), F.col("versions")).alias("x")))
    return found.select("path", "kind", F.inline("x.refs")), found.select("path", "kind", F.inline("x.cites"))


def _marks() -> Column:
    return F.size(F.regexp_extract_all("body", F.lit(r"(§|\b[A-Z][A-Z\d-]{2,}(?:\.md)?[ \t]+v\d+\.\d+)"), F.lit(1)))


STATUSES = ("resolved", "dangling", "unresolvable")


def _stages(n: DataFrame) -> DataFrame:
    stages = [("marks", F.col("marks")), ("in code", F.col("marks") - F.col("cites") - F.col("refs")), ("version cites", F.col("cites")), ("section references", F.col("refs")), *[(s, F.col(s)) for s in STATUSES]]
    return n.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), c.alias("n")) for s, c in stages])).alias("x")).select("x.*")


def reference_funnel(docs: DataFrame, refs: DataFrame, cites: DataFrame) -> DataFrame:
    """(stage, n): all marks in the texts (body), those in code, and of the others the version cites and the section references by status."""
    n = docs.agg(F.coalesce(F.sum(_marks()), F.lit(0)).cast("long").alias("marks"))
    n = n.crossJoin(cites.agg(F.count("*").alias("cites"))).crossJoin(refs.agg(F.count("*").alias("refs"), *[F.count_if(F.col("status") == s).alias(s) for s in STATUSES]))  # one row each
    return _stages(n)


def text_funnel(texts: DataFrame) -> DataFrame:
    """The same of (body, refs, cites), where each text has its own references and cites: in one pass over the texts."""
    of = lambda s: F.size(F.filter("refs", lambda r: r["status"] == s)).alias(s)
    each = texts.select(_marks().alias("marks"), F.size("refs").alias("refs"), F.size("cites").alias("cites"), *map(of, STATUSES))
    return _stages(each.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in each.columns]))


def ledgers(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((path, field, ord, entry, date), findings of unbalanced brackets)."""
    own = docs.select("path", F.explode(F.map_values("fields")).alias("f")).select("path", F.col("f.key").alias("field"), F.col("f.scalar").alias("v"))
    dated = F.size(F.regexp_extract_all("v", F.lit(r"(\d{4}-\d\d-\d\d\s*\()"), F.lit(1))) > 1
    own = own.where(F.col("v").contains(md.PRIOR) | (F.col("field").isin(*md.LEDGERS) & dated))
    opened, closed = F.size(F.split("v", r"\[Prior:")) - 1, F.length("v") - F.length(F.replace("v", F.lit("]"), F.lit("")))
    odd = fd.findings(own.where(opened != closed), "a ledger's brackets don't match", F.concat_ws(" -> ", "path", "field"), "integrity", F.format_string("%d opened, %d closed", opened, closed))
    return own.select("path", "field", F.inline(columns.ledger_entries(F.col("v")))), odd


def ingest(spark: SparkSession, root: str, review_types: tuple[str, ...] = ("adversarial-review",)) -> dict[str, DataFrame]:
    """All tables by name; "finding" holds what was found on the way."""
    docs = documents(spark, root)
    t: dict[str, DataFrame] = {"document": docs}
    found: list[DataFrame] = []
    for kind, (paths, pattern) in UNIVERSES.items():
        t[kind] = declared(docs, paths, pattern)
    t["adr"] = declared_last(docs.where(F.col("path").rlike(r"^specs/architecture/[^/]+\.md$")), r"ADR-\d+")
    t["epic"] = docs.where(F.col("path").startswith("stories/epics/")).select(F.regexp_extract("base", r"^(E-\d+)", 1).alias("id"), F.replace(F.regexp_extract("base", r"^E-\d+-?(.*)\.md$", 1), F.lit("-"), F.lit(" ")).alias("name")).where("id <> ''").dropDuplicates(["id"])
    t["subsystem"], late = subsystems(docs)
    t["census"], odd = census(docs)
    found += [late, odd]
    title = F.substring(F.coalesce(empty_as_null(columns.first_line(F.col("body"))), F.col("id")), 1, 1000)

    collided = {k: integrity.collisions(typed(docs, k), ["id"], ["path"]) for k in KINDS}
    t["key_collision"] = fd.union([c.where("place > 1").select(F.lit(k).alias("kind"), "id", F.col("path").alias("lost_path")) for k, c in collided.items()])
    found.append(fd.findings(t["key_collision"], "two documents claim one id", F.concat_ws(" -> ", "id", "lost_path"), "integrity"))
    first = {k: c.where("place = 1").drop("place") for k, c in collided.items()}

    ss = F.trim(F.coalesce(empty_as_null(one("subsystem")), one("ss")))
    ss = F.when(ss.rlike(rf"^{SS}$"), ss).otherwise(F.concat(F.lit("SS-"), F.regexp_extract("path", r"/ss-(?:[^/]*-)?([^/-]+)/[^/]+$", 1)))
    bc = first["bc"].withColumn("ss_id", ss)
    known = t["subsystem"].select(F.col("id").alias("ss_id"))
    found.append(fd.findings(bc.join(known, "ss_id", "left_anti"), "a contract names an unknown subsystem", F.concat_ws(" -> ", "id", "ss_id"), "dangling"))
    replacement = one("replacement")
    found.append(fd.findings(bc.where((replacement != "") & ~replacement.rlike(f"^{BC}$")), "a contract's replacement is prose", F.concat_ws(" -> ", "id", F.substring(replacement, 1, 60)), "type"))
    t["bc"] = bc.join(known, "ss_id", "left_semi").select("id", "ss_id", title.alias("title"), F.when(one("capability").rlike(r"^CAP-\d+$"), one("capability")).alias("capability"), F.coalesce(empty_as_null(one("version")), F.lit("v1.0")).alias("version"), empty_as_null(one("lifecycle_status")).alias("lifecycle_status"), empty_as_null(one("status")).alias("status"), F.when(replacement.rlike(f"^{BC}$"), replacement).alias("replacement"), "path")

    scopes = F.filter(F.split(F.array_join(many("scope"), " "), r"[,\s]+"), lambda x: x.rlike(rf"^{SS}$"))
    vp = first["vp"].withColumn("scopes", scopes)
    found.append(fd.findings(vp.where("size(scopes) > 1"), "VP.scope holds several values", F.concat_ws(" -> ", "id", F.array_join("scopes", ",")), "type"))
    t["vp"] = vp.select("id", title.alias("title"), F.when(F.size("scopes") == 1, F.get("scopes", F.lit(0))).alias("scope"), empty_as_null(one("source_bc")).alias("source_bc"), empty_as_null(one("proof_method")).alias("proof_method"), empty_as_null(one("type")).alias("vp_type"), F.coalesce(empty_as_null(one("version")), F.lit("v1.0")).alias("version"), "path")
    t["story"] = first["story"].select("id", title.alias("title"), F.coalesce(empty_as_null(one("status")), F.lit("pending")).alias("status"), one("wave").try_cast("int").alias("wave"), empty_as_null(one("epic_id")).alias("epic_id"), empty_as_null(one("points")).alias("points"), empty_as_null(one("priority")).alias("priority"), "path")

    stories = typed(docs, "story").withColumn("id", F.upper(F.coalesce(empty_as_null(one("story_id")), F.col("id"))))
    found.append(fd.findings(stories.join(t["story"], "id", "left_anti"), "a story's id in its text is that of no file", F.concat_ws(" -> ", "id", "path"), "integrity"))
    stories = stories.join(t["story"].select("id"), "id", "left_semi")
    raw: dict[str, list[DataFrame]] = {"vp_subsystem": [vp.select("id", F.explode("scopes").alias("target"), F.lit("VP.scope").alias("label"), F.lit("").alias("kind"), F.lit("subsystem").alias("parent"))]}
    for label, (table, owner, key, pattern, parent) in EDGES.items():
        edges, odd = coerced(first["vp"] if owner == "vp" else stories, key, pattern, label)
        found.append(odd)
        raw.setdefault(table, []).append(edges.select("id", "target", F.lit(label).alias("label"), F.lit(key if table == "story_dep" else "").alias("kind"), F.lit(parent).alias("parent")))
    for table, parts in raw.items():
        every = settle(fd.union(parts))
        parent = {"vp_subsystem": "subsystem"}.get(table) or next(p for x, _, _, _, p in EDGES.values() if x == table)
        held = t[parent].select(F.col("id").alias("target"))
        t[table] = every.join(held, "target", "left_semi").select("id", "target", "kind").distinct()
        lost = every.join(held, "target", "left_anti")
        found.append(fd.findings(lost, F.concat(F.col("label"), F.lit(f" -> missing {parent}")), F.concat_ws(" -> ", "id", "target"), "dangling"))

    t["claim"], t["index_entry"] = claims(docs)
    review = docs.where(F.col("path").startswith("cycles/") & one("document_type").isin(*review_types))
    t["review"] = review.select(F.col("path").alias("review"), F.coalesce(empty_as_null(one("cycle")), F.split_part("path", F.lit("/"), F.lit(2))).alias("cycle"), one("pass").try_cast("int").alias("pass"), one("target").alias("target"))
    t["review_finding"] = settle(review.select(F.col("path").alias("review"), F.inline(columns.review_findings(F.col("body")))))
    found.append(fd.findings(t["review_finding"].where((F.col("category") != "") & ~F.lower(F.trim("category")).isin(*reviews.CATEGORIES)), "a finding's category is prose", F.concat_ws(" -> ", "review", "finding_id"), "type"))
    stated = review.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), one(k).try_cast("long").alias("claimed")) for k in ("finding_count", "findings_total", "total_findings", "observations")])).alias("s")).select(F.concat_ws(" ", "path", "s.field").alias("source"), F.lit("review_finding_count").alias("kind"), F.col("path").alias("subject"), "s.claimed").where("claimed IS NOT NULL")
    spread = review.select("path", F.explode(F.array(*[F.struct(F.lit(k).alias("field"), one(k).alias("v")) for k in ("findings", "severity_distribution")])).alias("s")).select("path", "s.field", F.explode(F.regexp_extract_all("s.v", F.lit(r"(\d+\s*[A-Za-z]+)"), F.lit(1))).alias("v"))
    spread = spread.select("path", "field", F.regexp_extract("v", r"(\d+)", 1).cast("long").alias("n"), F.regexp_extract("v", "([A-Za-z]+)", 1).alias("word")).withColumn("severity", columns.level(F.col("word")))
    found.append(fd.findings(spread.where("severity = ''"), "a severity distribution holds an unknown word", F.concat_ws(" ", "path", "field", "word"), "type"))
    by_level = spread.where("severity <> ''").groupBy("path", "field", "severity").agg(F.sum("n").alias("claimed"))
    t["claim"] = fd.union([t["claim"], stated, by_level.select(F.concat_ws(" ", "path", "field").alias("source"), F.lit("review_severity_count").alias("kind"), F.concat_ws("|", "path", "severity").alias("subject"), "claimed")])

    owners = stories.select("id", "body", F.lit("story").alias("owner_type")).unionByName(first["bc"].select("id", "body", F.lit("bc").alias("owner_type")))
    parts = settle(owners.select("id", "owner_type", _parts(F.col("body")).alias("p")))
    t["sub_artifact"], t["sub_artifact_ref"] = parts.select("id", "owner_type", F.inline("p.rows")), parts.select("id", "owner_type", F.inline("p.refs"))
    t["prose_ref"], t["version_cite"] = prose(docs)
    t["ledger_entry"], odd = ledgers(docs)
    found.append(odd)
    found.append(fd.findings(docs.select("path", F.explode("notes").alias("note")), "a comment was taken off an unquoted value", F.concat_ws(" -> ", "path", "note.key"), "type", F.format_string("%s, %d characters", "note.kind", "note.lost")))
    t["finding"] = settle(fd.occurrences(fd.union(found)))
    return t
