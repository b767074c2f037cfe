"""The gates as one plan: each is a function of the tables that returns findings; together they are a union.

metrics says how much each gate looked at, so that an empty scope can't pass for a clean one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markdown as md
from ..operators import findings as fd
from ..operators import integrity

Tables = dict[str, DataFrame]
SHAPES = {"bc": rf"^{md.ID}$", "vp": r"^VP-\d+$", "story": r"^S-\d+\.\d+$", "subsystem": r"^SS-\d+$"}
PARENTS = {"vp_bc": ("vp", "bc"), "vp_di": ("vp", "di"), "vp_nfr": ("vp", "nfr"), "vp_subsystem": ("vp", "subsystem"), "story_bc": ("story", "bc"), "story_vp": ("story", "vp"), "story_fr": ("story", "fr"), "story_subsystem": ("story", "subsystem"), "story_dep": ("story", "story")}


def found_at_ingest(t: Tables) -> DataFrame:
    return fd.replay(t["finding"])


def stated_counts(t: Tables) -> DataFrame:
    actual = t["bc"].agg(F.count("*").alias("actual")).select(F.lit("bc_total").alias("kind"), F.lit("").alias("subject"), "actual")
    actual = actual.unionByName(t["bc"].groupBy(F.col("ss_id").alias("subject")).agg(F.count("*").alias("actual")).select(F.lit("bc_count_ss").alias("kind"), "subject", "actual"))
    found = integrity.count_claims(t["claim"].where("kind IN ('bc_total', 'bc_count_ss')"), actual, ["kind", "subject"])
    return found


def index_enumeration(t: Tables) -> DataFrame:
    return integrity.enumeration(t["index_entry"], "id", t["bc"], "id")


def dangling_edges(t: Tables, parents: dict[str, tuple[str, str]] = PARENTS) -> DataFrame:
    parts = []
    for table, (owner, parent) in parents.items():
        parts += [integrity.dangling(t[table], "id", t[owner], "id", f"dangling {table}.id"), integrity.dangling(t[table], "target", t[parent], "id", f"dangling {table}.target")]
    return fd.union(parts)


def malformed_ids(t: Tables) -> DataFrame:
    return fd.union([integrity.malformed(t[k], "id", p, f"malformed {k} id") for k, p in SHAPES.items()])


def duplicate_ids(t: Tables) -> DataFrame:
    return fd.union([integrity.duplicates(t[k], ["id"], f"duplicate {k} ids") for k in SHAPES])


def prefix_agreement(t: Tables) -> DataFrame:
    j = t["bc"].join(t["subsystem"].select(F.col("id").alias("ss_id"), "bc_prefix"), "ss_id")
    prefix = F.substring_index(F.substring("id", 4, 99), ".", 1).try_cast("int")
    return integrity.disagreement(j, prefix, F.col("bc_prefix"), "a contract's prefix is not its subsystem's", F.concat_ws(" -> ", "id", "ss_id"), F.format_string("registered as BC-%d", "bc_prefix"))


def scalar_refs(t: Tables) -> DataFrame:
    checks = [("bc", "capability", "cap"), ("bc", "replacement", "bc"), ("story", "epic_id", "epic"), ("vp", "scope", "subsystem"), ("vp", "source_bc", "bc")]
    return fd.union([integrity.scalar_reference(t[a], "id", c, t[b], "id", f"{a}.{c} -> missing {b}") for a, c, b in checks])


def dependency_direction(t: Tables) -> DataFrame:
    return integrity.one_directional(t["story_dep"], "id", "target", "kind")


def review_counts(t: Tables) -> DataFrame:
    own = t["review_finding"].where("owned")
    actual = own.groupBy(F.col("review").alias("subject")).agg(F.count("*").alias("actual")).select(F.lit("review_finding_count").alias("kind"), "subject", "actual")
    actual = actual.unionByName(own.where("severity <> ''").groupBy(F.concat_ws("|", "review", "severity").alias("subject")).agg(F.count("*").alias("actual")).select(F.lit("review_severity_count").alias("kind"), "subject", "actual"))
    wrong = integrity.count_claims(t["claim"].where("kind LIKE 'review%'"), actual, ["kind", "subject"], "a review's stated count differs from its findings")
    unknown = t["review_finding"].where("coalesce(severity, '') = ''").agg(F.count("*").alias("n")).where("n > 0")
    return wrong.unionByName(fd.findings(unknown, "findings of no known severity", F.format_string("%d row(s)", "n"), "type"))


def undeclared_traces(t: Tables) -> DataFrame:
    refs = t["sub_artifact_ref"].where("kind = 'ac' AND target_kind = 'bc'").select("id", "sub_id", F.col("target_id").alias("target")).distinct().join(t["story"].select("id"), "id", "left_semi")
    return fd.findings(refs.join(t["story_bc"].select("id", "target"), ["id", "target"], "left_anti"), "a criterion traces to a contract that its story doesn't declare", F.concat(F.col("id"), F.lit(" "), F.col("sub_id"), F.lit(" -> "), F.col("target")), "dangling")


def sub_artifact_refs(t: Tables, kinds: tuple[str, ...] = ("bc", "vp", "adr")) -> DataFrame:
    parts = []
    for kind in kinds:
        refs = t["sub_artifact_ref"].where(F.col("target_kind") == kind).select("id", "kind", "sub_id", F.col("target_id").alias("target")).distinct()
        lost = refs.join(t[kind].select(F.col("id").alias("target")), "target", "left_anti")
        parts.append(fd.findings(lost, F.concat(F.lit("a trace of a "), F.col("kind"), F.lit(f" names a missing {kind}")), F.concat(F.col("id"), F.lit(" "), F.col("sub_id"), F.lit(" -> "), F.col("target")), "dangling"))
    return fd.union(parts)


def version_cites(t: Tables) -> DataFrame:
    subject = F.concat(F.col("path"), F.lit(" -> "), F.col("target"), F.lit(" v"), F.col("cited"))
    ahead = fd.findings(t["version_cite"].where("verdict = 'ahead-never-existed'"), "a cite names a version that never was", subject, "integrity")
    return ahead.unionByName(fd.findings(t["version_cite"].where("verdict = 'lagging-floating'"), "a floating cite lags behind", subject, "count"))


def prose_refs(t: Tables) -> DataFrame:
    n = t["prose_ref"].agg(F.count("*").alias("every"), F.count_if(F.col("status") == "unresolvable").alias("u"), F.count_if(F.col("status") == "dangling").alias("d"))
    a = fd.findings(n.where("u > 0"), "section references without a stated owner", F.format_string("%d of %d", "u", "every"), "type")
    return a.unionByName(fd.findings(n.where("d > 0"), "section references to a section that the owner lacks", F.format_string("%d of %d", "d", "every"), "dangling"))


GATES: list[Callable[[Tables], DataFrame]] = [found_at_ingest, stated_counts, index_enumeration, dangling_edges, malformed_ids, duplicate_ids, prefix_agreement, scalar_refs, dependency_direction, review_counts, undeclared_traces, sub_artifact_refs, version_cites, prose_refs]


def cross_zone(t: Tables, walled: DataFrame | None) -> tuple[DataFrame | None, str]:
    """(findings, reason for a skip): ids only are read of the walled (id, target) table; without it the gate is skipped, not passed."""
    if walled is None:
        return None, "the walled zone is not there"
    refs = walled.select("id", "target")
    return fd.findings(refs.join(t["bc"].select(F.col("id").alias("target")), "target", "left_anti"), "a walled scenario names a missing contract", F.concat_ws(" -> ", "id", "target"), "cross-zone"), ""


def skipped(t: Tables, walled: DataFrame | None) -> DataFrame:
    """(rule, subject, class, detail) of gates that could not run: a skip is reported, and is neither a pass nor a finding."""
    _, reason = cross_zone(t, walled)
    rows = [("the cross-zone gate was skipped", reason, "skip", "")] if reason else []
    return next(iter(t.values())).sparkSession.createDataFrame(rows, fd.SCHEMA)


def validate(t: Tables, walled: DataFrame | None = None) -> DataFrame:
    """Findings of every gate; skipped() says which gates had nothing to run on."""
    parts = [gate(t) for gate in GATES]
    crossed, _ = cross_zone(t, walled)
    return fd.union([*parts, *([crossed] if crossed is not None else [])])


ROWS = ("bc", "vp", "story", "subsystem", "review", "sub_artifact", "prose_ref", "version_cite")


def metrics(t: Tables, tables: tuple[str, ...] = ROWS, edges: tuple[str, ...] = tuple(PARENTS), owners: tuple[str, ...] = ("vp", "story")) -> DataFrame:
    """(name, n): rows by table, all edges, contracts without a property or a story."""
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    rows = [count(k, t[k]) for k in tables]
    every = fd.union([count(k, t[k]) for k in edges]).agg(F.sum("n").alias("n")).select(F.lit("edges").alias("name"), "n")
    bare = [count(f"bc_without_{k}", t["bc"].join(t[f"{k}_bc"].select(F.col("target").alias("id")), "id", "left_anti")) for k in owners]
    return fd.union([*rows, every, *bare])
