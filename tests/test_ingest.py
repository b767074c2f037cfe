"""The planted faults of the tree, end to end."""

from __future__ import annotations

import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import tree

from tracegraph.operators import findings as fd
from tracegraph.plans import ingest, registry, validate


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    return ingest.ingest(spark, tree.write(tmp_path_factory.mktemp("tree")))


@pytest.fixture(scope="module")
def found(tables):
    return validate.validate(tables).toPandas()


def test_rows(tables):
    assert {k: tables[k].count() for k in ("subsystem", "bc", "vp", "story", "cap", "di", "fr", "nfr", "adr", "epic")} == {"nfr": 2, "bc": 3, "story": 3, "subsystem": 2} | dict.fromkeys(["vp", "cap", "di", "fr", "adr", "epic"], 1)


def test_type_findings(tables):
    rules = Counter(r["rule"] for r in tables["finding"].where("class = 'type'").collect())
    for rule in ("VP.scope holds several values", "VP.bcs holds an id plus prose", "story.subsystems holds an id plus prose", "a contract's replacement is prose"):
        assert rules[rule] == 1, rules


def test_claims_and_index(tables):
    claims = {(r["source"], r["subject"]): r["claimed"] for r in tables["claim"].where("kind LIKE 'bc%'").collect()}
    assert claims == {("BC-INDEX frontmatter", ""): 5, ("BC-INDEX Total row", ""): 4, ("BC-INDEX subsystem row", "SS-02"): 3, ("ARCH-INDEX total", ""): 3}
    assert tables["index_entry"].count() == 4


def test_edges(tables):
    assert [(r["id"], r["target"]) for r in tables["vp_bc"].collect()] == [("VP-001", "BC-1.01.001")]
    assert tables["vp_subsystem"].count() == 2
    assert tables["story_bc"].where("id = 'S-0.9'").isEmpty() and not tables["story"].where("id = 'S-0.9'").isEmpty()


def test_gates(found):
    n = Counter(found["rule"])
    stated = found[(found["rule"] == "a stated count differs from the records")]
    assert len(stated) == 3 and n["index names a missing record"] == 1 and n["record absent from index"] == 0
    assert n["a contract's prefix is not its subsystem's"] == 1
    assert n["bc.capability -> missing cap"] == 1
    assert n["VP.bcs -> missing bc"] == 1 and n["story.blocks -> missing story"] == 1
    assert n["dependency recorded on one side only"] == 0  # depends_on and blocks answer each other
    assert n["a criterion traces to a contract that its story doesn't declare"] == 1
    assert n["a floating cite lags behind"] == 1 and n["a cite names a version that never was"] == 0  # the code span doesn't count


def test_reviews(tables, found):
    rows = {r["finding_id"]: r for r in tables["review_finding"].collect()}
    assert set(rows) == {"F-001", "HIGH-002", "F-003"}
    assert not rows["F-001"]["owned"] and rows["HIGH-002"]["owned"] and rows["HIGH-002"]["severity"] == "HIGH" and rows["F-003"]["severity"] == "MED"
    off = found[found["rule"] == "a review's stated count differs from its findings"]
    assert sorted(off["detail"]) == ["states 3, actual 2"]
    assert "a severity distribution holds an unknown word" in set(found["rule"])


def test_ledger(tables):
    assert [(r["ord"], r["date"]) for r in tables["ledger_entry"].orderBy("ord").collect()] == [(0, "2024-03-01"), (1, "2024-01-02")]


def test_metrics(tables):
    m = {r["name"]: r["n"] for r in validate.metrics(tables).collect()}
    assert (m["bc"], m["vp"], m["story"], m["bc_without_vp"], m["bc_without_story"]) == (3, 1, 3, 2, 2)


def test_cross_zone_is_skipped_aloud(spark, tables):
    assert validate.cross_zone(tables, None)[1]
    walled = spark.createDataFrame([("HS-1", "BC-1.01.001", "secret"), ("HS-2", "BC-5.05.005", "secret")], "id string, target string, body string")
    crossed, reason = validate.cross_zone(tables, walled)
    rows = crossed.collect()
    assert not reason and [r["subject"] for r in rows] == ["HS-2 -> BC-5.05.005"] and "secret" not in str(rows)


def test_ratchet(spark, found):
    now = spark.createDataFrame(found)
    assert fd.verdict(fd.compare(now, now))[0] == 0
    more = now.union(spark.createDataFrame([("new rule", "x", "type", "")], fd.SCHEMA))
    code, counts = fd.verdict(fd.compare(more, now))
    assert code == 1 and counts["new"] == 1
    code, counts = fd.verdict(fd.compare(now, more))
    assert code == 0 and counts["fixed"] == 1


def test_empty_and_missing(spark, tmp_path):
    with pytest.raises(Exception):
        ingest.ingest(spark, str(tmp_path))
    with pytest.raises(Exception):
        ingest.ingest(spark, str(tmp_path / "nowhere"))


def test_decisions_of_many_files(spark):
    """No file of many is left out; of several that declare one decision the last in order of paths wins."""
    rows = [(f"specs/architecture/a{k:05d}.md", f"# A\n\n### ADR-{k}: decision {k}\n### ADR-7: seventh of {k}\n### ADR-7: again\n") for k in range(2500)]
    docs = spark.createDataFrame(rows, "path string, text string")
    found = {r["id"]: r["name"] for r in ingest.declared_last(docs, r"ADR-\d+").collect()}
    assert len(found) == 2500 and found["ADR-2499"] == "decision 2499" and found["ADR-7"] == "seventh of 2499"


def test_version_of_a_name_is_that_of_the_last_document(spark):
    fields = lambda kind, version: {k: {"key": k, "is_list": False, "scalar": v, "items": [v]} for k, v in (("document_type", kind), ("version", version))}
    rows = [("a/BC-INDEX.md", "BC-INDEX.md", "", fields("index", "1.9")), ("b/BC-INDEX.md", "BC-INDEX.md", "", fields("index", "1.10")), ("c/S-1.01.md", "S-1.01.md", "See BC-INDEX v1.10 and BC-INDEX v1.11.", fields("story", ""))]
    docs = spark.createDataFrame(rows, "path string, base string, body string, fields map<string,struct<key:string,is_list:boolean,scalar:string,items:array<string>>>")
    cites = {r["cited"]: r["verdict"] for r in ingest.prose(docs)[1].collect()}
    assert cites == {"1.10": "current", "1.11": "ahead-never-existed"}


def test_unknown_types_of_any_number_are_found(spark):
    docs = spark.range(120_000).selectExpr("concat('p', id) AS path", "'' AS body", "map('document_type', named_struct('key', 'document_type', 'is_list', false, 'scalar', concat('t', id), 'items', array(''))) AS fields")
    known = registry.Registry({"t5": registry.Kind()}, {"t6": "t5"}, unresolved=frozenset({"t7"}))
    n = {r["rule"]: r["count"] for r in registry.gate(docs, known).groupBy("rule").count().collect()}
    assert n["type.unknown"] == 119_998


def test_registry_from_files(tmp_path):
    (tmp_path / "types.yaml").write_text("types:\n  review:\n    required: [scope]\n    enums: {verdict: verdicts}\nrequired: [title]\n")
    (tmp_path / "more.json").write_text('{"aliases": {"old-review": {"canonical": "review", "set": {"scope": "story"}}, "rev": "review"}, "enums": {"verdicts": {"values": ["ok"]}}, "unresolved": ["odd"]}')
    r = registry.load(str(tmp_path))
    assert r.resolve("old-review") == ("review", "alias") and r.implied("old-review") == {"scope": "story"} and r.implied("rev") == {}
    assert r.required_for("review") == ["scope", "title"] and r.check_enum("verdicts", "no") == "illegal" and r.resolve("odd")[1] == "unresolved"
    (tmp_path / "odd.yaml").write_text("typos: {}\n")
    with pytest.raises(ValueError, match="typos"):
        registry.load(str(tmp_path))


def test_skip_is_reported_not_passed(spark, tables):
    assert [tuple(r) for r in validate.skipped(tables, None).collect()] == [("the cross-zone gate was skipped", "the walled zone is not there", "skip", "")]
    assert validate.skipped(tables, spark.createDataFrame([], "id string, target string")).collect() == []


def test_strict_and_broken(spark, found):
    now = spark.createDataFrame(found)
    same = fd.compare(now, now)
    assert fd.verdict(same, strict=True)[0] == fd.FAILED and fd.verdict(same)[0] == fd.PASSED
    assert fd.judged(lambda: spark.table("nowhere_at_all"))[0] == fd.BROKEN and fd.judged(lambda: same)[0] == fd.PASSED
    lines = [r["line"] for r in fd.report(now, now.withColumn("waiver", F.lit(None).cast("string"))).orderBy("ord").collect()]
    assert lines[-1].startswith("PASS") and lines[0].startswith("new 0")
    assert [r["line"] for r in fd.report(now, None).orderBy("ord").collect()][-1].startswith("FAIL")
