"""Generic operators, the snapshot store, registry and shadow checks, and the contract."""

from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
import tree

from tracegraph.functions import columns
from tracegraph.operators import findings as fd
from tracegraph.operators import integrity, quarantine, versions
from tracegraph.plans import ingest, registry, shadow
from tracegraph.sources import files, snapshots
from tracegraph.streaming import incremental


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_quarantine(spark):
    present = spark.createDataFrame([(r,) for r in "abcde"], "ref string")
    state = spark.createDataFrame([("b", 3, 9, "timeout"), ("c", 2, 9, "timeout"), ("d", 1, 9, "merge conflict"), ("e", 1, 5, "timeout"), ("zz", 1, 1, "timeout")], files.STATE)
    assert [(r[0], r[1]) for r in rows(quarantine.plan(present, state, 10))] == [("a", "merge"), ("b", "quarantine"), ("c", "skip"), ("d", "quarantine"), ("e", "merge")]
    waits = spark.range(12).select(quarantine.backoff(F.col("id").cast("int")).alias("w")).collect()
    assert [r["w"] for r in waits] == [0, 1, 2, 4, 8, 16, 32, 64, 64, 64, 64, 64]
    after = {r["ref"]: (r["attempts"], r["last_run"]) for r in quarantine.record_failure(state, spark.createDataFrame([("b", "x"), ("n", "y")], "ref string, error string"), 11).collect()}
    assert after["b"] == (4, 11) and after["n"] == (1, 11) and after["c"] == (2, 9)


def test_waivers_survive(spark):
    found = spark.createDataFrame([("r", "a", "c", ""), ("r", "b", "c", "")], fd.SCHEMA)
    old = spark.createDataFrame([("r", "a", "c", "", "agreed"), ("r", "gone", "c", "", "old")], files.BASELINE)
    assert {(r["subject"], r["waiver"]) for r in fd.rebase(found, old).collect()} == {("a", "agreed"), ("b", None)}
    assert {r["status"] for r in fd.compare(found, None).collect()} == {"new"}


def test_empty_index_accuses_nobody(spark):
    records = spark.createDataFrame([("x",)], "id string")
    assert integrity.enumeration(records.limit(0), "id", records, "id").count() == 0


def test_merge(spark):
    s = "k int, a string, b string"
    base = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", "b"), (4, "a", "b"), (5, "a", "b")], s)
    ours = spark.createDataFrame([(1, "X", "b"), (2, "X", "b"), (3, "X", "b"), (5, "X", "b"), (6, "n", "n")], s)
    theirs = spark.createDataFrame([(1, "a", "Y"), (2, "Z", "b"), (3, "X", "b"), (4, "a", "b")], s)
    assert rows(versions.merge3(base, ours, theirs, ["k"])) == [(1, "X", "Y", "merged", ""), (2, "X", "b", "conflict", "a"), (3, "X", "b", "merged", ""), (5, "X", "b", "conflict", "*"), (6, "n", "n", "merged", "")]


def test_store(spark, tmp_path):
    store = snapshots.Store(spark, str(tmp_path / "store"))
    with pytest.raises(snapshots.UnknownRef):
        store.as_of("main", "t")
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    two = spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "k int, v string")
    assert store.publish({"t": one}, "first") == (1, True) and store.publish({"t": one.orderBy(F.desc("k"))}, "same") == (1, False)
    assert store.publish({"t": two}, "second") == (2, True) and store.publish({"t": two}, "branch", "wave") == (3, True)
    assert store.as_of(1, "t").count() == 2 and store.as_of("main", "t").count() == 3 and store.resolve("wave")["parent"] == 2
    assert rows(versions.diff(store.as_of(1, "t"), store.as_of(2, "t"), ["k"])) == [(2, "modified", "v"), (3, "added", "")]
    assert store.history("t").where("k = 2").count() == 3 and [r["message"] for r in store.log().orderBy("commit").collect()] == ["first", "second", "branch"]
    assert all(ok for _, ok, _ in store.doctor({"t": "k int, v string"}, "me")) and not all(ok for _, ok, _ in snapshots.Store(spark, str(tmp_path / "none")).doctor())
    assert snapshots.columns_of(one, two.withColumn("k", F.col("k").cast("long")).withColumn("w", F.lit(1))) == [("k", "retyped", "int", "bigint"), ("w", "added", "", "int")]


def test_two_writers_of_one_number(spark, tmp_path, monkeypatch):
    store, other = (snapshots.Store(spark, str(tmp_path / "store")) for _ in range(2))
    mine, theirs = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(2,)], "k int")
    old = other.commits()
    assert store.publish({"t": mine}, "winner") == (1, True)
    monkeypatch.setattr(other, "commits", lambda: old)  # as it saw the log before
    with pytest.raises(snapshots.LostRace):
        other.publish({"t": theirs}, "loser")
    assert rows(store.as_of("main", "t")) == [(1,)] and [c["message"] for c in store.commits()] == ["winner"]
    store._fs(str(tmp_path / "store/commits/.000000000002.claim"))[0].create(store._fs(str(tmp_path / "store/commits/.000000000002.claim"))[1]).close()
    assert store.claims() == [2] and not dict((c, ok) for c, ok, _ in store.doctor())["half-published"]
    with pytest.raises(snapshots.LostRace):
        store.publish({"t": theirs}, "blocked")
    assert store.release(2) and not store.release(1) and store.publish({"t": theirs}, "second") == (2, True)
    assert store.publish({"t": theirs.withColumn("w", F.lit(1))}, "wave", "wave") == (3, True)
    assert store.graduate("wave") == 4 and store.as_of("main", "t").columns == ["k", "w"]
    assert rows(store.branches()) == [("main", 4, 3), ("wave", 3, 1)] and rows(store.migrations()) == [(4, "t", "w", "added", "", "int")]


def test_files(spark, tmp_path):
    good, odd = tmp_path / "good.json", tmp_path / "odd.json"
    good.write_text('{"rule":"r","subject":"s","class":"c"}\n')
    odd.write_text('{"rule":"r","subject":"s","class":"c","waver":"x"}\n')
    assert files.baseline(spark, str(good)).count() == 1
    whole, state = tmp_path / "whole.json", tmp_path / "state.json"
    whole.write_text('{"note": "n", "generated": "2024-01-01",\n "findings": [{"rule":"r","subject":"s","class":"c","waiver":"w"},\n {"rule":"q","subject":"s","class":"c"}]}')
    assert rows(files.baseline(spark, str(whole))) == [("q", "s", "c", None, None), ("r", "s", "c", None, "w")]
    whole.write_text('{"findings": [{"rule":"r","subject":"s","class":"c","waver":"w"}], "notes": 1}')
    with pytest.raises(ValueError, match="notes.*waver"):
        files.baseline(spark, str(whole))
    state.write_text('[\n {"ref": "a",\n "attempts": 2, "last_run": 3, "last_error": "x"},\n {"ref": "b", "attempts": 1, "last_run": 1, "last_error": "y"}\n]')
    assert rows(files.retry_state(spark, str(state))) == [("a", 2, 3, "x"), ("b", 1, 1, "y")]
    with pytest.raises(ValueError, match="waver"):
        files.baseline(spark, str(odd))
    want = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, body string")
    have = spark.createDataFrame([("b", "3"), ("c", "4")], "path string, body string")
    assert rows(files.render_check(want, have)) == [("a", "missing"), ("b", "edited"), ("c", "extra")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return ingest.documents(spark, tree.write(tmp_path_factory.mktemp("tree")))


def test_registry(spark, docs):
    r = registry.Registry(
        types={"contract": registry.Kind(required=("capability", "owner"), sections=("Preconditions", "Invariants"), enums={"lifecycle_status": "life"}, retired_fields=("last_amended",)), "bc-index": registry.Kind(retired=True)},
        aliases={"old-index": "bc-index", "lost": "nothing"}, enums={"life": registry.Enum(frozenset({"draft"}), {"active": "live"})}, required=("version",),
    )
    assert r.resolve("old-index") == ("bc-index", "alias") and r.resolve("lost")[1] == "alias-target-missing" and r.resolve("?")[1] == "unknown"
    assert [r.check_enum("life", v) for v in ("draft", "active", "x")] == ["ok", "migratable", "illegal"] and r.check_enum("none", "x") == "unchecked" and r.pin("any") == "as_of"
    found = {x["rule"] for x in registry.gate(docs, r).collect()}
    assert found == {"type.unknown", "type.retired", "field.missing:owner", "field.retired:last_amended", "enum.migratable:lifecycle_status", "section.missing:Invariants"}
    assert [x["rule"] for x in registry.gate(docs.limit(0), r).collect()] == ["registry.corpus-empty"]


def test_shadow(spark, docs):
    records = spark.createDataFrame([("BC-1.01.001", "Weigh a parcel", "p"), ("BC-1.01.002", "Label", "p"), ("BC-3.01.001", "Extra", "p"), ("BC-8.01.001", "Old", "old/x")], "id string, title string, path string")
    spec = shadow.Spec(ingest.INDEX, "BC", ("BC", "Title"), (shadow.Column("Title", "title", "title"), shadow.Column("Notes", "underivable")), exclude=("old/",))
    found, outcomes = shadow.check(docs, records, spec)
    by = {(r["rule"], r["subject"].split(" -> ")[-1]) for r in found.collect()}
    assert ("shadow.row-without-record", "BC-9.09.009") in by and ("shadow.record-absent-from-index", "BC-3.01.001") in by and ("shadow.cell.title-abbreviates:Title", "BC-1.01.001 Title") in by
    assert not any(s == "BC-8.01.001" for _, s in by) and {(r["outcome"], r["n"]) for r in outcomes.collect()} == {("agree", 1), ("title-abbreviates", 1)}
    for bad, rule in ((shadow.Spec("no.md", "BC", ("BC",), ()), "shadow.document-absent"), (shadow.Spec(ingest.INDEX, "BC", ("Nope",), ()), "shadow.table-absent"), (shadow.Spec(ingest.INDEX, "BC", ("BC",), (), stage="proven"), "shadow.stage-not-shadow")):
        assert [r["rule"] for r in shadow.check(docs, records, bad)[0].collect()] == [rule]


def test_stream(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("BC-1", "2024-01-01 00:00:00"), ("bad", "2024-01-01 00:00:01"), ("bad", "2024-01-01 00:00:02")], "id string, at string").withColumn("at", F.to_timestamp("at")).write.parquet(str(src))
    gate = lambda df: df.where("NOT id RLIKE '^BC'").select(F.lit("malformed").alias("rule"), F.col("id").alias("subject"), F.lit("integrity").alias("class"), F.lit("").alias("detail"), "at")
    stream = spark.readStream.schema("id string, at timestamp").parquet(str(src))
    incremental.stream_findings(stream, gate, "at", "1 hour", out, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r["rule"], r["subject"]) for r in spark.read.parquet(out).collect()] == [("malformed", "bad")]


def test_columns_agree_with_functions(spark):
    from tracegraph.functions import markdown as md
    from tracegraph.functions import reviews as rv
    from tracegraph.session import importable

    importable(spark)
    texts = ["**26** x", "1,959", "", "[a](b), TBD; c", "a|b|c", "PC2", "medium"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    c = F.col("t")
    got = df.select("t", columns.normal_cell(c).alias("n"), columns.leading_int(c).alias("i"), columns.split_list(c).alias("l"), columns.cut_last(c, "|").alias("c"), columns.sub_kind(c).alias("k"), columns.level(c).alias("s"), columns.mask_code(c).alias("m")).collect()
    for r in got:
        t = r["t"]
        assert (r["n"], r["i"], r["l"], tuple(r["c"]), tuple(r["k"]), r["s"], r["m"]) == (md.normal_cell(t), md.leading_int(t), md.split_list(t), md.cut_last(t, "|")[:2], rv.sub_kind(t), rv.level(t), md.mask_code(t))


def test_contract():
    import __spark_entry__ as entry

    from tracegraph import workloads

    assert set(workloads.ORACLE) <= set(workloads.QUERIES) and set(workloads.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_tasks_grow_with_the_tables_that_are_read(spark, tmp_path, monkeypatch):
    from tracegraph import session
    from tracegraph.graph import project
    from tracegraph.operators import integrity

    spark.range(20_000).selectExpr("id AS k", "id % 7 AS part", "uuid() AS x").write.parquet(str(tmp_path / "rows.parquet"))
    rows = spark.read.parquet(str(tmp_path / "rows.parquet"))
    monkeypatch.setattr(session, "SHARE", 20_000)
    pairs = rows.selectExpr("'t' AS src_type", "x AS src_key", "'t' AS dst_type", "string(k) AS dst_key")
    for found in (integrity.collisions(rows, ["k"], ["part"]), project.difference(rows, rows.where("part > 2"), ["k", "part"]), project.undirected(pairs)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "REPARTITION_BY_NUM" in plan and plan.count("Exchange") == 1  # one shuffle, nothing hashed or sorted before it
        assert found.rdd.getNumPartitions() > 20
    assert integrity.first_wins(rows, ["part"], ["k"]).count() == 7


def test_difference_and_undirected_with_nulls_and_repeats(spark, same_rows):
    import pandas as pd

    from tracegraph.graph import project

    a = [(1, "x"), (1, "x"), (2, None), (None, "y"), (3, "z")]
    b = [(1, "x"), (2, None), (4, None), (4, None), (None, None)]
    one, two = (spark.createDataFrame(x, "i int, s string") for x in (a, b))
    sql = "SELECT *, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"
    assert same_rows(project.difference(one, two, ["i", "s"]), sql, {k: pd.DataFrame(x, columns=["i", "s"]) for k, x in {"a": a, "b": b}.items()}) == 4
    pairs = [("t", "1", "u", "2"), ("u", "2", "t", "1"), ("t", "1", "u", "2"), ("t", "2", "t", "1"), ("t", "3", "t", "3")]
    columns = ["src_type", "src_key", "dst_type", "dst_key"]
    sql = "SELECT src_type, src_key, dst_type, dst_key FROM p UNION SELECT dst_type, dst_key, src_type, src_key FROM p"
    assert same_rows(project.undirected(spark.createDataFrame(pairs, columns)), sql, {"p": pd.DataFrame(pairs, columns=columns)}) == 5
