"""One query of each family against its SQL on the smallest tables; bench and driver run them all."""

from __future__ import annotations

import os

import duckdb
import pytest
from compare import rows_of

from tracegraph import workloads

DATA = "/root/testdata/sf0.001"
FAMILIES = ["joi01_dangling_edges", "joi02_index_enumeration", "joi04_one_directional", "joi09_full_chain", "joi14_count_claims", "joi16_baseline_diff", "agg03_dup", "agg10_pivot_eav", "agg18_percentiles", "agg22_auc", "win01_fill", "win07_streak", "src10_asof", "src13_diff", "src21_ranked_search", "wrt06_merge3", "qua03_plan", "gra07_degree", "gra09_scc", "rec01_reach", "rec04_closure", "txt08_tables", "txt16_findings", "txt32_cell_outcomes", "cri07_converged", "snk02_fk_split", "gate_scalar_refs", "gate_review_counts", "gra10_articulation", "gra13_pagerank", "snk08_centralities", "snk13_report", "bas03_verdict", "txt25_section_owners", "txt37_funnel"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", FAMILIES)
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    found, expected = workloads.QUERIES[name](spark, DATA).toPandas(), con.execute(workloads.ORACLE[name]).df()
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows_of(found) == rows_of(expected)


def spread_once(spark, query, tmp_path, table, columns):
    """Partitions in which a query's Python runs over a table of one file, and how often its plan has that Python."""
    spark.createDataFrame(*columns).coalesce(1).write.parquet(str(tmp_path / f"{table}.parquet"))
    found = workloads.QUERIES[query](spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython"), "RoundRobinPartitioning" in plan


@pytest.mark.parametrize("name", ["txt22_version_cites", "txt25_section_owners", "txt37_funnel", "txt23_sections"])
def test_texts_of_one_file_are_spread_and_read_once(spark, tmp_path, name):
    import datetime

    orders = [(k, "F" if k % 2 else "O", datetime.datetime(1995, 1 + k % 12, 1 + k % 28)) for k in range(30)], "o_orderkey long, o_orderstatus string, o_orderdate timestamp"
    part = [(k, k % 51) for k in range(30)], "p_partkey long, p_size int"
    assert spread_once(spark, name, tmp_path, *(("part", part) if name == "txt23_sections" else ("orders", orders))) == (1, True)
    con = duckdb.connect()
    for t in os.listdir(tmp_path):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{tmp_path}/{t}/*.parquet')")
    assert rows_of(workloads.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(con.execute(workloads.ORACLE[name]).df())


def test_chain_counts_each_once_without_expanding_lines(spark, tmp_path):
    """Order and customer numbers that occur twice, parts of no kind; no row is made for each count of each line."""
    tables = {
        "region": ([(1, "R")], "r_regionkey int, r_name string"), "nation": ([(1, "N", 1), (2, "M", 1)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(1, 1), (2, 1), (2, 2), (3, 1)], "c_custkey long, c_nationkey int"), "orders": ([(10, 1), (10, 2), (11, 2), (12, 9)], "o_orderkey long, o_custkey long"),
        "part": ([(1, "a", "B#1"), (2, "b", None), (3, None, "B#2")], "p_partkey long, p_type string, p_brand string"), "supplier": ([(1,), (1,), (2,)], "s_suppkey long"),
        "lineitem": ([(10, 1, 1, 2.5), (10, 2, 2, 1.0), (11, 3, 1, 4.0), (11, 9, 1, 8.0), (12, 1, 1, 16.0)], "l_orderkey long, l_partkey long, l_suppkey long, l_extendedprice double"),
    }
    con = duckdb.connect()
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    found = workloads.QUERIES["joi09_full_chain"](spark, str(tmp_path))
    assert "Expand" not in found._jdf.queryExecution().executedPlan().toString()
    assert rows_of(found.toPandas()) == rows_of(con.execute(workloads.ORACLE["joi09_full_chain"]).df())
