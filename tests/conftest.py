"""The session and the SQL engine that all tests share."""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import duckdb
import pandas as pd
import pytest
from compare import rows_of
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "3g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def same_rows() -> Callable[[DataFrame, str, dict[str, pd.DataFrame]], int]:
    """Asserts that a DataFrame and SQL over small tables give the same rows; returns their number."""

    def run(found: DataFrame, sql: str, tables: dict[str, pd.DataFrame]) -> int:
        con = duckdb.connect()
        for name, pdf in tables.items():
            con.register(name, pdf)
        expected = con.execute(sql).df()
        got = found.toPandas()
        assert sorted(got.columns) == sorted(expected.columns)
        assert rows_of(got) == rows_of(expected)
        return len(got)

    return run
