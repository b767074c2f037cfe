"""Session defaults that the engine is written for."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.ansi.enabled": "true",
}


def session(app: str = "tracegraph", **settings: str) -> SparkSession:
    """A session with the defaults; settings override them (dots written as double underscores)."""
    builder = SparkSession.builder.appName(app)
    for key, value in (DEFAULTS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def settle(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a reliable checkpoint in spark.checkpoint.dir, which all executors share, so a lost one loses nothing.

    Where that is unset, a temporary folder serves on one machine; on a cluster it is refused. With
    spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes what nothing refers to any more.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="tracegraph-"))
    return df.checkpoint()


SHARE = 16 << 20  #: bytes of the tables that are read, as files have them, for a task after a shuffle
MOST_TASKS, UNKNOWN = 20_000, 1 << 60  #: tasks at most; Spark's word for a size it doesn't know is larger than any


def shared(df: DataFrame, *keys: str | Column) -> DataFrame:
    """Rows by keys in a number of tasks that grows with the tables they are read from, so that what a task sorts or hashes doesn't.

    Left to itself Spark puts as many shuffled bytes in a task as its settings say, which are several times as many in memory, and hashes a whole scan before it. Where sizes aren't known, as of rows without files, that is how it is.
    """
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    if any(x >= UNKNOWN for x in sizes):
        return df.repartition(*keys)
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, min(-(-sum(sizes) // SHARE), MOST_TASKS))
    return df.repartition(tasks, *keys)


def importable(spark: SparkSession) -> None:
    """Puts the folder that holds the package on the Python path of workers on this machine; clusters install it."""
    root = str(Path(__file__).resolve().parents[1])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
