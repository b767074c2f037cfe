"""Helpers that the operators share: reading, fresh names, connected groups, text codes."""

from __future__ import annotations

import ctypes
import os
from functools import lru_cache, wraps
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import settle

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a data folder; workers can import this package afterwards."""
    importable(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(table: DataFrame) -> DataFrame:
    """A scan of at least as many partitions as there are cores: of a small file, which would keep one core busy, the columns in use are
    shuffled; a large table has more partitions than that and is left alone."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def importable(spark: SparkSession) -> None:
    """Puts the folder that holds the package on the Python path of local workers.

    Where the session has the default of 10,000 rows for an Arrow batch, that becomes 2,000: texts are long, and a worker
    holds a batch several times over.
    """
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of df has, whatever its letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


@lru_cache(1)
def _libc():
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Freed memory of a worker goes back to the system; workers outlive tasks, and what one stage needed the next would find taken."""
    trim = _libc()
    if trim:
        trim(0)


def trimmed(run):
    """A function of batches that gives memory back at its end."""

    @wraps(run)
    def inner(batches):
        yield from run(batches)
        give_back()

    return inner


def connected(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the group that edges (u, v) connect. Labels jump, so rounds grow with the logarithm of a path's length."""
    e = settle(edges.select("u", "v").union(edges.select("v", "u")).distinct())
    label = settle(e.groupBy("u").agg(F.least("u", F.min("v")).alias("label")))
    while True:
        heard = e.join(label.select(F.col("u").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("heard"))
        lower = label.join(heard, "u").select("u", F.col("label").alias("was"), F.least("label", "heard").alias("label"))
        beyond = lower.select(F.col("u").alias("label"), F.col("label").alias("further"))
        new = settle(lower.join(beyond, "label").select("u", "was", F.least("label", "further").alias("label")))
        changed = not new.where("label < was").isEmpty()
        label = new.select("u", "label")
        if not changed:
            return label.withColumnRenamed("u", "node")


def forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(x, smallest number connected with it) for those of 0 to n - 1 that pairs (a, b) connect with a smaller one."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        old = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, old[a], low)
        np.minimum.at(label, old[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(label, old):
            break
    moved = np.flatnonzero(label < np.arange(n))
    return moved, label[moved]


def documents_by_id(docs: DataFrame) -> DataFrame:
    """(doc_id long, text string), rows without an id left out."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")


@lru_cache(1)
def letters() -> np.ndarray:
    """For each code point: is it a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


@lru_cache(1)
def letters_or_digits() -> np.ndarray:
    """For each code point: is it a letter or of a number category."""
    return np.fromiter((chr(i).isalpha() or chr(i).isnumeric() for i in range(0x110000)), dtype=bool, count=0x110000)


def codes(text: str) -> np.ndarray:
    """The code points of a text."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        x = x ^ (x >> np.uint64(32))
        x = x * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))
