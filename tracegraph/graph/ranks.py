"""PageRank over packed edges.

Nodes are numbered in blocks of about BLOCK. The edges from a block to a block are a row of bytes, or several of about EDGES edges dealt by where they lead,
so a round shuffles four bytes for an edge, and the ranks of a block to the rows that start from it, not a row for each edge. No vector comes to the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import settle

BLOCK, EDGES, TASKS, LEAST = 2_000_000, 16_000_000, 24, 1_000_000  #: nodes of a block; edges of a row, about; rows there should be, where they have LEAST edges each
SLICE = 1 << 33  #: monotonically_increasing_id numbers rows of a partition from a multiple of this


def _values(x: np.ndarray) -> tuple[bytes | None, bytes]:
    """(places, values) of what isn't 0, or (None, all values) where that is shorter."""
    at = np.flatnonzero(x)
    return (at.astype(np.int32).tobytes(), x[at].tobytes()) if len(at) * 3 < len(x) * 2 else (None, x.tobytes())


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = pdf["a"].to_numpy(), pdf["b"].to_numpy()
    order = np.argsort(b, kind="stable")
    into, many = np.unique(b[order], return_counts=True)
    first = pdf.iloc[:1]
    return pd.DataFrame({"unit": first["unit"].array, "from": first["from"].array, "to": first["to"].array, "x": [into.astype(np.int32).tobytes()], "y": [many.astype(np.int32).tobytes()], "z": [a[order].astype(np.int32).tobytes()]})


def _give(pdf: pd.DataFrame) -> pd.DataFrame:
    """What one row of edges carries from its block's ranks."""
    edges, ranks = pdf[pdf["z"].notna()].iloc[0], pdf[pdf["z"].isna()].iloc[0]
    share = np.frombuffer(ranks["x"])
    into, many = np.frombuffer(edges["x"], np.int32), np.frombuffer(edges["y"], np.int32)
    got = np.zeros(int(into[-1]) + 1)
    got[into] = np.add.reduceat(share[np.frombuffer(edges["z"], np.int32)], np.cumsum(many) - many)
    at, values = _values(got)
    return pd.DataFrame({"block": [edges["to"]], "x": [at], "y": [values]})


def pagerank(edges: DataFrame, damping: float, tolerance: float, most: int) -> DataFrame:
    """(node, rank), see traverse.pagerank."""
    e = settle(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct())
    ends = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("out"))
    v = ends.union(e.select("dst", F.lit(0).cast("long")).distinct()).groupBy("node").agg(F.sum("out").alias("out"))
    v = settle(v)
    n, m = v.count(), e.count()
    if not n:
        return v.select("node", F.lit(0.0).alias("rank"))
    v = settle(v.repartition(-(-n // BLOCK), "node")).withColumn("id", F.monotonically_increasing_id())
    v = v.select("node", "out", (F.col("id") / SLICE).cast("int").alias("block"), (F.col("id") % SLICE).cast("int").alias("at"))
    ids = e.join(v.select(F.col("node").alias("src"), F.col("block").alias("from"), F.col("at").alias("a")).hint("merge"), "src").drop("src")
    ids = settle(ids.join(v.select(F.col("node").alias("dst"), F.col("block").alias("to"), F.col("at").alias("b")).hint("merge"), "dst").drop("dst"))
    rows = min(EDGES, max(LEAST, m // TASKS))
    parts = ids.groupBy("from", "to").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    unit = F.concat_ws("-", "from", "to", F.pmod(F.hash("b"), F.col("parts")))
    packed = ids.join(F.broadcast(parts), ["from", "to"]).select(unit.alias("unit"), "from", "to", "a", "b")
    packed = settle(packed.groupBy("unit").applyInPandas(_pack, "unit string, `from` int, `to` int, x binary, y binary, z binary"))
    units = packed.select("unit", F.col("from").alias("block"))

    def begin(pdf: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros(len(pdf))
        out[pdf["at"].to_numpy()] = pdf["out"].to_numpy()
        rank = np.full(len(out), 1.0 / n)
        return told(pdf["block"].iloc[0], rank, out, 0.0)

    def told(block: int, rank: np.ndarray, out: np.ndarray, moved: float) -> pd.DataFrame:
        share = np.divide(rank, out, out=np.zeros(len(out)), where=out > 0)
        return pd.DataFrame({"block": [block], "share": [share.tobytes()], "rank": [rank.tobytes()], "out": [out.astype(np.int32).tobytes()], "flowing": [rank[out > 0].sum()], "moved": [moved]})

    state, kind = "block int, share binary, rank binary, out binary, flowing double, moved double", "block int, x binary, y binary"
    now = settle(v.groupBy("block").applyInPandas(begin, state))
    for _ in range(most):
        flowing = now.agg(F.sum("flowing")).first()[0]
        base = (1 - damping) / n + damping * (1.0 - flowing) / n

        def take(pdf: pd.DataFrame) -> pd.DataFrame:
            own = pdf[pdf["rank"].notna()].iloc[0]
            rank, out = np.frombuffer(own["rank"]), np.frombuffer(own["out"], np.int32)
            got = np.zeros(len(rank))
            for x, y in zip(pdf["x"], pdf["y"]):
                if y is not None:
                    values = np.frombuffer(y)
                    if x is None:
                        got[: len(values)] += values
                    else:
                        got[np.frombuffer(x, np.int32)] += values
            new = base + damping * got  # noqa: B023, as it runs within the round
            return told(own["block"], new, out.astype(float), float(((new - rank) ** 2).sum()))

        sent = units.join(now.select("block", "share").hint("merge"), "block").select("unit", F.col("block").alias("from"), F.lit(None).cast("int").alias("to"), F.col("share").alias("x"), F.lit(None).cast("binary").alias("y"), F.lit(None).cast("binary").alias("z"))
        got = packed.union(sent).groupBy("unit").applyInPandas(_give, kind)
        none = F.lit(None).cast("binary")
        now = settle(now.select("block", "rank", "out", none.alias("x"), none.alias("y")).union(got.select("block", none, none, "x", "y")).groupBy("block").applyInPandas(take, state))
        if now.agg(F.sum("moved")).first()[0] ** 0.5 < tolerance:
            break

    def ended(batches):
        for pdf in batches:
            for block, rank in zip(pdf["block"], pdf["rank"]):
                values = np.frombuffer(rank)
                for at in range(0, len(values), 100_000):
                    own = values[at : at + 100_000]
                    yield pd.DataFrame({"block": block, "at": np.arange(at, at + len(own)), "rank": own})

    return v.join(now.select("block", "rank").mapInPandas(ended, "block int, at int, rank double").hint("merge"), ["block", "at"]).select("node", "rank")
