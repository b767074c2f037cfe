"""Operator 7, cost-balanced packing of documents into training sequences.

A document's tokens are counted with the piece file over its whole text; its cost is estimated as LINEAR·tokens + QUADRATIC·tokens² (projections and attention).
Documents are dealt to groups by a hash of their id and of their row in the table of counts, as many groups as the corpus has tokens for, so a group's size doesn't
grow with the corpus, nor with how often an id or a text repeats. In a group, descending by cost, each document goes to the sequence of lowest cost
that still has room for its tokens; a new sequence is opened when none has. A document of more tokens than a sequence holds is cut into
pieces of full sequences and a rest, so all of it is packed.

Defined results: null and empty texts have no tokens and are in no sequence; ties go to the smaller id, piece and then
sequence; rows that repeat are packed as often as they occur; a null doc_id is packed under a null id; very long texts are counted whole; other columns are not
read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, importable, settle
from .pieces import MODEL, MOST, UNIT, by_library, library, normal

CAPACITY = 4096  #: tokens of a sequence
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
GROUP_TOKENS = 64 * CAPACITY  #: tokens in a group, about
FILL = 0.97  #: share of capacity that the first sequences of a group are reckoned with
SCHEMA = "seq_id long, doc_id long, unnamed boolean, piece int, tokens long, cost double"


def cost(tokens):
    """Estimated training cost."""
    return LINEAR * tokens + QUADRATIC * tokens * tokens


def pack_group(tokens: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Sequence number of each item; items in the order of placement (descending cost)."""
    n = max(1, math.ceil(tokens.sum() / (capacity * FILL)))
    room, spent, used = np.full(n, capacity), np.zeros(n), n
    out = np.empty(len(tokens), dtype=np.int64)
    for k, t in enumerate(tokens.tolist()):
        at = int(np.where(room[:used] >= t, spent[:used], np.inf).argmin())
        if room[at] < t:
            if used == len(room):
                room, spent = np.r_[room, np.full(used, capacity)], np.r_[spent, np.zeros(used)]
            at = used
            used += 1
        room[at] -= t
        spent[at] += cost(t)
        out[k] = at
    return out


def _pack(capacity: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["tokens", "unnamed", "doc_id", "piece"], ascending=[False, True, True, True], kind="stable")
        at = pack_group(pdf["tokens"].to_numpy(), capacity)
        _, number = np.unique(at, return_inverse=True)  # sequences that stayed empty have no number
        return pdf.assign(seq_id=(int(pdf["bucket"].iloc[0]) << 24) + number, cost=cost(pdf["tokens"].astype(float)))[["seq_id", "doc_id", "unnamed", "piece", "tokens", "cost"]]

    return run


def _cut(own: DataFrame, capacity: int) -> DataFrame:
    cut = own.select("doc_id", "row", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    return cut.select("doc_id", "row", "piece", F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * F.lit(capacity).cast("long")).alias("tokens"))


def _counts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        sp = library(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                cut = [UNIT.findall(normal(t)) if t else [] for t in batch.column("text").to_pylist()]
                units: set[str] = set().union(*cut)
                new = list(units.difference(known))
                if len(known) + len(new) > MOST:
                    known.clear()
                    new = list(units)
                known.update(zip(new, map(len, by_library(sp, new))))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([sum(map(known.__getitem__, x)) for x in cut], pa.int64())], names=["doc_id", "n"])
        known.clear()  # what a worker knows would stay in its memory while other stages run
        give_back()

    return run


def pack(docs: DataFrame, capacity: int = CAPACITY, group_tokens: int = GROUP_TOKENS, model: str = MODEL) -> DataFrame:
    """(seq_id, doc_id, piece, tokens, cost) of every document with text; texts are read once."""
    importable(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counted = settle(own.mapInArrow(_counts(model), "doc_id long, n long").where("n > 0").withColumn("row", F.monotonically_increasing_id()))
    return _placed(_cut(counted, capacity), capacity, group_tokens)


def _placed(cut: DataFrame, capacity: int, group_tokens: int) -> DataFrame:
    total = cut.agg(F.sum("tokens")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    placed = cut.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(-1)), "row", "piece"), F.lit(groups)))
    # a null would turn a group's ids into floats
    named = placed.select("bucket", F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), F.col("doc_id").isNull().alias("unnamed"), "piece", "tokens")
    return named.groupBy("bucket").applyInPandas(_pack(capacity), SCHEMA).select("seq_id", F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id"), "piece", "tokens", "cost")
