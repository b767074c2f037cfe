"""Operator 6, sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size, made from two hashes of its name.
In turns, every shard claims the first slot of its order that is still free, until none is left; shares differ by one slot at most, and
a shard that goes leaves most other slots as they were. The table is of fixed size, checked, and broadcast;
a document's slot is a hash of its id modulo the size, its shard one look-up.

Defined results: a null doc_id hashes like an empty string; rows that repeat go to one shard; text and other columns are not
read; an empty table gives an empty result; a size that is no prime above the number of shards is refused.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARDS = 64
SLOTS = 8191  #: prime, over 100 slots for each shard
MOST_SLOTS = 1 << 22  #: the largest table that is broadcast


def _hash(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's order over the slots."""
    return _hash("start/" + name) % slots, _hash("step/" + name) % (slots - 1) + 1


def fill(names: list[str], slots: int = SLOTS) -> np.ndarray:
    """Shard number of each slot."""
    prime = slots > 1 and all(slots % k for k in range(2, int(slots**0.5) + 1))
    if not names or len(set(names)) < len(names) or not prime or slots < len(names) or slots > MOST_SLOTS:
        raise ValueError("shard names must differ and the table's size be a prime, not under their number nor over MOST_SLOTS")
    starts = [preference(n, slots) for n in names]
    table, tried, left = np.full(slots, -1, dtype=np.int32), [0] * len(names), slots
    while True:
        for s, (start, step) in enumerate(starts):
            at = (start + tried[s] * step) % slots
            while table[at] >= 0:
                tried[s] += 1
                at = (start + tried[s] * step) % slots
            table[at] = s
            tried[s] += 1
            left -= 1
            if not left:
                return table


def shard_names(shards: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(shards)]


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(doc_id, slot, shard) for every row."""
    table = fill(shard_names(shards), slots)
    looked_up = docs.sparkSession.createDataFrame(list(enumerate(table.tolist())), "slot long, shard int")
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    slot = F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), slot.alias("slot")).join(F.broadcast(looked_up), "slot").select("doc_id", "slot", "shard")


def oracle(shards: int = SHARDS, slots: int = SLOTS) -> str:
    """SQL with the filled table as a list."""
    table = ",".join(map(str, fill(shard_names(shards), slots).tolist()))
    return f"""
WITH t AS (SELECT [{table}] AS shards),
d AS (SELECT doc_id, CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) % {slots} AS slot FROM documents)
SELECT doc_id, CAST(slot AS BIGINT) AS slot, CAST(shards[slot + 1] AS INTEGER) AS shard FROM d, t
"""
