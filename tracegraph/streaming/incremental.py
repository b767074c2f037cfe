"""Findings of documents as they arrive; an addition to the batch gates, with the same schema.

Each micro-batch is checked by a gate that needs no other rows; findings repeated within the watermark are dropped by identity, and each
batch is written under its number, so that a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators import findings as fd


def stream_findings(arriving: DataFrame, gate: Callable[[DataFrame], DataFrame], event_time: str, late: str, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Starts writing the findings of arriving rows to out; gate maps a streaming DataFrame to (rule, subject, class, detail, event_time)."""
    found = gate(arriving.withWatermark(event_time, late)).dropDuplicatesWithinWatermark(fd.IDENTITY)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = found.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
