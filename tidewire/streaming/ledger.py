"""Rows whose key was never seen before, on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidewire.operators.dedup import first_by
from tidewire.streaming.logs import BatchLog, run_available


def first_seen_stream(stream: DataFrame, folder: str, key: str, order: str) -> DataFrame:
    """First row of each key over the whole history of the stream.

    The first row of a micro-batch is found before the shuffle, then compared with
    the keys written by earlier micro-batches.  Keys are kept for ever.
    """
    ledger = BatchLog(f"{folder}/ledger", stream.schema)

    def step(batch: DataFrame, number: int) -> None:
        seen = ledger.before(batch.sparkSession, number).select(key)
        ledger.write(first_by(batch, [key], [order]).join(seen, key, "left_anti"), number)

    run_available(stream, f"{folder}/checkpoint", step)
    return ledger.all(stream.sparkSession)
