"""Runs over landed documents: one micro-batch is one run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.enrichment import Summarizer
from tidewire.plans.run import Result, Settings, Sink, execute, send_all
from tidewire.plans.state import StateStore
from tidewire.schemas import RAW_DOCS
from tidewire.streaming.logs import run_available


def landed(spark: SparkSession, folder: str, files_per_run: int | None = None) -> DataFrame:
    """Stream over the landing folder; write the pages of one run as one set of files."""
    reader = spark.readStream.schema(RAW_DOCS)
    if files_per_run:
        reader = reader.option("maxFilesPerTrigger", files_per_run)
    return reader.parquet(folder)


def run_landed(
    docs: DataFrame,
    store_path: str,
    sources: DataFrame,
    settings: Settings,
    summarizer: Callable[[], Summarizer],
    *,
    checkpoint: str,
    send: Sink = send_all,
    send_alerts: Sink = send_all,
    after: Callable[[Result], None] | None = None,
) -> StreamingQuery:
    """Run for every micro-batch that has landed.

    The number of the micro-batch names the run, and a published run is not
    repeated, so a restart neither loses nor doubles state.  What was sent before a
    crash may be sent again.
    """

    def step(batch: DataFrame, number: int) -> None:
        store = StateStore(batch.sparkSession, store_path)
        run_id = f"batch-{number}"
        if store.sequence_of(run_id) is not None:
            return
        result = execute(
            store, run_id, batch, sources, settings, summarizer, send=send, send_alerts=send_alerts
        )
        if after is not None:
            after(result)

    return run_available(docs, checkpoint, step)
