"""Alert once until recovery, on a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.failures import alert_once
from tidewire.streaming.logs import BatchLog, run_available


def alert_stream(
    stream: DataFrame,
    folder: str,
    keys: tuple[str, ...],
    order: str,
    segment: str,
    failed: str,
    recovered: str,
    snapshot_every: int = 20,
) -> DataFrame:
    """Alerts of all micro-batches.

    State is the last relevant event of each key, appended per micro-batch; every so
    many of them the whole state is written, and only what came since is read.  Keys
    meet their state inside the same segmented plan as in the batch operator, so a
    key with a large part of a micro-batch is no single task.
    """
    spark: SparkSession = stream.sparkSession
    alerts = BatchLog(f"{folder}/alerts", stream.schema)
    state = BatchLog(f"{folder}/state", stream.schema)
    relevant = f"({failed}) OR ({recovered})"

    def step(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        rows = batch.where(relevant)
        names = [c for c in stream.columns if c not in keys]
        latest = lambda df: df.groupBy(*keys).agg(
            F.max_by(F.struct(*names), order).alias("last")
        ).select(*keys, "last.*").select(*stream.columns)
        since = max(number - 1, 0) // snapshot_every * snapshot_every
        past = state.before(session, number, since).drop("batch")
        # Only the keys of this micro-batch are brought up to date.
        asked = rows.select(*keys).distinct()
        touched = latest(past.join(asked, list(keys), "left_semi").select(*stream.columns))
        merged = rows.withColumn("_known", F.lit(False)).unionByName(touched.withColumn("_known", F.lit(True)))
        raised = alert_once(merged, keys, order, segment, failed, recovered).where(~F.col("_known"))
        alerts.write(raised, number)
        whole = number % snapshot_every == 0
        state.write(latest(rows.unionByName(past) if whole else rows), number)

    run_available(stream, f"{folder}/checkpoint", step)
    return alerts.all(spark)


def event_schema() -> T.StructType:
    return T.StructType(
        [
            T.StructField("event_id", T.LongType()),
            T.StructField("ts", T.TimestampNTZType()),
            T.StructField("user_id", T.LongType()),
            T.StructField("event_type", T.StringType()),
            T.StructField("value", T.DoubleType()),
            T.StructField("props", T.StringType()),
        ]
    )
