"""Output and state of a stream as Parquet, one folder per micro-batch.

A micro-batch that is run again overwrites its own folders, and state is read only
from earlier micro-batches, so the result is the same however often one fails.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch"


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


class BatchLog:
    """Rows written by micro-batches below one folder."""

    def __init__(self, path: str, schema: T.StructType) -> None:
        self.path, self.schema = path, schema

    def before(self, spark: SparkSession, batch: int, since: int = 0) -> DataFrame:
        """Rows of earlier micro-batches; the numbers are folder names, so others are not read."""
        full = T.StructType([*self.schema.fields, T.StructField(BATCH, T.LongType())])
        if not _exists(spark, self.path):
            return spark.createDataFrame([], full)
        return spark.read.schema(full).parquet(self.path).where(
            (F.col(BATCH) < batch) & (F.col(BATCH) >= since)
        )

    def all(self, spark: SparkSession) -> DataFrame:
        return self.before(spark, 1 << 62).drop(BATCH)

    def write(self, rows: DataFrame, batch: int) -> None:
        rows.select(*self.schema.names).write.mode("overwrite").parquet(f"{self.path}/{BATCH}={batch}")


def run_available(stream: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Work off everything that has landed, then stop."""
    query = (
        stream.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return query
