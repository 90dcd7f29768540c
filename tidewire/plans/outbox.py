"""Messages of runs, kept in order, and what became of them.

The messages of a run are numbered and written before any of them is sent, so a run that is taken up again sends
the same ones.  A client sends them part by part in their order; what a part accepted is written before the next
part begins, and parts that were sent are not sent again.  Only the part at which a run was lost is repeated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.operators.messages import ORDER, numbered

#: Messages of a part, which one task sends in order.
PART_ROWS = 1000

#: Sends one payload; an exception says that it was not accepted.
Client = Callable[[str], None]

_MESSAGES = T.StructType(
    [
        T.StructField("number", T.LongType()), T.StructField("order_key", T.LongType()), T.StructField("source", T.StringType()),
        T.StructField("source_ord", T.IntegerType()), T.StructField("pos", T.LongType()), T.StructField("item_id", T.StringType()),
        T.StructField("url", T.StringType()), T.StructField("dedupe_key", T.StringType()),
        T.StructField("original_title", T.StringType()), T.StructField("payload", T.StringType()),
        T.StructField("part", T.LongType()),
    ]
)
_ACKS = T.StructType([T.StructField("order_key", T.LongType()), T.StructField("problem", T.StringType())])


class Outbox:
    """Messages and acknowledgements below one folder that all executors can reach."""

    def __init__(self, spark: SparkSession, path: str, part_rows: int = PART_ROWS) -> None:
        self.spark, self.path, self.part_rows = spark, path.rstrip("/"), part_rows

    def _folder(self, kind: str, run_id: str) -> str:
        return f"{self.path}/{kind}/run={hashlib.sha256(run_id.encode()).hexdigest()[:40]}"

    def _complete(self, folder: str) -> bool:
        """Spark leaves this file once all tasks have written."""
        mark = self.spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
        return mark.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(mark)

    def put(self, run_id: str, messages: DataFrame) -> DataFrame:
        """Number the messages of a run from 0 and keep them; those of an earlier attempt stay as they are."""
        folder = self._folder("messages", run_id)
        if not self._complete(folder):
            rows = numbered(messages, ORDER, "number").withColumn("part", F.floor(F.col("number") / self.part_rows))
            rows.select(*_MESSAGES.names).write.partitionBy("part").mode("overwrite").parquet(folder)
        return self.messages(run_id)

    def messages(self, run_id: str) -> DataFrame:
        folder = self._folder("messages", run_id)
        if not self._complete(folder):
            return self.spark.createDataFrame([], _MESSAGES)
        return self.spark.read.schema(_MESSAGES).parquet(folder)

    def acknowledge(self, run_id: str, accepted: DataFrame) -> DataFrame:
        """Keep the ``order_key`` of accepted messages of a run; those that were kept earlier stay."""
        folder = f"{self._folder('acks', run_id)}/all"
        if not self._complete(folder):
            rows = accepted.select("order_key", F.lit(None).cast("string").alias("problem"))
            rows.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(_ACKS).parquet(folder).where("problem IS NULL").select("order_key")

    def sender(self, run_id: str, factory: Callable[[], Client]) -> Callable[[DataFrame], DataFrame]:
        """A sink that sends the messages of a run in order with a client per part, and returns those accepted."""

        def send(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = None
            try:
                for batch in rows:
                    if client is None:
                        client = factory()
                    done = []
                    for key, payload in zip(batch["order_key"], batch["payload"], strict=True):
                        try:
                            client(payload)
                            done.append((key, None))
                        except Exception as problem:  # noqa: BLE001 - one message must not stop the others
                            done.append((key, f"{type(problem).__name__}: {problem}"))
                    yield pd.DataFrame(done, columns=["order_key", "problem"])
            finally:
                close = getattr(client, "close", None)
                if callable(close):
                    close()

        def sink(messages: DataFrame) -> DataFrame:
            top = self.messages(run_id).agg(F.max("part")).first()[0]
            folders = [f"{self._folder('acks', run_id)}/part-{part}" for part in range(0 if top is None else top + 1)]
            for part, folder in enumerate(folders):
                if self._complete(folder):
                    continue
                rows = self.messages(run_id).where(F.col("part") == part).select("number", "order_key", "payload")
                rows = rows.coalesce(1).sortWithinPartitions("number")
                rows.mapInPandas(send, _ACKS).write.mode("overwrite").parquet(folder)
            if not folders:
                return messages.select("order_key").limit(0)
            return self.spark.read.schema(_ACKS).parquet(*folders).where("problem IS NULL").select("order_key")

        return sink
