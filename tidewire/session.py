"""Session settings and the shared folder used for written intermediates."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

#: Settings the library is tuned for.  All of them only pick a physical plan;
#: results do not depend on them.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Text work is heavy for its bytes: keep all cores busy after a small shuffle.
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Sections and cards gather a few short pieces each; sorting instead of hashing
    # from 128 groups on (the default) doubles their time.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "16384",
}


def get_session(app: str = "tidewire", master: str | None = None, **conf: str) -> SparkSession:
    """Build (or fetch) a session with the library defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read, as named by ``spark.checkpoint.dir``.

    A machine-local folder is only used on a local master, where driver and
    executors are one process; a cluster without the setting is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
    folder = tempfile.mkdtemp(prefix="tidewire-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    The result has no lineage and survives lost executors, because every
    later reader starts from the files.  Columns of ``by`` become folders.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidewire-{name}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """``written``, with aggregates that are observed while the rows are written."""
    seen = Observation(name)
    out = written(df.observe(seen, *(measure.alias(key) for key, measure in measures.items())), name)
    return out, {key: int(seen.get.get(key) or 0) for key in measures}
