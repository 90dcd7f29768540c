"""Row types shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidewire.functions.urls import checked_hosts


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in pairs])


STRING, INT, LONG = T.StringType(), T.IntegerType(), T.LongType()
STRINGS = T.ArrayType(STRING)

#: One configured source; ``source_ord`` is its priority.
SOURCES = _fields(
    ("source_ord", INT), ("source", STRING), ("url", STRING), ("allowed_hosts", STRINGS),
    ("window_size", INT), ("collector", STRING), ("content_mode", STRING),
    ("filter", T.BooleanType()), ("max_age_days", INT),
)

#: One fetched list page.
#: A batch may hold several pages of a source: they are told apart by ``doc_id`` and stand in order of ``fetched_at``.
#: Without ``doc_id`` a page is named by a hash of its bytes.
RAW_DOCS = _fields(
    ("run_id", STRING), ("source", STRING), ("doc_id", STRING), ("fetched_at", T.TimestampType()), ("body", T.BinaryType())
)

#: One fetched article.
RAW_ARTICLES = _fields(("article_url", STRING), ("fetched_at", T.TimestampType()), ("body", T.BinaryType()))

ITEM_TEXT = ("item_id", "title", "content", "url", "published_at", "author", "category", "guid", "dedupe_key")
ITEMS = _fields(
    ("run_id", STRING), ("source", STRING), ("source_ord", INT), ("pos", LONG),
    *[(name, STRING) for name in ITEM_TEXT],
)

#: One malformed entry of a list page.
ISSUES = _fields(
    ("run_id", STRING), ("source", STRING), ("source_ord", INT), ("pos", LONG),
    ("stage", STRING), ("title", STRING), ("url", STRING), ("message", STRING), ("item_key", STRING),
)

#: One source that could not be collected at all.
SOURCE_FAILURES = _fields(
    ("run_id", STRING), ("source", STRING), ("source_ord", INT), ("message", STRING)
)

#: Persisted state; every table is an append-only log with the run that wrote it.
STATE = {
    "delivered": _fields(
        ("source", STRING), ("item_id", STRING), ("url", STRING), ("dedupe_key", STRING)
    ),
    "baseline": _fields(
        ("source", STRING), ("dedupe_key", STRING), ("item_id", STRING), ("url", STRING)
    ),
    "source_state": _fields(("source", STRING)),
    "summary_cache": _fields(
        ("source", STRING), ("item_id", STRING), ("item_url", STRING), ("model", STRING),
        ("protocol", STRING), ("base_url", STRING), ("prompt_version", STRING),
        ("title_zh", STRING), ("bullets_zh", STRINGS),
    ),
    "failure_log": _fields(("source", STRING), ("item_key", STRING), ("event", STRING), ("seq", INT)),
    "run_summary": _fields(
        ("run_id", STRING), ("sent", LONG), ("failed", LONG), ("baseline", LONG), ("skipped", LONG),
        ("previewed", LONG), ("exit_code", INT), ("nothing_new", T.BooleanType()),
    ),
}


#: Settings of a source that are not given.
SOURCE_DEFAULTS = {"window_size": 20, "content_mode": "article", "filter": True, "max_age_days": None}


def source_table(spark: SparkSession, sources: Iterable[Mapping]) -> DataFrame:
    """The configured sources, in order of priority.

    Made from an Arrow table, so Spark knows its size and by that decides whether
    to broadcast it.
    """
    rows = [
        {**SOURCE_DEFAULTS, "source_ord": i, **{k: v for k, v in s.items()}}
        for i, s in enumerate(sources)
    ]
    names = [str(r["source"]).casefold() for r in rows]
    if len(set(names)) != len(names):
        raise ValueError("source names must differ by more than case")
    for row in rows:
        row["allowed_hosts"] = checked_hosts(row["allowed_hosts"])
        if not 1 <= row["window_size"] or (row["max_age_days"] or 1) < 1:
            raise ValueError(f"limits of source {row['source']!r} must be positive")
        if row["content_mode"] not in ("article", "inline"):
            raise ValueError(f"unknown content mode: {row['content_mode']!r}")
    return spark.createDataFrame(
        pa.Table.from_pylist(
            [{c: r[c] for c in SOURCES.names} for r in rows], schema=to_arrow_schema(SOURCES)
        )
    )
