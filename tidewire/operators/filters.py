"""Keyword, age and source gates."""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.dates import date_bound
from tidewire.functions.text import strip


def keyword_pattern(keywords: Sequence[str]) -> str:
    """One pattern for all keywords, not inside a longer ASCII word."""
    words = "|".join(re.sub(r"([^\w\s]|_)", r"\\\1", k) for k in keywords)
    return rf"(?iu)(?<![A-Za-z0-9_])(?:{words})(?![A-Za-z0-9_])"


def keyword_hit(keywords: Sequence[str], fields: Sequence[str]) -> Column:
    """True when any keyword is in one of the text fields."""
    if not keywords:
        return F.lit(False)
    return F.concat_ws("\n", *fields).rlike(keyword_pattern(keywords))


def is_stale(bound: Column, run_date: datetime.date, max_age_days: Column) -> Column:
    """Older than the limit; no date or no limit means fresh."""
    return F.coalesce(bound < F.date_sub(F.lit(run_date), max_age_days), F.lit(False))


def age_gate(items: DataFrame, run_date: datetime.date) -> DataFrame:
    """Add ``bound`` and ``stale``; items carry ``max_age_days`` of their source."""
    return items.withColumn("bound", F.expr(date_bound("published_at"))).withColumn(
        "stale", is_stale(F.col("bound"), run_date, F.col("max_age_days"))
    )


def first_missing(**required: str) -> Column:
    """``missing <name>`` for the first blank required column, NULL when all are there."""
    reason: Column | None = None
    for name, column in required.items():
        blank = F.expr(f"coalesce({strip(f'`{column}`')}, '') = ''")
        text = F.lit(f"missing {name}")
        reason = F.when(blank, text) if reason is None else reason.when(blank, text)
    return reason


def source_roles(sources: DataFrame, failures: DataFrame, issues: DataFrame, source_state: DataFrame) -> DataFrame:
    """What happens to the items of each source in this run (column ``role``).

    ``failed``: not collected.  ``deferred``: first window with malformed entries, so
    it is not recorded yet.  ``baseline``: first window to be recorded.  ``active``:
    recorded before.  All frames have at most one row per source after grouping.
    """
    counts = issues.groupBy("source").agg(F.count(F.lit(1)).alias("issues"))
    flags = lambda df, name: df.select("source").distinct().withColumn(name, F.lit(True))
    return (
        sources.join(counts, "source", "left")
        .join(flags(failures, "failed"), "source", "left")
        .join(flags(source_state, "initialized"), "source", "left")
        .withColumn("issues", F.coalesce("issues", F.lit(0)).cast("long"))
        .withColumn(
            "role",
            F.when(F.col("failed"), F.lit("failed"))
            .when(F.col("initialized"), F.lit("active"))
            .when(F.col("issues") > 0, F.lit("deferred"))
            .otherwise(F.lit("baseline")),
        )
        .drop("failed", "initialized")
    )
