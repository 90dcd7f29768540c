"""Extractors by name, and collecting all sources of a run."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.operators.dedup import first_by
from tidewire.schemas import ISSUES, ITEMS, SOURCE_FAILURES
from tidewire.sources.embedded_json import embedded_json_entries
from tidewire.sources.index_links import index_link_entries
from tidewire.sources.landing import MAX_RESPONSE_BYTES, RESPONSE_NAMES, admit
from tidewire.sources.rss import rss_entries
from tidewire.sources.sections import card_entries, changelog_entries

Extractor = Callable[[DataFrame], DataFrame]

REGISTRY: dict[str, Extractor] = {
    "rss": rss_entries,
    "markdown_index": index_link_entries,
    "markdown_changelog": changelog_entries,
    "markdown_cards": card_entries,
    "next_data_index": embedded_json_entries,
}

#: Two sections of a changelog may have the same text; they stay two entries here.
KEEPS_REPEATS = frozenset({"markdown_changelog"})


class Collected(NamedTuple):
    items: DataFrame
    issues: DataFrame
    failures: DataFrame


def register(name: str, extractor: Extractor, response_name: str | None = None) -> None:
    """Add an extractor: admitted documents in, entry rows out."""
    REGISTRY[name] = extractor
    RESPONSE_NAMES.setdefault(name, response_name or name)


def entries(
    docs: DataFrame,
    sources: DataFrame,
    collector: str,
    max_bytes: int = MAX_RESPONSE_BYTES,
) -> DataFrame:
    """Entry rows (items, issues and failures in one frame) of one collector."""
    if collector not in REGISTRY:
        raise ValueError(f"unsupported collector: {collector}")
    return REGISTRY[collector](admit(docs, sources, collector, max_bytes)).withColumn(
        "collector", F.lit(collector)
    )


def distinct_entries(rows: DataFrame) -> DataFrame:
    """Within a page the first item of a key counts; issues and failures all stay."""
    repeats = (F.col("kind") == "item") & ~F.col("collector").isin(*KEEPS_REPEATS)
    group = F.when(repeats, F.concat(F.lit("k"), F.col("dedupe_key"))).otherwise(
        F.concat(F.col("kind"), F.coalesce(F.col("pos"), F.lit(0)).cast("string"))
    )
    return first_by(rows.withColumn("_group", group), ["source", "page_no", "_group"], ["pos"]).drop("_group")


def split_entries(rows: DataFrame) -> Collected:
    """Distinct entry rows as three tables."""
    return Collected(
        rows.where(F.col("kind") == "item").select(*ITEMS.names),
        rows.where(F.col("kind") == "issue").select(
            "run_id", "source", "source_ord", "pos",
            F.lit("parse").alias("stage"),
            F.col("issue_title").alias("title"),
            F.col("issue_url").alias("url"),
            "message", "item_key",
        ).select(*ISSUES.names),
        rows.where(F.col("kind") == "failure").select(*SOURCE_FAILURES.names),
    )


def collect(
    docs: DataFrame,
    sources: DataFrame,
    collectors: Iterable[str] | None = None,
    max_bytes: int = MAX_RESPONSE_BYTES,
) -> DataFrame:
    """Distinct entry rows of all collectors.

    Land documents partitioned by ``collector`` so that each extractor reads only
    its own files, and write the result once before splitting it.
    """
    frames = [entries(docs, sources, c, max_bytes) for c in (collectors or REGISTRY)]
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return distinct_entries(result)
