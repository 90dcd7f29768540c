"""Failure events: reported once, alerted once until recovery."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.identity import AGE_KEY, COLLECTION_PREFIX, SOURCE_KEY
from tidewire.operators.dedup import first_by
from tidewire.operators.ordered import carry_forward

# Order of the stages at which one article can fail.
ITEM_STAGES = ("cache", "content", "summary", "message", "send", "record")

EVENT = ("source", "item_key", "title", "stage", "event_ord")
_UNNAMED = "（列表条目 {}）"
_SOURCE_TITLE = "（来源采集）"


def issue_events(issues: DataFrame) -> DataFrame:
    """Malformed entries as events; entries without a title are named by position."""
    title = F.when(F.col("title") != "", F.col("title")).otherwise(
        F.format_string(_UNNAMED.format("%s"), F.col("pos").cast("string"))
    )
    return issues.select(
        "source",
        "item_key",
        title.alias("title"),
        F.when(F.col("stage") != "", F.col("stage")).otherwise(F.lit("collection")).alias("stage"),
        (F.lit(1 << 32) + F.col("pos")).alias("event_ord"),
    )


def source_events(failures: DataFrame) -> DataFrame:
    return failures.select(
        "source",
        F.lit(SOURCE_KEY).alias("item_key"),
        F.lit(_SOURCE_TITLE).alias("title"),
        F.lit("collection").alias("stage"),
        F.lit(0).cast("long").alias("event_ord"),
    )


def stale_summary(stale: DataFrame) -> DataFrame:
    """Per source: number of stale items, oldest bound, first title in page order."""
    return stale.groupBy("source").agg(
        F.count(F.lit(1)).alias("stale"),
        F.min("bound").alias("oldest"),
        F.min_by("title", "pos").alias("sample"),
        F.first("max_age_days").alias("max_age_days"),
    )


def age_label(summary: DataFrame) -> DataFrame:
    """The alert text about stale items."""
    text = F.concat(
        F.col("stale").cast("string"),
        F.lit(" 篇超过 "),
        F.col("max_age_days").cast("string"),
        F.lit(" 天的文章已跳过（最老 "),
        F.coalesce(F.date_format("oldest", "yyyy-MM-dd"), F.lit("日期未知")),
        F.lit("，如："),
        F.substring("sample", 1, 80),
        F.lit("）"),
    )
    return summary.withColumn("label", text)


def age_events(stale: DataFrame) -> DataFrame:
    return age_label(stale_summary(stale)).select(
        "source",
        F.lit(AGE_KEY).alias("item_key"),
        F.col("label").alias("title"),
        F.lit("age").alias("stage"),
        F.lit(2 << 32).cast("long").alias("event_ord"),
    )


def item_events(failed: DataFrame) -> DataFrame:
    """Articles that failed at a stage; ``failed`` has source, dedupe_key, title, stage."""
    place = F.array_position(F.array(*[F.lit(s) for s in ITEM_STAGES]), F.col("stage"))
    return failed.select(
        "source",
        F.col("dedupe_key").alias("item_key"),
        "title",
        "stage",
        (F.lit(3 << 32) + place).alias("event_ord"),
    )


def distinct_failures(events: DataFrame) -> DataFrame:
    """One event per (source, key) and run: the first stage that failed."""
    return first_by(events, ["source", "item_key"], ["event_ord", "stage"])


def failure_stages(failures: DataFrame) -> DataFrame:
    """Distinct failed stages of each article, in stage order."""
    place = F.array_position(F.array(*[F.lit(s) for s in ITEM_STAGES]), F.col("stage")).cast("int")
    ordered = F.array_sort(F.collect_set(F.struct(F.when(place == 0, 99).otherwise(place).alias("o"), "stage")))
    return failures.groupBy("source", "dedupe_key").agg(
        F.transform(ordered, lambda s: s["stage"]).alias("stages")
    )


# --------------------------------------------------------------------------
# Active failures
# --------------------------------------------------------------------------


def active_failures(log: DataFrame) -> DataFrame:
    """(source, item_key) whose latest log entry is an alert."""
    return (
        log.groupBy("source", "item_key")
        .agg(F.max_by("event", F.struct("run_seq", "seq")).alias("event"))
        .where(F.col("event") == "alerted")
        .select("source", "item_key")
    )


def to_alert(events: DataFrame, active: DataFrame) -> DataFrame:
    """Events that are not active already."""
    return events.join(active, ["source", "item_key"], "left_anti")


def cleared(
    active: DataFrame, source: str | None = None, prefix: str | None = None, keys: DataFrame | None = None
) -> DataFrame:
    """Active failures of one source, of one key prefix, or of a table of (source, item_key)."""
    result = active
    if source is not None:
        result = result.where(F.col("source") == source)
    if prefix is not None:
        result = result.where(F.startswith("item_key", F.lit(prefix)))
    if keys is not None:
        result = result.join(keys.select("source", "item_key"), ["source", "item_key"], "left_semi")
    return result


def vanished_issues(active: DataFrame, events: DataFrame, collected: DataFrame) -> DataFrame:
    """Entry failures that are gone from the latest page of a collected source."""
    return (
        cleared(active, prefix=COLLECTION_PREFIX)
        .join(collected.select("source"), "source", "left_semi")
        .join(events.select("source", "item_key"), ["source", "item_key"], "left_anti")
    )


def proven_recoveries(active: DataFrame, persisted: DataFrame, events: DataFrame) -> DataFrame:
    """Failures of articles that turn out to be delivered or in a first window.

    An article that is still malformed in this run has not recovered.
    """
    return (
        active.join(
            persisted.select("source", F.col("dedupe_key").alias("item_key")), ["source", "item_key"], "left_semi"
        ).join(events.select("source", "item_key"), ["source", "item_key"], "left_anti")
    )


def alert_once(
    history: DataFrame, keys: tuple[str, ...], order: str, segment: str, failed: str, recovered: str
) -> DataFrame:
    """Failures of a long history that raise an alert: the first one after each recovery.

    ``failed`` and ``recovered`` are SQL conditions; other rows do not matter.
    """
    kind = F.when(F.expr(failed), F.lit("f")).when(F.expr(recovered), F.lit("r"))
    relevant = history.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    return (
        carry_forward(relevant, keys, order, segment, {"_before": F.col("_kind")})
        .where((F.col("_kind") == "f") & (F.coalesce("_before", F.lit("r")) == "r"))
        .drop("_kind", "_before")
    )


def latest_state(history: DataFrame, keys: tuple[str, ...], order: str, failed: str, recovered: str) -> DataFrame:
    """Keys whose latest relevant row is a failure."""
    kind = F.when(F.expr(failed), F.lit("f")).when(F.expr(recovered), F.lit("r"))
    return (
        history.withColumn("_kind", kind)
        .where(F.col("_kind").isNotNull())
        .groupBy(*keys)
        .agg(F.max_by("_kind", order).alias("_last"), F.max(order).alias("last_at"))
        .where(F.col("_last") == "f")
        .drop("_last")
    )
