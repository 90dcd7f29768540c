"""Order-sensitive first-wins deduplication.

All of them are ``row_number() = 1`` filters.  Spark turns these into a group limit
that runs before the shuffle, so a key shared by a third of all rows leaves at
most one row per input task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.identity import order_key


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def first_window(
    df: DataFrame, size: int, keys: Sequence[str] = ("source",), order: Sequence[str] = ("pos",)
) -> DataFrame:
    """The first ``size`` raw entries of each source."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= F.lit(size)).drop("_rank")


def first_window_by_setting(
    df: DataFrame, keys: Sequence[str] = ("source",), order: Sequence[str] = ("pos",)
) -> DataFrame:
    """Per-source limit from the column ``window_size``.

    The largest limit is a bound for all groups, by which Spark drops rows before the shuffle; so a source with most
    of the rows is not sorted as a whole.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    most = df.agg(F.max("window_size")).first()[0] or 0
    ranked = df.withColumn("_rank", rank).where(F.col("_rank") <= F.lit(most))
    return ranked.where(F.col("_rank") <= F.col("window_size")).drop("_rank")


def first_in_source(df: DataFrame, also: Sequence[str] = ()) -> DataFrame:
    """First item of a key within its source."""
    return first_by(df, [*also, "source", "dedupe_key"], ["pos"])


def priority_claims(df: DataFrame) -> DataFrame:
    """The item that holds a key: earliest source first, then page order.

    Claims are made by presence; whether the holder is delivered later does not
    matter.
    """
    return first_by(df, ["dedupe_key"], ["source_ord", "pos"])


def with_claims(df: DataFrame) -> DataFrame:
    """All items with a flag ``claimed`` on the holder of each key.

    Holders are marked by their own position, not by key, so the join is spread
    evenly however often one key occurs.
    """
    keyed = df.withColumn("order_key", F.expr(order_key("source_ord", "pos")))
    holders = (
        keyed.groupBy("dedupe_key")
        .agg(F.min("order_key").alias("order_key"))
        .select("order_key", F.lit(True).alias("claimed"))
    )
    return keyed.join(holders, "order_key", "left").withColumn(
        "claimed", F.coalesce("claimed", F.lit(False))
    )


def first_id_in_batch(df: DataFrame) -> DataFrame:
    """Drop ordinary rows whose (source, item id) an earlier unseen row already has.

    Rows that are not named by their URL always stay.
    """
    ordinary = F.col("ordinary")
    firsts = first_by(df, ["source", "item_id"], ["pos"]).where(ordinary)
    return firsts.unionByName(df.where(~ordinary))
