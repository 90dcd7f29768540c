"""Comparing items with what was delivered or belongs to a first window.

Items are compared by their key everywhere, and items that are named by their URL
also by (source, item id) and (source, URL).  Both sides are spread into one row for each
identity, so one join over one scan of the state answers for all sources and kinds;
Spark broadcasts a side only when its files are small enough.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.dedup import first_id_in_batch
from tidewire.session import written


def seen_keys(delivered: DataFrame, baseline: DataFrame) -> DataFrame:
    """Keys of both state tables."""
    return delivered.select("dedupe_key").unionByName(baseline.select("dedupe_key"))


def _identities(rows: DataFrame, *keep: str, key: Column | None = None, named: Column | None = None) -> DataFrame:
    """A row (kind, owner, value) for each identity: the key, and per source the item id and the URL.

    ``key`` and ``named`` say where the key, and where id and URL, are identities at all.
    """
    every = F.lit(True)
    one = lambda kind, owner, value, when: F.when(
        when & F.col(value).isNotNull(), F.struct(F.lit(kind).alias("kind"), owner.alias("owner"), F.col(value).alias("value"))
    )
    key, named = every if key is None else key, every if named is None else named
    found = F.array(
        one("key", F.lit(""), "dedupe_key", key), one("id", F.col("source"), "item_id", named), one("url", F.col("source"), "url", named)
    )
    return rows.select(*keep, F.inline(F.array_compact(found)))


def _state(delivered: DataFrame, baseline: DataFrame, baseline_keys: bool = True) -> DataFrame:
    """Identities of both tables, each read once; first windows may lack an id or a URL."""
    columns = ("source", "dedupe_key", "item_id", "url")
    rows = delivered.select(*columns, F.lit(False).alias("_first")).unionByName(
        baseline.select(
            "source", "dedupe_key", *(F.nullif(F.col(c), F.lit("")).alias(c) for c in columns[2:]), F.lit(True).alias("_first")
        )
    )
    return _identities(rows, key=~F.col("_first") | F.lit(baseline_keys))


def _known(items: DataFrame, state: DataFrame) -> DataFrame:
    """Places (source, pos) of the items that share an identity with the state: one join for all kinds."""
    asked = _identities(items, "source", "pos", named=F.col("ordinary"))
    return asked.join(state, ["kind", "owner", "value"], "left_semi").select("source", "pos").distinct()


def not_in_state(items: DataFrame, delivered: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items whose key, id and URL are all new."""
    return items.join(_known(items, _state(delivered, baseline)), ["source", "pos"], "left_anti")


def unseen(items: DataFrame, delivered: DataFrame, baseline: DataFrame) -> DataFrame:
    """New items, each item id once per source.

    ``items`` hold each key once per source and have the column ``ordinary``.  What is
    new is written once, so that the joins with the state run only once.
    """
    return first_id_in_batch(written(not_in_state(items, delivered, baseline), "new"))


def persisted_keys(items: DataFrame, delivered: DataFrame, baseline: DataFrame) -> DataFrame:
    """Distinct keys of the items that are in either table."""
    return (
        items.select("dedupe_key")
        .join(seen_keys(delivered, baseline), "dedupe_key", "left_semi")
        .distinct()
    )


def delivered_items(items: DataFrame, delivered: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items known as delivered: by key from deliveries, by id or URL also from first windows."""
    known = _known(items, _state(delivered, baseline, baseline_keys=False))
    return items.join(known, ["source", "pos"], "left_semi").distinct()


def baseline_items(items: DataFrame, baseline: DataFrame) -> DataFrame:
    """Items whose key is in any first window."""
    return items.join(baseline.select("dedupe_key"), "dedupe_key", "left_semi")
