"""Messages: rendering, size check and packing under a byte limit."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.dates import display_time
from tidewire.session import written

DEFAULT_LIMIT = 28 * 1024

# Texts of a message.
NO_SUMMARY = "（无摘要）"
TIME_LABEL, DATE_LABEL = "北京时间", "发布日期"


def _part(tag: str, text: Column, href: Column | None = None) -> Column:
    return F.struct(
        F.lit(tag).alias("tag"),
        text.alias("text"),
        (F.lit(None).cast("string") if href is None else href).alias("href"),
    )


def item_paragraphs(
    title: str = "title", url: str = "url", source: str = "source", published: str = "published_at", content: str = "content"
) -> Column:
    """Two paragraphs: the linked title, then source, date and text."""
    summary = F.when(F.col(content) == "", F.lit(NO_SUMMARY)).otherwise(F.col(content))
    label = F.when(F.contains(published, F.lit("T")), F.lit(TIME_LABEL)).otherwise(F.lit(DATE_LABEL))
    details = F.concat(
        F.lit("来源："), F.col(source), F.lit(" · "), label, F.lit("："),
        F.expr(display_time(published)), F.lit("\n"), summary, F.lit("\n"),
    )
    return F.array(
        F.array(_part("a", F.concat(F.col(title), F.lit("\n")), F.col(url))),
        F.array(_part("text", details)),
    )


def payload(title: Column, paragraphs: Column) -> Column:
    """Compact JSON of a message; absent fields are left out."""
    body = F.struct(title.alias("title"), paragraphs.alias("content"))
    return F.to_json(
        F.struct(F.lit("post").alias("msg_type"), F.struct(body.alias("zh_cn")).alias("content"))
    )


def message_title(run_date: Column | str, label: str, source: Column) -> Column:
    day = F.lit(run_date) if isinstance(run_date, str) else run_date
    return F.concat(day, F.lit(f" · {label} · "), source)


def with_message(items: DataFrame, title: Column, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """One message per article: ``payload``, ``bytes`` and ``fits``; nothing is cut."""
    return (
        items.withColumn("payload", payload(title, item_paragraphs()))
        .withColumn("bytes", F.octet_length("payload"))
        .withColumn("fits", F.col("bytes") <= limit)
    )


def failure_message(title: Column, source: Column, article: Column, stage: Column) -> Column:
    """The alert about one failure; long fields are cut."""
    text = F.concat(
        F.lit("来源："), F.substring(source, 1, 200),
        F.lit("\n文章："), F.substring(article, 1, 500),
        F.lit("\n失败阶段："), F.substring(stage, 1, 100), F.lit("\n"),
    )
    return payload(title, F.array(F.array(_part("text", text))))


# --------------------------------------------------------------------------
# Packing
# --------------------------------------------------------------------------


def envelope_bytes(title: Column) -> Column:
    """Size of a message without paragraphs."""
    empty = F.array().cast("array<array<struct<tag:string,text:string,href:string>>>")
    return F.octet_length(payload(title, empty))


def paragraph_bytes(paragraphs: Column) -> Column:
    """Size of an item's paragraphs as they stand in the list of a message."""
    return F.octet_length(F.to_json(paragraphs)) - F.lit(2)


def _next_starts(sizes: Sequence[int], base: int, limit: int) -> tuple[list[int], list[int]]:
    """For a message that starts at each item: where the next one starts; running sizes."""
    total = [0]
    for size in sizes:
        # Every further item also costs one comma.
        total.append(total[-1] + size + 1)
    room = limit - base + 1
    return [bisect_right(total, total[i] + room) - 1 for i in range(len(sizes))], total


def pack_messages(
    items: DataFrame, group: str, pos: str, limit: int = DEFAULT_LIMIT, segment_rows: int = 65536
) -> DataFrame:
    """Fill messages in order, a new one whenever the next item would not fit.

    ``items`` have ``group``, ``pos`` (a unique non-negative integer within the group), ``base``
    (envelope bytes) and ``size`` (paragraph bytes); the result adds ``batch``
    (counting from 0) and ``failed``.  One item that can fit no message fails its
    whole group, with ``batch`` NULL.

    Groups may be of any size.  Where a message ends depends on all items before, but
    a segment of ``segment_rows`` positions needs to know only how full the open
    message is on entry, and of that only with which item it overflows.  So each
    segment is first reduced to "overflow at item i -> state on exit" for the few
    items an open message can still take; these tables are chained along the group;
    then each segment is filled with its entry state known.
    """
    room = F.col("base") + F.col("size") > limit
    work = items.withColumn("segment", F.floor(F.col(pos) / F.lit(segment_rows)))
    flagged = work.groupBy(group).agg(F.max(room).alias("failed"))
    # Narrow rows, read by all three steps below.
    work = written(work.join(flagged, group), "sizes")
    good = work.where(~F.col("failed"))
    key = [group, "segment"]

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos)
        base = int(frame["base"].iloc[0])
        starts, total = _next_starts(frame["size"].tolist(), base, limit)
        n = len(starts)
        used, closed = [0] * n, [0] * n
        for i in range(n - 1, -1, -1):
            after = starts[i]
            used[i] = total[n] - total[i] if after >= n else used[after]
            closed[i] = 0 if after >= n else closed[after] + 1
        reach = bisect_right(total, limit - base + 1)
        return pd.DataFrame(
            {
                group: frame[group].iloc[0],
                "segment": frame["segment"].iloc[0],
                "base": base,
                "whole": total[n],
                "sums": [total[: min(reach, n) + 1]],
                "used": [used[: min(reach, n)]],
                "closed": [closed[: min(reach, n)]],
            }
        )

    kind = {f.name: f.dataType.simpleString() for f in items.schema.fields}
    shape = (
        f"{group} {kind[group]}, segment bigint, base bigint, whole bigint, sums array<bigint>,"
        " used array<bigint>, closed array<bigint>"
    )
    tables = good.select(group, "segment", pos, "base", "size").groupBy(*key).applyInPandas(exits, shape)

    def chain(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("segment")
        used, batch, rows = None, 0, []
        for row in frame.itertuples(index=False):
            rows.append((row[0], row.segment, -1 if used is None else used, batch))
            if used is None:
                used, batch = int(row.used[0]), batch + int(row.closed[0])
                continue
            free = limit - row.base + 1 - used
            first = bisect_right(list(row.sums), free) - 1
            if row.whole <= free:
                used += int(row.whole)
            else:
                used, batch = int(row.used[first]), batch + 1 + int(row.closed[first])
        return pd.DataFrame(rows, columns=[group, "segment", "entry", "batch0"])

    entry_shape = f"{group} {kind[group]}, segment bigint, entry bigint, batch0 bigint"
    entries = tables.groupBy(group).applyInPandas(chain, entry_shape)

    def fill(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(pos)
        base, entry = int(frame["base"].iloc[0]), int(frame["entry"].iloc[0])
        starts, total = _next_starts(frame["size"].tolist(), base, limit)
        batch = int(frame["batch0"].iloc[0])
        n, out = len(starts), []
        if entry < 0:
            cut = starts[0] if n else 0
        else:
            cut = min(bisect_right(total, limit - base + 1 - entry) - 1, n)
        out += [batch] * cut
        while cut < n:
            batch += 1
            out += [batch] * (min(starts[cut], n) - cut)
            cut = starts[cut]
        return pd.DataFrame({group: frame[group].to_numpy(), pos: frame[pos].to_numpy(), "batch": out})

    filled = (
        good.select(group, "segment", pos, "base", "size")
        .join(entries, key)
        .groupBy(*key)
        .applyInPandas(fill, f"{group} {kind[group]}, {pos} {kind[pos]}, batch bigint")
    )
    return work.drop("segment").join(filled, [group, pos], "left")


def deliver_order(messages: DataFrame) -> DataFrame:
    """Configuration order, then page order."""
    return messages.orderBy(*ORDER)


#: Order of messages: sources as configured, items as on the page.
ORDER = ("source_ord", "pos")


def numbered(df: DataFrame, order: Sequence[str] = ORDER, name: str = "cand_index") -> DataFrame:
    """Number of each row in the order of columns, from 0.

    Rows are dealt by ranges of the order, so a source with most of the rows lies in many tasks; only one small row
    for each range passes through one task.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = rows.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id())
    rows = written(rows, "ordered")
    ranges = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("_range", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_offset"))
    # As many rows as ranges, which are at most as many as shuffle partitions.
    return (
        rows.join(F.broadcast(offsets), "_range")
        .withColumn(name, F.col("_offset") + F.col("_place"))
        .drop("_range", "_place", "_offset")
    )
