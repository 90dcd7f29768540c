"""Looking back along an order when one key may hold a large part of all rows.

A plain window puts all rows of a key into one task.  Here the rows of a key are cut
into segments of the order; windows only run inside segments, and one small row per
(key, segment) carries the state from segment to segment.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEFORE = (Window.unboundedPreceding, -1)
UP_TO = (Window.unboundedPreceding, 0)


def carry_forward(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    segment: str,
    values: dict[str, Column],
    include_row: bool = False,
) -> DataFrame:
    """Add the last non-NULL value of each expression among the earlier rows of the key.

    ``segment`` is a column that grows with ``order``; each (key, segment) should be
    a moderate number of rows.  ``order`` must be unique within a key.
    """
    inside = Window.partitionBy(*keys, segment).orderBy(order).rowsBetween(*(UP_TO if include_row else BEFORE))
    work = df.select("*", *[v.alias(f"_v_{n}") for n, v in values.items()])
    ends = work.groupBy(*keys, segment).agg(
        *[
            F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), F.col(order))).alias(f"_e_{n}")
            for n in values
        ]
    )
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(*BEFORE)
    carried = ends.select(
        *keys, segment, *[F.last(f"_e_{n}", ignorenulls=True).over(across).alias(f"_c_{n}") for n in values]
    )
    local = work.select(
        *df.columns, *[F.last(f"_v_{n}", ignorenulls=True).over(inside).alias(f"_l_{n}") for n in values]
    )
    # Both sides are spread by (key, segment); the carried side has one row for each.
    return local.join(carried, [*keys, segment], "left").select(
        *df.columns, *[F.coalesce(f"_l_{n}", f"_c_{n}").alias(n) for n in values]
    )


def running_total(
    df: DataFrame, keys: Sequence[str], order: str, segment: str, name: str, value: Column
) -> DataFrame:
    """Add the sum of ``value`` over the rows of the key up to and including this one."""
    inside = Window.partitionBy(*keys, segment).orderBy(order).rowsBetween(*UP_TO)
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(*BEFORE)
    work = df.withColumn("_v", value)
    carried = (
        work.groupBy(*keys, segment)
        .agg(F.sum("_v").alias("_s"))
        .select(*keys, segment, F.sum("_s").over(across).alias("_c"))
    )
    local = work.select(*df.columns, F.sum("_v").over(inside).alias("_l"))
    return local.join(carried, [*keys, segment], "left").select(
        *df.columns, (F.coalesce("_l", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias(name)
    )


def nearest_preceding(
    df: DataFrame, keys: Sequence[str], order: str, segment: str, is_mark: Column, marks: dict[str, Column]
) -> DataFrame:
    """As-of lookup inside one frame: values of the nearest earlier marked row of the key."""
    return carry_forward(
        df, keys, order, segment, {n: F.when(is_mark, v) for n, v in marks.items()}
    )


def inferred_years(
    df: DataFrame, keys: Sequence[str], order: str, segment: str, year: str, month: str, start: str | None = None
) -> DataFrame:
    """Years of dates without one, newest first (column ``inferred_year``).

    From January or February down to October or later a year passes.  An explicit
    ``year`` starts anew; ``start`` is the year known before the first row, and
    without either the year stays NULL.  Rows are valid dates; rows without a month
    do not count.
    """
    # Rows meet inside their segment once; what a segment does to the years behind it is one small row: how many
    # years pass in it, its last month, its last known year, and whether its first month may be a boundary.
    inside = Window.partitionBy(*keys, segment).orderBy(order)
    above, so_far = inside.rowsBetween(*BEFORE), inside.rowsBetween(*UP_TO)
    falls = F.col(year).isNull() & (F.col(month) >= 10)
    rows = (
        df.withColumn("_above", F.last(month, ignorenulls=True).over(above))
        .withColumn("_fresh", F.col("_above").isNull() & F.col(month).isNotNull())
        .withColumn("_passed", F.sum((falls & (F.col("_above") <= 2)).cast("int")).over(so_far))
        # From the first month of the segment on, a boundary between the segments counts as well.
        .withColumn("_begun", F.max(F.col("_fresh").cast("int")).over(so_far))
        .withColumn("_state", F.struct(F.col(year).alias("y"), F.coalesce("_passed", F.lit(0)).alias("p"), F.col("_begun").alias("b")))
        .withColumn("_anchor", F.last(F.when(F.col(year).isNotNull(), F.col("_state")), ignorenulls=True).over(so_far))
    )
    across = Window.partitionBy(*keys).orderBy(segment).rowsBetween(*BEFORE)
    carried = (
        rows.groupBy(*keys, segment)
        .agg(
            F.coalesce(F.max("_passed"), F.lit(0)).alias("_years"),
            F.max_by(month, F.when(F.col(month).isNotNull(), F.col(order))).alias("_month"),
            F.max_by("_anchor", order).alias("_known"),
            F.bool_or(F.col("_fresh") & falls).alias("_open"),
        )
        .withColumn("_edge", (F.col("_open") & (F.last("_month", ignorenulls=True).over(across) <= 2)).cast("int"))
        .withColumn("_edge", F.coalesce("_edge", F.lit(0)))
        .withColumn("_before", F.coalesce(F.sum(F.col("_years") + F.col("_edge")).over(across), F.lit(0)))
        .withColumn(
            "_since",
            F.last(
                F.when(
                    F.col("_known").isNotNull(),
                    F.struct(F.col("_known.y").alias("y"), (F.col("_before") + F.col("_known.p") + F.col("_known.b") * F.col("_edge")).alias("p")),
                ),
                ignorenulls=True,
            ).over(across),
        )
        .select(*keys, segment, "_edge", "_before", "_since")
    )
    base = F.col(start) if start else F.lit(None).cast("int")
    passed = F.col("_state.p") + F.col("_begun") * F.col("_edge")
    inferred = F.coalesce(
        F.col("_anchor.y") - (passed - F.col("_anchor.p") - F.col("_anchor.b") * F.col("_edge")),
        F.col("_since.y") - (F.col("_before") + passed - F.col("_since.p")),
        base - F.col("_before") - passed,
    )
    # Rows stay where they are; only the small side is dealt to them.
    return rows.join(carried, [*keys, segment], "left").select(*df.columns, inferred.cast("int").alias("inferred_year"))
