"""Ordered work per key that no single key can hold up.

A window partitioned by user puts a whole user into one task, and one user may own a third of
the table. Both shapes here cut each key's time line into slices, do the window work inside a
slice, and add what the earlier slices of the same key carry over.

* ``range_slices`` sorts by (key, order) over all tasks and cuts by row count. It suits jobs
  that number or compare single rows: a hot key, even a hot instant, spreads over many slices.
* ``running_total_by_time`` cuts by time. It suits counts: rows are summed per (key, instant)
  before the shuffle, so a slice holds at most one row per millisecond of its width.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions.scalar import slice_number
from tidefeed.schema import MS_PER_DAY
from tidefeed.session import written

SLICE = "_slice"


def _sort(order: Sequence[str], descending: bool) -> list[Column]:
    return [F.desc(c) if descending else F.asc(c) for c in order]


def range_slices(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    descending: bool = False,
    slices: int | None = None,
) -> DataFrame:
    """``df`` with the number of its slice of the sort by ``key``, then by ``order``.

    ``order`` should end in a unique column, or copies of one row cannot be told apart and
    stay together. The result is written out: the cut points come from a sample, so a second
    evaluation might cut elsewhere, and every reader has to see the same slices.

    Without a number of slices Spark starts from ``spark.sql.shuffle.partitions`` and merges
    neighbours that are small.
    """
    sort = [F.asc(key), *_sort(order, descending)]
    ranged = df.repartitionByRange(slices, *sort) if slices else df.repartitionByRange(*sort)
    return written(ranged.withColumn(SLICE, F.spark_partition_id()), "slices")


def _crossings(sliced: DataFrame, key: str) -> DataFrame:
    """(slice, key) of each key that goes on into the next slice: at most one per slice.

    The table is sorted by key first, so a slice can share with the next one only the key it
    ends with. All other keys, which is nearly all of them, have nothing to carry.
    """
    # Null is a key too, and sorts first.
    low = F.when(F.count_if(F.col(key).isNull()) == 0, F.min(key))
    ends = sliced.groupBy(SLICE).agg(low.alias("_low"), F.max(key).alias("_high"))
    # One row per slice, so this window over all of them is small.
    following = F.lead(F.struct(SLICE, "_low")).over(Window.partitionBy(F.lit(0)).orderBy(SLICE))
    return (
        ends.withColumn("_next", following)
        .where(F.col("_next").isNotNull() & F.col("_high").eqNullSafe(F.col("_next._low")))
        .select(
            F.col(SLICE).alias("_cross_slice"),
            F.col("_high").alias("_cross_key"),
            F.col(f"_next.{SLICE}").alias("_into_slice"),
        )
    )


def _with_carry(
    local: DataFrame, sliced: DataFrame, key: str, summary: Column, carry: Column
) -> DataFrame:
    """``local`` with ``_carry``, what a slice receives from the earlier slices of its key.

    ``summary`` condenses one crossing (slice, key); ``carry`` is a window expression over the
    ``_summary`` of a key's slices up to and including the one handed on. Both tables that are
    broadcast here have at most one row per slice.
    """
    crossings = F.broadcast(_crossings(sliced, key))
    leaving = (F.col(SLICE) == F.col("_cross_slice")) & F.col(key).eqNullSafe(
        F.col("_cross_key")
    )
    handed_on = (
        sliced.join(crossings, leaving)
        .groupBy("_cross_slice", "_cross_key", "_into_slice")
        .agg(summary.alias("_summary"))
        .select("_into_slice", F.col("_cross_key").alias("_into_key"), carry.alias("_carry"))
    )
    arriving = (F.col(SLICE) == F.col("_into_slice")) & F.col(key).eqNullSafe(
        F.col("_into_key")
    )
    return local.join(F.broadcast(handed_on), arriving, "left")


def running_total(
    sliced: DataFrame,
    key: str,
    order: Sequence[str],
    value: Column,
    out: str,
    descending: bool = False,
) -> DataFrame:
    """Sum of ``value`` over this row and all earlier rows of its key.

    ``sliced`` comes from ``range_slices`` with the same key, order and direction.
    """
    inside = Window.partitionBy(SLICE, key).orderBy(*_sort(order, descending)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.withColumn("_local", F.sum(value).over(inside))
    so_far = Window.partitionBy("_cross_key").orderBy("_cross_slice").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    summed = _with_carry(local, sliced, key, F.sum(value), F.sum("_summary").over(so_far))
    total = F.col("_local") + F.coalesce("_carry", F.lit(0).cast("bigint"))
    return summed.select(*sliced.columns, total.alias(out))


def positions(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    out: str = "position",
    descending: bool = False,
) -> DataFrame:
    """Number the rows of each key from 1 in order."""
    sliced = range_slices(df, key, order, descending)
    one = F.lit(1).cast("bigint")
    return running_total(sliced, key, order, one, out, descending).drop(SLICE)


def previous_value(
    df: DataFrame, key: str, order: Sequence[str], value: str, out: str
) -> DataFrame:
    """``value`` of the row before this one in its key; null for the first row."""
    sliced = range_slices(df, key, order)
    inside = Window.partitionBy(SLICE, key).orderBy(*order)
    local = sliced.withColumns({
        "_local": F.lag(value).over(inside),
        "_first": F.row_number().over(inside) == 1,
    })
    last = F.max_by(value, F.struct(*order))
    paired = _with_carry(local, sliced, key, last, F.col("_summary"))
    previous = F.when(F.col("_first"), F.col("_carry")).otherwise(F.col("_local"))
    return paired.select(*df.columns, previous.alias(out))


def running_total_by_time(
    changes: DataFrame,
    key: str,
    time: str,
    value: str,
    out: str,
    slice_ms: int = MS_PER_DAY,
) -> DataFrame:
    """Per key and instant, the sum of ``value`` over all rows of the key up to that instant.

    Rows are summed per (key, instant) and per (key, slice), both with a map-side combine, so
    copies of one instant never travel. A (key, slice) group has at most ``slice_ms`` rows then,
    and a key's carry table at most one row per slice of the table's time span. ``rises`` counts
    the rows of the instant with a positive value. Rows without a key have no total.
    """
    changes = changes.where(F.col(key).isNotNull())
    instants = changes.groupBy(key, time).agg(
        F.sum(value).alias("_change"), F.count_if(F.col(value) > 0).alias("rises")
    )
    local = instants.withColumn(SLICE, slice_number(time, slice_ms)).withColumn(
        "_local",
        F.sum("_change").over(
            Window.partitionBy(key, SLICE).orderBy(time).rowsBetween(
                Window.unboundedPreceding, Window.currentRow
            )
        ),
    )
    earlier = Window.partitionBy(key).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        changes.groupBy(key, slice_number(time, slice_ms).alias(SLICE))
        .agg(F.sum(value).alias("_summary"))
        .select(key, SLICE, F.sum("_summary").over(earlier).alias("_carry"))
    )
    total = F.col("_local") + F.coalesce("_carry", F.lit(0).cast("bigint"))
    return local.join(carried, [key, SLICE]).select(key, time, "rises", total.alias(out))
