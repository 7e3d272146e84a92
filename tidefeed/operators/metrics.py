"""Counts per instant, latency summaries, and trailing event counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions.scalar import format_duration, slice_number, whole_div
from tidefeed.operators.percentiles import exact_percentiles
from tidefeed.plans.ordered import running_total_by_time
from tidefeed.schema import COUNTER_SLICES


# Slices of one user that are counted together.
SLICES_IN_BLOCK = 4096


def points_per_timestamp(df: DataFrame) -> DataFrame:
    """Number of rows per user and millisecond."""
    return df.groupBy("user_id", "timestamp").agg(F.count("*").alias("n"))


def latency_summary(log: DataFrame, *by: str) -> DataFrame:
    """Average latency per group, in whole milliseconds.

    ``avg_ms`` divides the time of the successes by all attempts; ``avg_ok_ms`` divides it by
    the successes alone, and is null where there are none. ``p50_ok_ms`` and ``p95_ok_ms`` are
    the least latencies that half and 95 of 100 successes do not exceed, found by selection, so that
    no task holds all latencies of a group.
    """
    tails = exact_percentiles(log.where("ok"), by, "latency_ms", (50, 95))
    total = F.sum(F.when(F.col("ok"), F.col("latency_ms")).otherwise(F.lit(0).cast("bigint")))
    good = F.count_if("ok")
    summed = (
        log.groupBy(*by)
        .agg(
            F.count("*").alias("attempts"),
            (F.count("*") - good).alias("failures"),
            whole_div(total, F.count("*")).alias("avg_ms"),
            F.when(good > 0, whole_div(total, F.greatest(good, F.lit(1)))).alias("avg_ok_ms"),
        )
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(f"s.{c}").eqNullSafe(F.col(f"t.{c}"))
    return summed.alias("s").join(tails.alias("t"), same, "left").select(
        "s.*", F.col("t.p50").alias("p50_ok_ms"), F.col("t.p95").alias("p95_ok_ms"), format_duration("avg_ms").alias("avg_text"))


def elapsed_summary(log: DataFrame, *by: str) -> DataFrame:
    """Time from the first start to the last end of each group."""
    spent = log.groupBy(*by).agg((F.max("end_ms") - F.min("start_ms")).alias("elapsed_ms"))
    return spent.withColumn("elapsed_text", format_duration("elapsed_ms"))


def phase_has_error(log: DataFrame, *by: str) -> DataFrame:
    return log.groupBy(*by).agg(F.bool_or(~F.col("ok")).alias("has_error"))


def trailing_count_exact(df: DataFrame, interval_ms: int) -> DataFrame:
    """Per user and instant with an event, the events of the last ``interval_ms``, ends included.

    An event counts up when it happens and down when it leaves the interval, so the trailing
    count is a running total. A sliding window frame would go over the whole interval again
    for every row.
    """
    if interval_ms <= 0:
        raise ValueError("the interval must be positive")
    up = F.struct(F.col("timestamp").alias("at"), F.lit(1).cast("bigint").alias("step"))
    down = F.struct(
        (F.col("timestamp") + interval_ms + 1).alias("at"), F.lit(-1).cast("bigint").alias("step")
    )
    changes = df.select("user_id", F.inline(F.array(up, down)))
    totals = running_total_by_time(changes, "user_id", "at", "step", "trailing_count")
    return totals.where(F.col("rises") > 0).select(
        "user_id", F.col("at").alias("timestamp"), F.col("rises").alias("n"), "trailing_count"
    )


def trailing_count_sliced(
    df: DataFrame, interval_ms: int, slices: int = COUNTER_SLICES
) -> DataFrame:
    """The same count from ``slices`` slices of the interval, as a counter would keep it.

    All full slices in reach, plus the current one so far, less the share of the oldest that
    the current slice has already pushed out, rounded towards zero. Slices start at multiples
    of their width. Rows without a user have no counter.
    """
    if interval_ms < slices or slices < 1:
        raise ValueError("the interval must be positive and have at least a millisecond per slice")
    df = df.where(F.col("user_id").isNotNull())
    width = interval_ms // slices
    instants = df.groupBy("user_id", "timestamp").agg(F.count("*").alias("n")).withColumn(
        "_slice", slice_number("timestamp", width)
    )
    so_far = Window.partitionBy("user_id", "_slice").orderBy("timestamp").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    current = instants.withColumn("_current", F.sum("n").over(so_far))

    # A user has one row per slice of the time span here, however many events it has. Slices are
    # dealt to blocks of time, with those that reach into the next block in both.
    number = F.col("_slice")
    block = slice_number("_slice", SLICES_IN_BLOCK)
    reaching = slice_number(number + slices, SLICES_IN_BLOCK)
    per_slice = (
        df.groupBy("user_id", slice_number("timestamp", width).alias("_slice"))
        .agg(F.count("*").alias("_events"))
        .withColumn("_block", F.explode(F.sequence(block, reaching)))
    )
    history = Window.partitionBy("user_id", "_block").orderBy("_slice")
    past = per_slice.select(
        "user_id",
        "_slice",
        "_block",
        F.sum("_events").over(history.rangeBetween(-slices, -1)).alias("_full"),
        F.sum("_events").over(history.rangeBetween(-slices, -slices)).alias("_oldest"),
    ).where(F.col("_block") == block).drop("_block")
    zero = F.lit(0).cast("bigint")
    full, oldest = F.coalesce("_full", zero), F.coalesce("_oldest", zero)
    gone = (F.col("timestamp") - F.col("_slice") * width) * slices / F.lit(float(interval_ms))
    pushed_out = (oldest * gone).cast("bigint")
    return current.join(past, ["user_id", "_slice"]).select(
        "user_id", "timestamp", "n", (full + F.col("_current") - pushed_out).alias("trailing_count")
    )
