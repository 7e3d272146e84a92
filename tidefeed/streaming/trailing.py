"""Trailing event counts over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidefeed.functions.scalar import event_time
from tidefeed.operators.rollup import LEVELS, UNIT_MS, add_rollups, dyadic_rollup
from tidefeed.schema import COUNTER_SLICES
from tidefeed.streaming.ingest import AVAILABLE_NOW, write_batch


def slice_counts(
    stream: DataFrame,
    interval_ms: int,
    slices: int = COUNTER_SLICES,
    *,
    delay_seconds: int | None,
) -> DataFrame:
    """Events per user and slice of the interval.

    The state holds one number per user and slice. Sliding windows over the raw events would
    hold and update ``slices`` of them per event; ``trailing_windows`` adds them up on read.
    Slices that far behind the newest event leave the state; None, for a bounded stream, keeps
    them all.
    """
    if interval_ms < slices:
        raise ValueError("the interval needs at least a millisecond per slice")
    timed = stream.select("user_id", event_time("timestamp").alias("event_time"))
    if delay_seconds is not None:
        timed = timed.withWatermark("event_time", f"{delay_seconds} seconds")
    width = f"{interval_ms // slices} milliseconds"
    return (
        timed.groupBy(F.window("event_time", width).alias("slice"), "user_id")
        .agg(F.count("*").alias("events"))
        .select("user_id", F.unix_millis("slice.start").alias("slice_ms"), "events")
    )


def stream_trailing_count(
    counts: DataFrame,
    path: str,
    checkpoint: str,
    trigger: dict | None = None,
    output_mode: str = "update",
) -> StreamingQuery:
    """Store the counts that each micro-batch changed, under the batch's number.

    A stream that runs for long sets a delay in ``slice_counts`` and uses the ``append``
    mode: each slice is then written once, when the watermark has passed it.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    return (
        counts.writeStream.outputMode(output_mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def trailing_windows(
    spark: SparkSession, path: str, interval_ms: int, slices: int = COUNTER_SLICES
) -> DataFrame:
    """Events per user in every interval-long window that starts at a slice boundary."""
    width = interval_ms // slices
    latest = spark.read.parquet(path).groupBy("user_id", "slice_ms").agg(
        F.max_by("events", "batch_id").alias("events")
    )
    back = F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))
    return (
        latest.select("user_id", "slice_ms", "events", back.alias("_back"))
        .groupBy("user_id", (F.col("slice_ms") - F.col("_back") * width).alias("window_ms"))
        .agg(F.sum("events").alias("events"))
    )


def stream_rollup(
    stream: DataFrame, path: str, checkpoint: str, unit_ms: int = UNIT_MS, levels: int = LEVELS, trigger: dict | None = None
) -> StreamingQuery:
    """Store the dyadic roll-up of each micro-batch; counts add up, so no batch reads another's.

    Late rows count where they belong, and a repeated micro-batch replaces itself.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        write_batch(dyadic_rollup(batch, unit_ms, levels), path, batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def read_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The roll-up of everything the stream has taken in."""
    return add_rollups(spark.read.parquet(path))
