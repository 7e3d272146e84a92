"""Streaming writes: validated append, last write wins, and replay removal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from tidefeed.functions.scalar import day_of, event_time
from tidefeed.operators.identity import BY_TIME, upsert_latest
from tidefeed.operators.validate import validate_split
from tidefeed.schema import TTL_SECONDS
from tidefeed.streaming.maintain import read_streamed

# Take in all that is there, in micro-batches, and stop. A service passes its own trigger,
# such as {"processingTime": "1 second"}.
AVAILABLE_NOW = {"availableNow": True}


def read_files(
    spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100
) -> DataFrame:
    """A stream over the Parquet files of a folder or glob, at most so many per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def run_available(query: StreamingQuery) -> StreamingQuery:
    """Wait for an ``availableNow`` query to take in what is there."""
    query.awaitTermination()
    return query


def write_batch(df: DataFrame, path: str, batch_id: int, *partitions: str) -> None:
    """Write one micro-batch under its own number.

    A batch that is run again after a failure replaces exactly its own earlier output.
    """
    (
        df.withColumn("batch_id", F.lit(batch_id).cast("bigint"))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("batch_id", *partitions)
        .parquet(path)
    )


def stream_ingest(
    stream: DataFrame, path: str, rejected_path: str, checkpoint: str, trigger: dict | None = None,
    stamp: Callable[[DataFrame], DataFrame] | None = None,
) -> StreamingQuery:
    """Append valid rows in day chunks and put the others, with their reason, aside.

    The commit of a micro-batch is the acknowledgement of its rows. No watermark is set:
    a late write is still a write. ``stamp`` may add columns to each micro-batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        # Kept while both writes read it; a lost part is read from its files again.
        batch = (stamp(batch) if stamp else batch).persist()
        try:
            valid, rejected = validate_split(batch)
            chunked = valid.withColumn("day", day_of("timestamp")).hint("rebalance", "day")
            write_batch(chunked, path, batch_id, "day")
            write_batch(rejected, rejected_path, batch_id)
        finally:
            batch.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def latest_view(spark: SparkSession, path: str, identity: tuple[str, ...] = BY_TIME) -> DataFrame:
    """The rows of an ingested log after the last write per identity has won.

    A later micro-batch wins over an earlier one, and ``ingest_seq`` decides inside a batch. Segments
    that ``maintain.merge_batches`` has made by the same identity hold one row of it each.
    """
    log = read_streamed(spark, path)
    ranked = log.withColumn("_write", F.struct("batch_id", "ingest_seq"))
    return upsert_latest(ranked, identity, "_write").drop("_write", "batch_id")


def stream_dedup(stream: DataFrame, delay_seconds: int = TTL_SECONDS) -> DataFrame:
    """Drop replays of the same (user, id), keeping the one that arrives first.

    State is kept for ``delay_seconds`` behind the newest event time; a row later than that
    is dropped, and the query progress counts it as ``numRowsDroppedByWatermark``.
    """
    return (
        stream.withColumn("event_time", event_time("timestamp"))
        .withWatermark("event_time", f"{delay_seconds} seconds")
        .dropDuplicatesWithinWatermark(["user_id", "notify_id"])
        .drop("event_time")
    )


def dropped_by_watermark(query: StreamingQuery) -> int:
    """Rows that a finished query dropped for being too late."""
    return sum(
        operator.numRowsDroppedByWatermark
        for progress in query.recentProgress
        for operator in progress.stateOperators
    )


def append_stream(
    stream: DataFrame, path: str, checkpoint: str, trigger: dict | None = None
) -> StreamingQuery:
    """Write a stream to Parquet exactly once."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
