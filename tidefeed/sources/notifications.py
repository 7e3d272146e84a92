"""Reading and generating notification tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions.scalar import epoch_ms
from tidefeed.functions.ulid import random_halves, ulid
from tidefeed.schema import STORED


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """A stored feed table in the canonical schema.

    A ``day`` partition column is found in the directory names and kept for pruning.
    """
    return spark.read.schema(STORED).parquet(path)


def load_notifications(
    source: DataFrame,
    user_id: str = "user_id",
    notify_id: str = "notify_id",
    timestamp: str = "timestamp",
    data: str = "data",
    ingest_seq: str | None = "ingest_seq",
) -> DataFrame:
    """Any table with these columns, in the canonical schema.

    Times may be epoch milliseconds or timestamps with or without a zone.
    """
    kind = dict(source.dtypes)[timestamp]
    time = epoch_ms(source, timestamp) if kind.startswith("timestamp") else F.col(timestamp)
    sequence = F.col(ingest_seq) if ingest_seq else F.monotonically_increasing_id()
    return source.select(
        F.col(user_id).cast("string").alias("user_id"),
        F.col(notify_id).cast("string").alias("notify_id"),
        time.cast("bigint").alias("timestamp"),
        F.col(data).cast("string").alias("data"),
        sequence.cast("bigint").alias("ingest_seq"),
    )


def gen_notifications(
    rows: DataFrame, number: Column, at_ms: Column, users: int = 1000
) -> DataFrame:
    """One synthetic notification per input row.

    ``number`` seeds the user and the id, so the table is the same on every run.
    ``gen_range`` gives the input for a table of a wanted size.
    """
    seeded = rows.select(number.cast("bigint").alias("n"), at_ms.cast("bigint").alias("timestamp"))
    user, _ = random_halves(F.lit("user"), F.col("n"))
    hi, lo = random_halves(F.lit("id"), F.col("n"))
    return seeded.select(
        (user % users).cast("string").alias("user_id"),
        ulid("timestamp", hi, lo).alias("notify_id"),
        "timestamp",
        F.to_json(F.struct(F.lit("bar").alias("foo"))).alias("data"),
        F.col("n").alias("ingest_seq"),
    )


def gen_range(
    spark: SparkSession, n: int, start_ms: int, step_ms: int = 1, users: int = 1000
) -> DataFrame:
    """``n`` synthetic notifications, ``step_ms`` apart from ``start_ms`` on."""
    at_ms = F.lit(start_ms).cast("bigint") + F.col("id") * step_ms
    return gen_notifications(spark.range(n), F.col("id"), at_ms, users)
