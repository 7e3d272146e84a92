"""Feed and log tables derived from the ``events`` table by plain arithmetic.

They give every operator input that grows with ``events``: ties, duplicates, bad rows and logs
are made from its rows, without random numbers and without the clock.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions.scalar import epoch_ms, floor_to, slice_number
from tidefeed.functions.ulid import random_halves, ulid
from tidefeed.schema import MS_PER_DAY, MS_PER_HOUR
from tidefeed.sources.notifications import load_notifications


def events(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/events.parquet")


def to_notifications(source: DataFrame) -> DataFrame:
    return load_notifications(
        source, "user_id", "event_id", "ts", "props", ingest_seq="event_id"
    )


def notifications(spark: SparkSession, folder: str) -> DataFrame:
    return to_notifications(events(spark, folder))


def hourly(feed: DataFrame) -> DataFrame:
    """Times cut to the hour: several rows of one user share a time."""
    return feed.withColumn("timestamp", floor_to("timestamp", MS_PER_HOUR))


def dirty(source: DataFrame) -> DataFrame:
    """Missing users, ids and payloads, and payloads that are not JSON objects."""
    renamed = source.select(
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.when(F.col("event_id") % 97 != 0, F.col("event_id")).alias("notify_id"),
        "ts",
        F.when(F.col("event_id") % 89 == 1, "{bad")
        .when(F.col("event_id") % 89 == 2, "[1]")
        .when(F.col("event_id") % 89 == 3, '{"k": 1, "k": 2}')
        .when(F.col("event_id") % 89 == 4, "{}")
        .when(F.col("event_id") % 89 == 5, '{"k": 1')
        .when(F.col("event_id") % 89 == 6, '{"k": 1} and more')
        .when(F.col("event_id") % 89 != 0, F.col("props"))
        .alias("data"),
        F.col("event_id").alias("ingest_seq"),
    )
    return load_notifications(renamed, "user_id", "notify_id", "ts", "data")


def large_payloads(feed: DataFrame) -> DataFrame:
    """Some payloads with deep nesting, long names and long numbers, whole and spoiled."""
    rest = F.col("ingest_seq") % 291
    texts = [
        """concat('{"k": 7, "a": ', repeat('[', 1200), repeat(']', 1200), '}')""",
        """concat('{"', repeat('n', 60000), '": 1, "k": 7}')""",
        """concat('{"x": ', repeat('9', 1500), ', "k": 7}')""",
        """concat('{"k": 7, "a": ', repeat('{"b":', 1100), '[]', repeat('}', 1100), '}')""",
        """concat('{"k": 7, "a": ', repeat('[', 1200), repeat(']', 1199), '}')""",
        """concat('{"', repeat('n', 60000), '": 1, "k": 7')""",
        """concat('{"x": 0', repeat('9', 1500), ', "k": 7}')""",
        """concat('{"x": ', repeat('9', 1500), '} {}')""",
    ]
    data = F.col("data")
    for number, text in enumerate(texts):
        data = F.when(rest == number, F.expr(text)).otherwise(data)
    return feed.withColumn("data", data)


def replayed(feed: DataFrame) -> DataFrame:
    """Every tenth row twice."""
    copies = F.when(F.col("ingest_seq") % 10 == 0, 2).otherwise(1)
    return feed.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")


def shared_ids(feed: DataFrame) -> DataFrame:
    """One id per user and day, so an id occurs at several times with different payloads."""
    day = slice_number("timestamp", MS_PER_DAY).cast("string")
    return feed.withColumn("notify_id", F.concat_ws("-", "user_id", day))


def operation_log(source: DataFrame) -> DataFrame:
    """One timed operation per event."""
    latency = F.round(F.col("value") * 100).cast("bigint")
    return source.select(
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("backend"),
        F.col("event_type").alias("phase"),
        epoch_ms(source, "ts").alias("start_ms"),
        latency.alias("latency_ms"),
        (epoch_ms(source, "ts") + latency).alias("end_ms"),
        (F.col("event_id") % 10 != 0).alias("ok"),
    )


def monitor_log(source: DataFrame) -> DataFrame:
    """One log document per event, some with a missing, textual or fractional ``size``."""
    rest = F.col("event_id") % 50
    k = F.get_json_object("props", "$.k")
    ms = epoch_ms(source, "ts")
    latency = F.round(F.col("value") * 100).cast("bigint")
    size = (
        F.when(rest == 0, F.lit(None).cast("string"))
        .when(rest == 1, F.concat(F.lit('"size":"'), k, F.lit('"')))
        .when(rest == 2, F.lit('"size":12.7'))
        .otherwise(F.concat(F.lit('"size":'), k))
    )
    requested = F.when(
        rest != 3, F.concat(F.lit('"requestedTimestamp":'), (ms - latency * 1000).cast("string"))
    )
    node = F.when(F.col("user_id") % 3 == 0, "other_").otherwise("node_")
    return source.select(
        F.col("event_id").cast("string").alias("requestID"),
        F.col("user_id").cast("string").alias("userID"),
        (F.col("user_id") % 10).cast("string").alias("groupID"),
        F.col("event_type").alias("step"),
        latency.alias("duration"),
        F.concat(node, (F.col("user_id") % 4).cast("string")).alias("nodeName"),
        ms.alias("timestamp"),
        F.concat(F.lit("{"), F.concat_ws(",", size, requested), F.lit("}")).alias("extension"),
    )


def ulids(feed: DataFrame) -> DataFrame:
    """One id per row; some are spoiled or written with look-alike characters."""
    hi, lo = random_halves(F.lit("id"), F.col("ingest_seq"))
    good = ulid("timestamp", hi, lo)
    rest = F.col("ingest_seq") % 40
    text = (
        F.when(rest == 0, F.substring(good, 1, 25))
        .when(rest == 1, F.concat(F.substring(good, 1, 25), F.lit("U")))
        .when(rest == 2, F.concat(F.lit("8"), F.substring(good, 2, 25)))
        .when(rest == 3, F.lower(good))
        .when(rest == 4, F.translate(good, "01", "OI"))
        .when(rest == 5, F.translate(good, "01", "ol"))
        .otherwise(good)
    )
    return feed.select("user_id", "ingest_seq", text.alias("ulid"))
