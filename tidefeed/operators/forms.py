"""The other shapes a notification is stored in: points, tagged metrics, JSON records, cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.functions.scalar import (
    big_endian,
    long_of,
    row_key,
    strict_json_object,
    string_of,
)
from tidefeed.schema import INGESTED, MEASUREMENT, SALT_BUCKETS

POINT_KEYS = ("measurement", "user_id", "notify_id", "time")
# ---- fixed values -----------------------------------------------------------------
QUALIFIERS = ("notify_id", "user_id", "timestamp", "data")
# -----------------------------------------------------------------------------------


def _last_write(df: DataFrame) -> Column:
    """The value written last where the table says in which order, else any one."""
    return F.max_by("value", "ingest_seq") if "ingest_seq" in df.columns else F.first("value")


def _sequence(df: DataFrame) -> list[str]:
    return ["ingest_seq"] if "ingest_seq" in df.columns else []


def to_points(
    df: DataFrame, fields: Sequence[str] = ("data",), measurement: str = MEASUREMENT
) -> DataFrame:
    """Long form: one row per record and field."""
    wide = df.select(
        F.lit(measurement).alias("measurement"),
        "user_id",
        "notify_id",
        F.col("timestamp").alias("time"),
        *_sequence(df),
        *[F.col(f).cast("string").alias(f) for f in fields],
    )
    keys = [*POINT_KEYS, *_sequence(df)]
    return wide.unpivot(keys, list(fields), "field", "value").where(F.col("value").isNotNull())


def from_points(points: DataFrame, fields: Sequence[str] = ("data",)) -> DataFrame:
    """Back to one row per record; a field written twice has its last value.

    Naming the fields saves the pass that would look for them.
    """
    return (
        points.groupBy(*POINT_KEYS)
        .pivot("field", list(fields))
        .agg(_last_write(points))
        .withColumnRenamed("time", "timestamp")
    )


def point_filter(points: DataFrame, measurement: str, **tags: str) -> DataFrame:
    """Points of one measurement with all the given tag values."""
    kept = points.where(F.col("measurement") == measurement)
    for tag, value in tags.items():
        kept = kept.where(F.col(tag) == value)
    return kept


def to_tagged_metric(df: DataFrame, metric: str = MEASUREMENT) -> DataFrame:
    """Metric form: the value is the time itself, user and id are tags, the payload is gone."""
    return df.select(
        F.lit(metric).alias("metric"),
        "timestamp",
        F.col("timestamp").alias("value"),
        F.create_map(
            F.lit("user_id"), F.col("user_id"), F.lit("notify_id"), F.col("notify_id")
        ).alias("tags"),
    )


def from_tagged_metric(points: DataFrame) -> DataFrame:
    return points.select(
        F.col("tags")["user_id"].alias("user_id"),
        F.col("tags")["notify_id"].alias("notify_id"),
        "timestamp",
        F.lit(None).cast("string").alias("data"),
    )


def encode_record_json(df: DataFrame, metric: str = MEASUREMENT) -> DataFrame:
    """Tagged JSON form: the whole record is the value of the data point."""
    fields = [f.name for f in INGESTED.fields if f.name in df.columns]
    return df.select(
        F.lit(metric).alias("metric"),
        "user_id",
        "notify_id",
        "timestamp",
        *_sequence(df),
        F.to_json(F.struct(*fields)).alias("value"),
    )


def decode_record_json(points: DataFrame, value: str = "value") -> DataFrame:
    """The records inside the data points; unknown keys are ignored."""
    return points.select(F.from_json(value, INGESTED).alias("record")).select("record.*")


def records_to_cells(df: DataFrame, buckets: int = SALT_BUCKETS) -> DataFrame:
    """Cell form: one row per record and column, values as bytes."""
    key = row_key("user_id", "timestamp", buckets)
    values = {
        name: big_endian(name) if name == "timestamp" else F.col(name).cast("binary")
        for name in QUALIFIERS
    }
    cells = F.array(
        *[F.struct(F.lit(n).alias("qualifier"), v.alias("value")) for n, v in values.items()]
    )
    return df.select(key.alias("row_key"), *_sequence(df), F.inline(cells)).where(
        F.col("value").isNotNull()
    )


def cells_to_records(cells: DataFrame, strict: bool = False) -> DataFrame:
    """Back to one typed row per row key; the last write of a cell counts, a missing one is null."""
    wide = cells.groupBy("row_key").pivot("qualifier", list(QUALIFIERS)).agg(_last_write(cells))
    data: Column = string_of("data")
    return wide.select(
        string_of("user_id").alias("user_id"),
        string_of("notify_id").alias("notify_id"),
        long_of("timestamp").alias("timestamp"),
        (strict_json_object(data) if strict else data).alias("data"),
    )
