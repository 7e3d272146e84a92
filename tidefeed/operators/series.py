"""Points by the number of their series: a dictionary of tag sets beside narrow points.

A series is a set of tags (measurement, user, id; null is a value like others). The dictionary numbers
series densely from 1 and only ever grows: a later load keeps all numbers and appends its new sets in
the order of their tags. New sets are numbered by position in a range-partitioned sort, so no task
orders them all.

A store is a folder with ``series/load-<n>`` (a load's new sets) and ``points`` (series_id and what is
left of a point, cut by ranges of series and time, so that a scan for a few series skips the rest).
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidefeed.plans.ordered import positions
from tidefeed.session import numbered_folders, written

KEYS = ("measurement", "user_id", "notify_id")
SERIES = StructType([StructField("series_id", LongType()), *[StructField(k, StringType()) for k in KEYS]])
#: Bytes of tags up to which a dictionary is broadcast whole.
BROADCAST_BYTES = 32 << 20
#: A key is hot if it has more than 1 / HOT_SHARE of all rows, so there are fewer hot keys than this.
HOT_SHARE = 1000


def _equal(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])


def _renamed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_of_{k}" for k in keys})


def new_series(points: DataFrame, known: DataFrame | None = None, keys: Sequence[str] = KEYS) -> DataFrame:
    """(series_id, tags) of the tag sets of ``points`` that ``known`` lacks.

    They are numbered in the order of their tags, from one past the last known number.
    """
    fresh, last = points.select(*keys).distinct(), 0
    if known is not None:
        last = known.agg(F.max("series_id")).first()[0] or 0
        fresh = fresh.join(_renamed(known.select(*keys), keys), _equal(keys), "left_anti")
    numbered = positions(fresh.withColumn("_all", F.lit(0)), "_all", list(keys), "_position")
    return numbered.select((F.col("_position") + last).alias("series_id"), *keys)


def _looked_up(rows: DataFrame, entries: DataFrame, keys: Sequence[str], limit: int) -> DataFrame:
    """``rows`` with the entry of their keys; an entry's keys are unique.

    A dictionary of few bytes is broadcast. Beyond that, rows of hot keys meet a broadcast table of
    fewer than ``HOT_SHARE`` entries, and only the others are shuffled.
    """
    entries = _renamed(entries, keys)
    drop = [f"_of_{k}" for k in keys]
    size = reduce(lambda a, b: a + b, [F.coalesce(F.octet_length(F.col(f.name).cast("string")), F.lit(0)) + 8
                                       for f in entries.schema.fields])
    if (entries.agg(F.sum(size)).first()[0] or 0) <= limit:
        return rows.join(F.broadcast(entries), _equal(keys)).drop(*drop)
    counts = written(rows.groupBy(*keys).agg(F.count("*").alias("_rows")), "series-counts")
    total = counts.agg(F.sum("_rows")).first()[0] or 0
    hot = counts.where(F.col("_rows") * HOT_SHARE > total).drop("_rows")
    hot = written(entries.join(F.broadcast(hot), _equal(keys), "left_semi"), "series-hot")
    names = F.broadcast(hot.select(*drop))
    often = rows.join(F.broadcast(hot), _equal(keys))
    seldom = rows.join(names, _equal(keys), "left_anti").join(entries, _equal(keys))
    return often.unionByName(seldom).drop(*drop)


def encode_points(points: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``points`` with the number of their series in place of their tags."""
    rest = [c for c in points.columns if c not in keys]
    return _looked_up(points, series, keys, limit).select("series_id", *rest)


def decode_points(coded: DataFrame, series: DataFrame, keys: Sequence[str] = KEYS, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Points with their tags again."""
    rest = [c for c in coded.columns if c != "series_id"]
    return _looked_up(coded, series, ["series_id"], limit).select(*keys, *rest)


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """The dictionary of a store, empty before the first load."""
    loads = numbered_folders(spark, f"{path}/series", "load-")
    if not loads:
        return spark.createDataFrame([], SERIES)
    return spark.read.schema(SERIES).parquet(*[f"{path}/series/load-{n}" for n in loads])


def append_points(points: DataFrame, path: str) -> None:
    """Add points to a store, and before them the series that it does not have.

    One writer at a time. A load that failed between the two steps may be repeated: its series are
    known then and keep their numbers. A load that ended adds its points again, as any append.
    """
    spark = points.sparkSession
    known = read_series(spark, path)
    fresh = written(new_series(points, known), "series-new")
    if not fresh.isEmpty():
        loads = numbered_folders(spark, f"{path}/series", "load-")
        load = loads[-1] + 1 if loads else 0
        fresh.write.mode("overwrite").parquet(f"{path}/series/load-{load}")
    coded = encode_points(points, known.unionByName(fresh))
    order = ["series_id", "time"]
    coded.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("append").parquet(f"{path}/points")


def points_of(spark: SparkSession, path: str, limit: int = BROADCAST_BYTES, **tags: str) -> DataFrame:
    """Stored points, with their tags, of the series that have all the given tag values."""
    series = read_series(spark, path)
    for tag, value in tags.items():
        series = series.where(F.col(tag) == value)
    coded = spark.read.parquet(f"{path}/points")
    low, high = series.agg(F.min("series_id"), F.max("series_id")).first()
    # The bounds reach the scan; an empty dictionary leaves nothing.
    return decode_points(coded.where(F.col("series_id").between(F.lit(low), F.lit(high))), series, limit=limit)
