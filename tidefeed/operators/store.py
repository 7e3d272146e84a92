"""Writing, keeping and dropping stored rows.

A stored feed is a Parquet folder with one directory per day (``day=2024-01-31``).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions.scalar import day_of, row_key, salt_bucket
from tidefeed.operators.identity import BY_TIME, upsert_latest
from tidefeed.operators.validate import validate_split
from tidefeed.plans.pruning import FIRST_DAY, time_range
from tidefeed.schema import (
    CHUNK_RETENTION_DAYS,
    MS_PER_DAY,
    MS_PER_SECOND,
    SALT_BUCKETS,
    STORED,
    TTL_SECONDS,
)


def with_day(df: DataFrame) -> DataFrame:
    """Adds the day chunk of each row."""
    return df.withColumn("day", day_of("timestamp"))


def append(df: DataFrame, path: str) -> None:
    """Append rows to a stored feed, in day chunks.

    The rebalance hint gathers a day's rows into few files, and lets Spark split a day that
    is too large for one task; a plain repartition by day would not.
    """
    with_day(df).hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)


def bootstrap(df: DataFrame, path: str) -> None:
    """Empty the stored feed and fill it with these rows."""
    whole = with_day(df).hint("rebalance", "day").write.mode("overwrite")
    whole.option("partitionOverwriteMode", "static").partitionBy("day").parquet(path)


def append_validated(df: DataFrame, path: str, rejected_path: str) -> None:
    """Append the valid rows, and the others with their reason beside them."""
    valid, rejected = validate_split(df)
    append(valid, path)
    rejected.write.mode("append").parquet(rejected_path)


def compact_days(spark: SparkSession, path: str, days: Sequence[dt.date],
                 identity: Sequence[str] = BY_TIME) -> None:
    """Keep only the last write per identity in the given day chunks.

    The identity includes the time, so copies always share a day. The kept rows are appended
    first, and then exactly the files that were read are deleted: what others append meanwhile
    stays, and after a failure in between some rows are there twice, which the next run mends.
    """
    folders = [f"{path}/day={day.isoformat()}" for day in days]
    present = [folder for folder in folders if _exists(spark, folder)]
    if not present:
        return
    chosen = spark.read.schema(STORED).option("basePath", path).parquet(*present)
    read = chosen.inputFiles()
    kept = upsert_latest(chosen, [*identity, "day"])
    kept.hint("rebalance", "day").write.mode("append").partitionBy("day").parquet(path)
    for name in read:
        _delete_file(spark, name)


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def truncate(spark: SparkSession, path: str) -> None:
    """Remove all rows; the empty table keeps its columns."""
    schema = spark.read.parquet(path).schema
    empty = spark.createDataFrame([], schema).write.mode("overwrite")
    empty.option("partitionOverwriteMode", "static").parquet(path)


def retain_ttl(
    df: DataFrame, as_of: int, ttl_seconds: int = TTL_SECONDS, basis: str = "timestamp"
) -> DataFrame:
    """Rows no older than the TTL; ``basis`` names the time that ages, event or ingest.

    On a table in day chunks only the chunks that the TTL reaches are read.
    """
    oldest = as_of - ttl_seconds * MS_PER_SECOND
    if basis == "timestamp":
        return time_range(df, lower=oldest)
    return df.where(F.col(basis) >= oldest)


def _delete_file(spark: SparkSession, name: str) -> None:
    file = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(name))
    file.getFileSystem(spark._jsc.hadoopConfiguration()).delete(file, False)


#: Where rows that stay of expiring files wait; Spark's readers pass over such names.
EXPIRING = "_expiring-"


def expire_rows(spark: SparkSession, path: str, as_of: int, ttl_seconds: int = TTL_SECONDS,
                basis: str = "ingested_ms") -> tuple[list[str], list[str]]:
    """Remove the rows older than the TTL from a stored feed; ``basis`` is the column that ages.

    Returns (files deleted whole, files rewritten). Each file's least and greatest time say which: only
    the column ``basis`` is read of all files, other columns only of files with both old and young
    rows, and a file without old rows is not touched. Rows without a time stay.

    The rows that stay are written aside, then the list of the files they come from; from then on the
    step is sure to be done. After a failure some rows may be there twice until the next run, which
    first ends what was begun. Only one expiry of a table may run at a time; writers may go on.
    """
    _end_expiry(spark, path)
    schema = spark.read.parquet(path).schema
    stored = spark.read.schema(schema).parquet(path)
    oldest = as_of - ttl_seconds * MS_PER_SECOND
    old = F.col(basis) < oldest
    # One row per file that holds old rows.
    ages = stored.select(F.col("_metadata.file_path").alias("file"), F.coalesce(old, F.lit(False)).alias("old")).groupBy("file").agg(
        F.bool_and("old").alias("whole"), F.bool_or("old").alias("some"))
    found = ages.where("some").collect()
    gone = sorted(row.file for row in found if row.whole)
    mixed = sorted(row.file for row in found if not row.whole)
    if not found:
        return [], []
    aside = f"{path}/{EXPIRING}{uuid.uuid4().hex}"
    if mixed:
        young = spark.read.schema(schema).option("basePath", path).parquet(*mixed).where(~F.coalesce(old, F.lit(False)))
        young.hint("rebalance", "day").write.partitionBy("day").parquet(f"{aside}/rows")
    # The marker that this write leaves makes the step sure.
    spark.createDataFrame([(file,) for file in gone + mixed], "file string").write.parquet(f"{aside}/files")
    _end_expiry(spark, path)
    return gone, mixed


def _end_expiry(spark: SparkSession, path: str) -> None:
    """Bring in the rows of every expiry that is sure, delete the files they come from; drop the others."""
    fs = spark._jvm.org.apache.hadoop.fs
    folder = fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        aside = status.getPath()
        if not aside.getName().startswith(EXPIRING):
            continue
        if files.exists(fs.Path(aside, "files/_SUCCESS")):
            rows = fs.Path(aside, "rows")
            days = [s.getPath() for s in files.listStatus(rows) if s.isDirectory()] if files.exists(rows) else []
            for day in days:
                files.mkdirs(fs.Path(folder, day.getName()))
                for part in files.listStatus(day):
                    files.rename(part.getPath(), fs.Path(fs.Path(folder, day.getName()), part.getPath().getName()))
            for row in spark.read.parquet(fs.Path(aside, "files").toString()).collect():
                _delete_file(spark, row.file)
        files.delete(aside, True)


def first_kept_day(as_of: int, keep_days: int = CHUNK_RETENTION_DAYS) -> dt.date:
    """The oldest day chunk that reaches past ``as_of`` minus the retention."""
    return FIRST_DAY + dt.timedelta(days=(as_of - keep_days * MS_PER_DAY) // MS_PER_DAY)


def retain_chunks(
    df: DataFrame, as_of: int, keep_days: int = CHUNK_RETENTION_DAYS
) -> DataFrame:
    """Rows of the day chunks that are not wholly older than the retention."""
    chunked = df if "day" in df.columns else with_day(df)
    return chunked.where(F.col("day") >= F.lit(first_kept_day(as_of, keep_days)))


def drop_chunks(
    spark: SparkSession, path: str, as_of: int, keep_days: int = CHUNK_RETENTION_DAYS
) -> list[str]:
    """Delete the directories of the chunks that ``retain_chunks`` leaves out.

    Only directory names are read, never rows.
    """
    oldest = f"day={first_kept_day(as_of, keep_days).isoformat()}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for status in files.listStatus(folder):
        name = status.getPath().getName()
        if name.startswith("day=") and name < oldest:
            files.delete(status.getPath(), True)
            dropped.append(name)
    return sorted(dropped)


def day_chunks(df: DataFrame) -> DataFrame:
    """What each day chunk holds."""
    return with_day(df).groupBy(F.col("day").cast("string").alias("day")).agg(
        F.count("*").alias("rows"),
        F.min("timestamp").alias("first_ms"),
        F.max("timestamp").alias("last_ms"),
    )


def with_row_key(df: DataFrame, buckets: int = SALT_BUCKETS) -> DataFrame:
    """Adds the salt of the user and the binary row key."""
    return df.withColumn("salt", salt_bucket("user_id", buckets)).withColumn(
        "row_key", row_key("user_id", "timestamp", buckets)
    )


def write_salted(df: DataFrame, path: str, buckets: int = SALT_BUCKETS) -> None:
    """Store rows in key order, one directory per salt.

    The range partitioning cuts the key order by row count, so neither the number of salts
    nor a large user limits how many tasks write, and each file covers a narrow key range
    that its min/max statistics describe.
    """
    (
        with_row_key(df, buckets)
        .repartitionByRange("salt", "row_key", "ingest_seq")
        .sortWithinPartitions("salt", "row_key")
        .write.mode("append")
        .partitionBy("salt")
        .parquet(path)
    )
