"""Replay removal for any delay: a stored table of the keys that have been taken in.

Keys lie in hash buckets under the micro-batch that brought them. A micro-batch reads only the buckets
that its own keys fall into, and a row whose key stands there is a replay, however late it comes. A row
that is late itself is kept. Rows and keys are written under the number of the micro-batch, and a
micro-batch that is run again looks only at those before it, so it decides as it did the first time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from tidefeed.functions.scalar import day_of
from tidefeed.streaming.ingest import AVAILABLE_NOW, write_batch
from tidefeed.streaming.maintain import drop_merged, merge_batches, read_streamed

BUCKETS = 256
KEY = ("user_id", "notify_id")
SEEN = StructType([
    StructField("user_id", StringType()), StructField("notify_id", StringType()), StructField("bucket", IntegerType())])


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*KEY), F.lit(buckets)).cast("int"))


def unseen(batch: DataFrame, seen: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The rows of ``batch`` with keys that ``seen`` does not hold, one row a key: the one written first.

    Null users and ids are part of a key like any other. The anti-join reads the touched buckets.
    """
    columns = [c for c in batch.columns if c not in KEY]
    first = batch.groupBy(*KEY).agg(F.min_by(F.struct(*columns), "ingest_seq").alias("_row"))
    once = with_bucket(first.select(*[c if c in KEY else F.col(f"_row.{c}").alias(c) for c in batch.columns]), buckets)
    touched = [row.bucket for row in with_bucket(batch.select(*KEY), buckets).select("bucket").distinct().collect()]
    known = seen.where(F.col("bucket").isin(touched)).select(*KEY, "bucket").distinct()
    same = F.col("b.bucket") == F.col("s.bucket")
    for name in KEY:
        same = same & F.col(f"b.{name}").eqNullSafe(F.col(f"s.{name}"))
    return once.alias("b").join(known.alias("s"), same, "left_anti")


def stream_dedup_seen(
    stream: DataFrame, path: str, seen_path: str, checkpoint: str, buckets: int = BUCKETS, trigger: dict | None = None
) -> StreamingQuery:
    """Store every event once, in day chunks under ``path``; its key goes to ``seen_path``.

    ``read_streamed`` and ``maintain.merge_batches`` work on ``path``, ``merge_seen`` on the keys.
    ``buckets`` must stay the same for one ``seen_path``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        before = read_streamed(batch.sparkSession, seen_path, SEEN, "bucket").where(F.col("batch_id") < batch_id)
        # Kept while both writes read it; a lost part is made again from files that nothing changes.
        fresh = unseen(batch, before, buckets).persist()
        try:
            chunked = fresh.drop("bucket").withColumn("day", day_of("timestamp")).hint("rebalance", "day")
            write_batch(chunked, path, batch_id, "day")
            write_batch(fresh.select(*KEY, "bucket").hint("rebalance", "bucket"), seen_path, batch_id, "bucket")
        finally:
            fresh.unpersist()

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )


def merge_seen(spark: SparkSession, seen_path: str, checkpoint: str) -> None:
    """Merge the keys of finished micro-batches, so that a bucket is few files. No stream may run meanwhile."""
    merge_batches(spark, seen_path, checkpoint, SEEN, chunk="bucket")
    drop_merged(spark, seen_path)
