"""The newest page of every user, kept up to date while writes go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.query import StreamingQuery

from tidefeed.operators.feed import DESC, page
from tidefeed.schema import INGESTED, PAGE_SIZE
from tidefeed.session import numbered_folders
from tidefeed.streaming.ingest import AVAILABLE_NOW


def _current(spark: SparkSession, path: str, as_of_batch: int | None = None) -> DataFrame:
    """Rows of the newest full feed and of the batches after it.

    With ``as_of_batch``, what that batch may build on: full feeds of earlier batches only,
    so that a repeated batch does not read the full feed it is about to replace.
    """
    full = numbered_folders(spark, path, "full-")
    batches = numbered_folders(spark, path, "batch-")
    if as_of_batch is not None:
        full = [n for n in full if n < as_of_batch]
        batches = [n for n in batches if n <= as_of_batch]
    base = full[-1] if full else -1
    folders = [f"{path}/full-{base}"] if full else []
    folders += [f"{path}/batch-{n}" for n in batches if n > base]
    return spark.read.schema(INGESTED).parquet(*folders)


def drop_folded(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Delete what the oldest of the newest ``keep`` full feeds has taken in, when no reader is left on it."""
    full = numbered_folders(spark, path, "full-")
    if len(full) < keep:
        return
    base = full[-keep]
    old = [f"full-{n}" for n in full if n < base]
    old += [f"batch-{n}" for n in numbered_folders(spark, path, "batch-") if n <= base]
    for name in old:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def read_top_feed(spark: SparkSession, path: str, limit: int = PAGE_SIZE) -> DataFrame:
    """The newest ``limit`` rows of every user."""
    return page(_current(spark, path), DESC, None, limit)


def stream_top_feed(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    limit: int = PAGE_SIZE,
    fold_every: int = 32,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep each user's newest ``limit`` rows.

    A micro-batch stores only its own newest rows, so its cost follows the batch and not the
    number of users. Every ``fold_every`` batches a full feed is written beside the older
    ones, and what the full feed before that had taken in goes: readers have ``fold_every`` batches of
    time, and no more than two full feeds and twice as many batches are ever listed. Nothing is
    overwritten while it is read, and a repeated batch writes the same folder.
    """

    def newest(df: DataFrame) -> DataFrame:
        return page(df, DESC, None, limit, keep=("ingest_seq",)).drop("rank")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest(batch).write.mode("overwrite").parquet(f"{path}/batch-{batch_id}")
        if (batch_id + 1) % fold_every == 0:
            full = newest(_current(spark, path, as_of_batch=batch_id))
            full.write.mode("overwrite").parquet(f"{path}/full-{batch_id}")
            drop_folded(spark, path, keep=2)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or AVAILABLE_NOW))
        .start()
    )
