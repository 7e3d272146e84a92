"""Replays of any delay: every distinct event once, however it arrives."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidefeed.schema import INGESTED, MS_PER_DAY
from tidefeed.sources import derived
from tidefeed.streaming import ingest, maintain, seen


@pytest.fixture(scope="module")
def feed(spark):
    return derived.notifications(spark, SF_DIR).where("ingest_seq < 600").cache()


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*INGESTED.names).collect()), key=str)


def run(spark, folder, files=1):
    stream = ingest.read_files(spark, f"{folder}/in", INGESTED, files)
    return ingest.run_available(seen.stream_dedup_seen(stream, f"{folder}/out", f"{folder}/seen", f"{folder}/progress", buckets=8))


def arrive(df, folder):
    df.coalesce(1).write.mode("append").parquet(f"{folder}/in")


def test_shuffled_arrivals_keep_every_event(spark, feed, folder):
    """A month apart in both directions: late rows stay, late replays go."""
    replayed = derived.replayed(feed).withColumn("_file", (F.rand(4) * 6).cast("int"))
    for part in range(6):
        arrive(replayed.where(F.col("_file") == part).drop("_file"), folder)
    assert len(run(spark, folder).recentProgress) == 6
    assert rows_of(maintain.read_streamed(spark, f"{folder}/out")) == rows_of(feed)


def test_replays_after_merging_and_restarts(spark, feed, folder):
    for wave in range(4):
        arrive(feed.where(F.col("ingest_seq") % 4 <= wave), folder)
        run(spark, folder)
        if wave % 2:
            seen.merge_seen(spark, f"{folder}/seen", f"{folder}/progress")
            maintain.merge_batches(spark, f"{folder}/out", f"{folder}/progress")
            maintain.drop_merged(spark, f"{folder}/out")
        assert rows_of(maintain.read_streamed(spark, f"{folder}/out")) == rows_of(feed.where(F.col("ingest_seq") % 4 <= wave))


def test_a_repeated_batch_decides_the_same(spark, feed, folder):
    """Its own keys, written before it failed, do not count against it."""
    before = maintain.read_streamed(spark, f"{folder}/seen", seen.SEEN, "bucket")
    fresh = seen.unseen(feed, before, 8)
    ingest.write_batch(fresh.select(*seen.KEY, "bucket"), f"{folder}/seen", 0, "bucket")
    earlier = maintain.read_streamed(spark, f"{folder}/seen", seen.SEEN, "bucket").where("batch_id < 0")
    assert rows_of(seen.unseen(feed, earlier, 8)) == rows_of(feed)
    later = maintain.read_streamed(spark, f"{folder}/seen", seen.SEEN, "bucket").where("batch_id < 1")
    assert seen.unseen(feed, later, 8).count() == 0


def test_the_first_write_of_a_key_stays_and_null_keys_are_keys(spark, folder):
    rows = [("a", "n", 5, "later", 9), ("a", "n", 7, "first", 2), (None, "n", 1, "x", 3), (None, "n", 1, "y", 4), ("a", None, 1, "z", 5)]
    frame = spark.createDataFrame(rows, INGESTED)
    none = maintain.read_streamed(spark, f"{folder}/none", seen.SEEN, "bucket")
    assert rows_of(seen.unseen(frame, none)) == sorted([rows[1], rows[2], rows[4]], key=str)
    held = seen.with_bucket(frame.select(*seen.KEY)).withColumn("batch_id", F.lit(0))
    assert seen.unseen(frame, held).count() == 0


def test_only_touched_buckets_are_read(spark, feed, folder):
    ingest.write_batch(seen.with_bucket(feed.select(*seen.KEY), 64), f"{folder}/seen", 0, "bucket")
    one = feed.where("ingest_seq = 7").withColumn("timestamp", F.col("timestamp") + 90 * MS_PER_DAY)
    got = seen.unseen(one, maintain.read_streamed(spark, f"{folder}/seen", seen.SEEN, "bucket"), 64)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line and "seen" in line)
    assert "PartitionFilters" in scan and "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert got.count() == 0
