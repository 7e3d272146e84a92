"""Streams over several files: the result must equal the batch result on the same rows."""

import os

import pytest
from pyspark.sql import functions as F

from tidefeed.operators import feed as Q
from tidefeed.operators.identity import BY_TIME, upsert_latest
from tidefeed.schema import INGESTED, MS_PER_DAY
from tidefeed.sources import derived
from tidefeed.streaming import ingest, top_feed, trailing
from conftest import SF_DIR


def arrive(df, order, folder, files=4):
    """Write ``df`` as ``files`` files whose arrival order follows ``order``."""
    for n in range(files):
        part = df.where(order == n).coalesce(1)
        part.write.mode("append").parquet(f"{folder}/in")


@pytest.fixture(scope="module")
def feed(spark):
    return derived.notifications(spark, SF_DIR).cache()


@pytest.fixture(params=["ordered", "shuffled"])
def arrivals(request, spark, feed, folder):
    rows = feed.count()
    order = (
        F.expr(f"ingest_seq div {rows // 4}") if request.param == "ordered"
        else F.col("ingest_seq") * 7919 % 4
    )
    arrive(derived.hourly(feed), order, folder)
    return folder


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*INGESTED.names).collect())


def source(spark, folder, files=1):
    return ingest.read_files(spark, f"{folder}/in", INGESTED, files)


def test_upsert_stream_equals_batch(spark, feed, arrivals):
    query = ingest.run_available(ingest.stream_ingest(
        source(spark, arrivals), f"{arrivals}/out", f"{arrivals}/bad", f"{arrivals}/progress"))
    assert len(query.recentProgress) == 4
    log = spark.read.parquet(f"{arrivals}/out")
    assert rows_of(log) == rows_of(derived.hourly(feed))
    # In arrival order the later batch wins, whatever the sequence number says.
    ranked = log.withColumn("w", F.struct("batch_id", "ingest_seq"))
    expected = upsert_latest(ranked, BY_TIME, "w")
    assert rows_of(ingest.latest_view(spark, f"{arrivals}/out")) == rows_of(expected)


def test_restart_takes_only_new_files(spark, feed, folder):
    arrive(feed.where("ingest_seq < 500"), F.col("ingest_seq") % 2, folder, 2)
    out, bad, progress = (f"{folder}/{n}" for n in ("out", "bad", "progress"))

    def run():
        ingest.run_available(ingest.stream_ingest(source(spark, folder), out, bad, progress))

    run()
    run()
    assert spark.read.parquet(out).count() == feed.where("ingest_seq < 500").count()
    arrive(feed.where("ingest_seq >= 500"), F.col("ingest_seq") % 2, folder, 2)
    run()
    assert rows_of(spark.read.parquet(out)) == rows_of(feed)


def test_a_repeated_batch_replaces_itself(spark, feed, folder):
    for _ in range(2):
        ingest.write_batch(feed.withColumn("day", F.lit("d")), f"{folder}/out", 3, "day")
    ingest.write_batch(feed.withColumn("day", F.lit("d")), f"{folder}/out", 4, "day")
    assert spark.read.parquet(f"{folder}/out").count() == 2 * feed.count()


def test_dirty_rows_go_aside(spark, folder):
    dirty = derived.dirty(derived.events(spark, SF_DIR))
    arrive(dirty, F.col("ingest_seq") % 4, folder)
    ingest.run_available(ingest.stream_ingest(
        source(spark, folder), f"{folder}/out", f"{folder}/bad", f"{folder}/progress"))
    kept, aside = spark.read.parquet(f"{folder}/out"), spark.read.parquet(f"{folder}/bad")
    assert kept.count() + aside.count() == dirty.count()
    assert {r[0] for r in aside.select("reject_reason").distinct().collect()} == {
        "user_id", "notify_id", "data"}


def test_dedup_drops_replays(spark, feed, folder):
    rows = feed.count()
    arrive(derived.replayed(feed), F.expr(f"ingest_seq div {rows // 4}"), folder)
    query = ingest.run_available(ingest.append_stream(
        ingest.stream_dedup(source(spark, folder)), f"{folder}/out", f"{folder}/progress"))
    assert rows_of(spark.read.parquet(f"{folder}/out")) == rows_of(feed)
    assert ingest.dropped_by_watermark(query) == 0


def test_dedup_reports_what_came_too_late(spark, feed, folder):
    arrive(feed, F.col("ingest_seq") * 7919 % 4, folder)
    query = ingest.run_available(ingest.append_stream(
        ingest.stream_dedup(source(spark, folder)), f"{folder}/out", f"{folder}/progress"))
    kept, late = spark.read.parquet(f"{folder}/out").count(), ingest.dropped_by_watermark(query)
    assert late > 0 and kept + late == feed.count()


def test_trailing_windows_equal_batch(spark, feed, arrivals):
    interval = 16 * 3_600_000
    counts = trailing.slice_counts(source(spark, arrivals), interval, delay_seconds=None)
    ingest.run_available(trailing.stream_trailing_count(
        counts, f"{arrivals}/out", f"{arrivals}/progress"))
    got = trailing.trailing_windows(spark, f"{arrivals}/out", interval)
    timed = derived.hourly(feed).select("user_id", F.timestamp_millis("timestamp").alias("t"))
    batch = timed.groupBy(F.window("t", "16 hours", "1 hour"), "user_id").count()
    assert sorted(map(tuple, got.select("user_id", "window_ms", "events").collect())) == sorted(
        map(tuple, batch.select("user_id", F.unix_millis("window.start"), "count").collect()))


def test_slices_leave_the_state_behind_the_watermark(spark, feed, folder):
    arrive(feed, F.expr(f"ingest_seq div {feed.count() // 4}"), folder)
    counts = trailing.slice_counts(source(spark, folder), MS_PER_DAY, delay_seconds=3600)
    query = ingest.run_available(trailing.stream_trailing_count(
        counts, f"{folder}/out", f"{folder}/progress"))
    state = query.lastProgress.stateOperators[0]
    assert state.numRowsTotal < spark.read.parquet(f"{folder}/out").count() / 2
    assert spark.read.parquet(f"{folder}/out").agg(F.sum("events")).first()[0] >= feed.count()


def test_closed_slices_are_written_once(spark, feed, folder):
    arrive(feed, F.expr(f"ingest_seq div {feed.count() // 4}"), folder)
    counts = trailing.slice_counts(source(spark, folder), MS_PER_DAY, delay_seconds=3600)
    ingest.run_available(trailing.stream_trailing_count(
        counts, f"{folder}/out", f"{folder}/progress", output_mode="append"))
    stored = spark.read.parquet(f"{folder}/out")
    width = MS_PER_DAY // 16
    batch = feed.groupBy("user_id", F.expr(f"timestamp div {width} * {width}").alias("slice_ms"))
    both = stored.join(batch.count(), ["user_id", "slice_ms"])
    assert both.count() == stored.count() == stored.select("user_id", "slice_ms").distinct().count()
    assert both.where("events <> count").count() == 0
    assert stored.count() > batch.count().count() * 0.9


@pytest.mark.parametrize("fold_every", [2, 32])
def test_top_feed_equals_batch(spark, feed, arrivals, fold_every):
    path = f"{arrivals}/top"
    ingest.run_available(top_feed.stream_top_feed(
        source(spark, arrivals), path, f"{arrivals}/progress", fold_every=fold_every))
    got = top_feed.read_top_feed(spark, path)
    expected = sorted(map(tuple, Q.feed(derived.hourly(feed), "desc").collect()))
    assert sorted(map(tuple, got.collect())) == expected
    top_feed.drop_folded(spark, path)
    assert sorted(os.listdir(path)) == (
        ["full-3"] if fold_every == 2 else [f"batch-{n}" for n in range(4)])
    assert sorted(map(tuple, top_feed.read_top_feed(spark, path).collect())) == expected


def test_folded_batches_go_while_the_stream_runs(spark, feed, folder):
    """What is listed stays bounded, and every batch, run again or not, finds what it builds on."""
    path, listed = f"{folder}/top", []
    for wave in range(9):
        feed.where(F.col("ingest_seq") % 9 == wave).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        ingest.run_available(top_feed.stream_top_feed(source(spark, folder), path, f"{folder}/progress", fold_every=2))
        listed.append(len(os.listdir(path)))
        expected = Q.feed(feed.where(F.col("ingest_seq") % 9 <= wave), "desc")
        assert sorted(map(tuple, top_feed.read_top_feed(spark, path).collect())) == sorted(map(tuple, expected.collect()))
    assert max(listed) <= 2 + 4 and listed[8] <= 6
