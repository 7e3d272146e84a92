"""Upkeep of stored and streamed feeds: equal rows before, between and after, whatever fails."""

import os
import threading

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidefeed.operators import store
from tidefeed.operators.identity import BY_TIME, upsert_latest
from tidefeed.schema import INGESTED, MS_PER_DAY, STORED, WRITTEN
from tidefeed.sources import derived
from tidefeed.store import FeedStore
from tidefeed.streaming import ingest, maintain

AS_OF = 1_706_659_200_000


@pytest.fixture(scope="module")
def feed(spark):
    return derived.hourly(derived.notifications(spark, SF_DIR)).cache()


def rows_of(df):
    return sorted(tuple(r) for r in df.select(*INGESTED.names).collect())


def arrive(spark, feed, folder, low, high, per_batch=1, files=1):
    """One run of the stream over the rows in the range, as ``files`` new files."""
    feed.where(F.col("ingest_seq").between(low, high - 1)).repartition(files).write.mode("append").parquet(f"{folder}/in")
    stream = ingest.read_files(spark, f"{folder}/in", INGESTED, per_batch)
    ingest.run_available(ingest.stream_ingest(stream, f"{folder}/out", f"{folder}/bad", f"{folder}/progress"))


def merge(spark, folder, **options):
    return maintain.merge_batches(spark, f"{folder}/out", f"{folder}/progress", **options)


def parquet_files(path):
    return sorted(os.path.join(top, name) for top, _, names in os.walk(path) for name in names if name.endswith(".parquet"))


def test_merging_while_the_stream_goes_on(spark, feed, folder):
    for wave in range(6):
        arrive(spark, feed, folder, wave * 100, wave * 100 + 100, files=3)
        expected = rows_of(feed.where(F.col("ingest_seq") < wave * 100 + 100))
        assert merge(spark, folder)
        assert rows_of(maintain.read_streamed(spark, f"{folder}/out")) == expected
        if wave % 2:
            maintain.drop_merged(spark, f"{folder}/out")
            assert not [n for n in os.listdir(f"{folder}/out") if n.startswith("batch_id=")]
            assert rows_of(maintain.read_streamed(spark, f"{folder}/out")) == expected
    assert merge(spark, folder) is None
    # 18 micro-batches of 30 days each are a few files per day now.
    assert len(maintain._current(maintain._segments(spark, f"{folder}/out"))) <= 3


def test_number_of_segments_stays_small(spark, feed, folder):
    for wave in range(12):
        ingest.write_batch(feed.limit(20).withColumn("day", F.lit("2024-01-01").cast("date")), f"{folder}/out", wave, "day")
        os.makedirs(f"{folder}/progress/commits", exist_ok=True)
        open(f"{folder}/progress/commits/{wave}", "w").close()
        merge(spark, folder)
        maintain.drop_merged(spark, f"{folder}/out")
    assert len(os.listdir(f"{folder}/out/_merged")) <= 4
    assert maintain.read_streamed(spark, f"{folder}/out").count() == 12 * 20


def test_last_write_wins_across_segments(spark, feed, folder):
    """Every wave writes some identities of the waves before again."""
    waves = []
    for wave in range(4):
        again = feed.where("ingest_seq % 3 = 0").withColumn("data", F.lit(f'{{"wave": {wave}}}'))
        waves.append(again.withColumn("ingest_seq", F.col("ingest_seq") % 100 - wave))
        waves[-1].write.mode("append").parquet(f"{folder}/in")
        stream = ingest.read_files(spark, f"{folder}/in", INGESTED, 1000)
        ingest.run_available(ingest.stream_ingest(stream, f"{folder}/out", f"{folder}/bad", f"{folder}/progress"))
        if wave != 2:
            merge(spark, folder, identity=BY_TIME)
    latest = ingest.latest_view(spark, f"{folder}/out")
    assert rows_of(latest) == rows_of(upsert_latest(waves[-1], BY_TIME))
    assert maintain.read_streamed(spark, f"{folder}/out").count() <= 2 * latest.count()


def test_a_failure_in_the_middle_changes_nothing(spark, feed, folder, monkeypatch):
    arrive(spark, feed, folder, 0, 300, files=3)
    expected = rows_of(feed.where("ingest_seq < 300"))
    out = f"{folder}/out"
    # The write of a segment fails: its parts are there without the mark of a complete write.
    target = merge(spark, folder)
    os.remove(f"{target}/_SUCCESS")
    assert rows_of(maintain.read_streamed(spark, out)) == expected
    assert merge(spark, folder) == target
    assert rows_of(maintain.read_streamed(spark, out)) == expected
    # Deleting what was merged fails after the first folder.
    right, done = maintain._delete, []

    def failing(spark, path):
        if done:
            raise OSError("lost")
        done.append(path)
        right(spark, path)

    monkeypatch.setattr(maintain, "_delete", failing)
    with pytest.raises(OSError):
        maintain.drop_merged(spark, out)
    assert len(done) == 1 and rows_of(maintain.read_streamed(spark, out)) == expected
    monkeypatch.undo()
    arrive(spark, feed, folder, 300, 400)
    maintain.drop_merged(spark, out)
    merge(spark, folder)
    assert rows_of(maintain.read_streamed(spark, out)) == rows_of(feed.where("ingest_seq < 400"))


def test_an_open_batch_is_left_alone(spark, feed, folder):
    """A micro-batch that the stream has not committed may be written again, and is not merged."""
    arrive(spark, feed, folder, 0, 100)
    chunk = feed.where("ingest_seq between 100 and 120").withColumn("day", F.lit("2024-01-01").cast("date"))
    ingest.write_batch(chunk, f"{folder}/out", 1, "day")
    assert merge(spark, folder).endswith("0-0")
    maintain.drop_merged(spark, f"{folder}/out")
    ingest.write_batch(chunk.limit(5), f"{folder}/out", 1, "day")
    assert maintain.read_streamed(spark, f"{folder}/out").count() == 105


def test_retention_of_streamed_folders(spark, feed, folder):
    arrive(spark, feed, folder, 0, 400, files=2)
    merge(spark, folder)
    arrive(spark, feed, folder, 400, 1000, files=2)
    out, progress = f"{folder}/out", f"{folder}/progress"
    as_of = AS_OF + 15 * MS_PER_DAY
    kept = feed.where(F.col("timestamp") >= (as_of // MS_PER_DAY - 30) * MS_PER_DAY)
    before = len(parquet_files(out))
    dropped = maintain.drop_streamed_chunks(spark, out, progress, as_of)
    assert any(name.startswith("_merged") for name in dropped) and any(name.startswith("batch_id") for name in dropped)
    assert len(parquet_files(out)) < before
    assert rows_of(maintain.read_streamed(spark, out)) == rows_of(kept)
    assert maintain.drop_streamed_chunks(spark, out, progress, as_of) == []
    merge(spark, folder, as_of=as_of + 5 * MS_PER_DAY)
    maintain.drop_merged(spark, out)
    later = feed.where(F.col("timestamp") >= (as_of // MS_PER_DAY - 25) * MS_PER_DAY)
    assert rows_of(maintain.read_streamed(spark, out)) == rows_of(later)


def test_segments_are_read_by_day(spark, feed, folder):
    arrive(spark, feed, folder, 0, 500)
    merge(spark, folder)
    arrive(spark, feed, folder, 500, 700)
    days = maintain.read_streamed(spark, f"{folder}/out").where("day = '2024-01-05'")
    plan = days._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("PartitionFilters: [isnotnull(day") == 2


def test_an_empty_folder_has_no_rows(spark, folder):
    assert maintain.read_streamed(spark, f"{folder}/none", STORED).count() == 0
    assert merge(spark, folder) is None and maintain.drop_merged(spark, f"{folder}/out") == []


@pytest.mark.parametrize("dialect", ["append", "key_range", "inclusive_points"])
def test_feed_store_shrinks_under_a_stream(spark, feed, folder, dialect):
    kept, plain = FeedStore(spark, f"{folder}/kept", dialect), FeedStore(spark, f"{folder}/plain", dialect)
    as_of = AS_OF + 12 * MS_PER_DAY
    for wave in range(3):
        part = feed.where(F.col("ingest_seq") % 3 == wave)
        part.write.mode("append").parquet(f"{folder}/in")
        for box, name in ((kept, "kept"), (plain, "plain")):
            ingest.run_available(box.insert_stream(ingest.read_files(spark, f"{folder}/in", INGESTED, 1000), f"{folder}/{name}-progress"))
            box.insert(part.limit(30).withColumn("data", F.lit('{"again": 1}')))
        kept.maintain(f"{folder}/kept-progress", as_of)
        assert rows_of(kept.rows(as_of)) == rows_of(plain.rows(as_of))
    fewer = len(parquet_files(f"{folder}/kept")) < len(parquet_files(f"{folder}/plain"))
    assert fewer if dialect == "append" else len(parquet_files(f"{folder}/kept/streams")) < len(parquet_files(f"{folder}/plain/streams"))


def test_write_numbers_are_never_shared(spark, folder):
    """A writer that lists, waits while others take numbers and delete lesser ones, and then goes on."""
    box = FeedStore(spark, folder)
    assert [box._next_write() for _ in range(3)] == [1, 2, 3]
    taken, files = [], os.listdir

    def slow():
        jvm = spark._jvm.org.apache.hadoop.fs
        path = jvm.Path(box.writes)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        assert fs.createNewFile(jvm.Path(path, "4"))
        taken.append(4)
        assert [box._next_write() for _ in range(2)] == [5, 6]
        # The late file of a number that is taken, created again.
        assert fs.createNewFile(jvm.Path(path, "4"))

    slow()
    assert box._next_write() == 7 and [name for name in files(box.writes) if name[0] != "."][0].startswith("7-")


def test_racing_writers_get_numbers_of_their_own(spark, folder):
    box, got = FeedStore(spark, folder), []

    def take():
        for _ in range(15):
            got.append(box._next_write())

    threads = [threading.Thread(target=take) for _ in range(6)]
    for thread in threads:
        thread.start()
    for thread in threads:
        thread.join()
    assert len(got) == len(set(got)) == 90


# ---- expiry by the time of the write ------------------------------------------------------

def aging(feed: DataFrame) -> DataFrame:
    """Files by day and by batch, so that some files have old rows only, some none, some both."""
    return feed.withColumn("ingested_ms", F.when(F.col("ingest_seq") % 50 == 7, None).otherwise(
        F.col("timestamp") + F.col("ingest_seq") % 2 * 10 * MS_PER_DAY))


def stored(spark, feed, folder):
    path = f"{folder}/feed"
    for rest in range(2):
        store.with_day(aging(feed).where(F.col("ingest_seq") % 4 < 2).where(F.col("ingest_seq") % 2 == rest)).coalesce(1).write.mode(
            "append").partitionBy("day").parquet(path)
    store.with_day(aging(feed).where(F.col("ingest_seq") % 4 >= 2)).coalesce(1).write.mode("append").partitionBy("day").parquet(path)
    return path


def young(feed, oldest):
    return aging(feed).where(F.coalesce(F.col("ingested_ms") >= oldest, F.lit(True)))


def test_only_mixed_files_are_rewritten(spark, feed, folder):
    path = stored(spark, feed, folder)
    before = parquet_files(path)
    oldest = AS_OF - 15 * 86_400_000
    per_file = {r.f: (r.old, r.n) for r in spark.read.parquet(path).groupBy(F.col("_metadata.file_path").alias("f")).agg(
        F.count_if(F.col("ingested_ms") < oldest).alias("old"), F.count("*").alias("n")).collect()}
    whole = sorted(f for f, (old, n) in per_file.items() if old == n)
    mixed = sorted(f for f, (old, n) in per_file.items() if 0 < old < n)
    gone, rewritten = store.expire_rows(spark, path, AS_OF, 15 * 86_400)
    assert (gone, rewritten) == (whole, mixed) and whole and mixed and len(whole) + len(mixed) < len(before)
    after = parquet_files(path)
    old = {"/" + f.removeprefix("file:").lstrip("/"): n for f, (n, _) in per_file.items()}
    untouched = [f for f in before if old[f] == 0]
    assert set(untouched) <= set(after)
    assert rows_of(spark.read.parquet(path)) == rows_of(young(feed, oldest))
    assert not [n for n in os.listdir(path) if n.startswith("_expiring")]
    assert store.expire_rows(spark, path, AS_OF, 15 * 86_400) == ([], [])
    assert parquet_files(path) == after


@pytest.mark.parametrize("step", ["rows", "files", "moved", "deleted"])
def test_expiry_survives_a_failure(spark, feed, folder, monkeypatch, step):
    path = stored(spark, feed, folder)
    oldest, calls = AS_OF - 15 * 86_400_000, []
    if step in ("rows", "files"):
        # Before the list of files is complete nothing has changed.
        right = spark.createDataFrame
        monkeypatch.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.expire_rows(spark, path, AS_OF, 15 * 86_400)
        monkeypatch.undo()
        assert rows_of(spark.read.parquet(path)) == rows_of(aging(feed)) and right
    else:
        right = store._delete_file

        def failing(spark, name):
            calls.append(name)
            if len(calls) > (0 if step == "moved" else 3):
                raise OSError("lost")
            right(spark, name)

        monkeypatch.setattr(store, "_delete_file", failing)
        with pytest.raises(OSError):
            store.expire_rows(spark, path, AS_OF, 15 * 86_400)
        monkeypatch.undo()
        # No row is lost meanwhile.
        assert set(rows_of(young(feed, oldest))) <= set(rows_of(spark.read.parquet(path)))
    store.expire_rows(spark, path, AS_OF, 15 * 86_400)
    assert rows_of(spark.read.parquet(path)) == rows_of(young(feed, oldest))


def test_writers_may_go_on_during_expiry(spark, feed, folder, monkeypatch):
    path = stored(spark, feed, folder)
    right = store._end_expiry
    more = aging(feed.where("ingest_seq > 900").withColumn("notify_id", F.lit("new")))

    def write_meanwhile(spark, path):
        store.with_day(more).write.mode("append").partitionBy("day").parquet(path)
        monkeypatch.setattr(store, "_end_expiry", right)
        right(spark, path)

    monkeypatch.setattr(store, "_end_expiry", write_meanwhile)
    store.expire_rows(spark, path, AS_OF, 15 * 86_400)
    assert {r.notify_id for r in spark.read.parquet(path).collect()} >= {"new"}


def test_the_streamed_schema_of_a_store(spark, feed, folder):
    chunk = feed.withColumn("write_no", F.lit(3).cast("bigint")).withColumn("day", F.lit("2024-01-01").cast("date"))
    ingest.write_batch(chunk, f"{folder}/out", 0, "day")
    got = maintain.read_streamed(spark, f"{folder}/out", WRITTEN)
    assert got.columns == [*WRITTEN.names, "batch_id"] and got.where("write_no = 3").count() == feed.count()
