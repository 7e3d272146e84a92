"""Stored feeds: append, last write wins, retention, layouts, and the other stored forms."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from tidefeed.operators import dialects, forms, store
from tidefeed.operators.identity import BY_POINT, first_per_id, upsert_latest
from tidefeed.operators.validate import validate_split, validate_strict
from tidefeed.plans.pruning import time_range
from tidefeed.schema import INGESTED, MS_PER_DAY, NOTIFICATIONS
from tidefeed.functions.scalar import normalize_record
from tidefeed.session import shared_folder
from tidefeed.sources.notifications import gen_range, load_notifications, read_feed

D0 = 19_700 * MS_PER_DAY      # 2023-12-09

ROWS = [
    ("a", "n1", D0, '{"v":1}', 1),
    ("a", "n2", D0, '{"v":2}', 2),                       # same user and time, later
    ("a", "n3", D0 + MS_PER_DAY - 1, '{"v":3}', 3),      # last millisecond of the day
    ("a", "n4", D0 + MS_PER_DAY, '{"v":4}', 4),          # first of the next
    ("b", "n5", D0 + 2 * MS_PER_DAY, '{"v":5}', 5),
    ("b", "n5", D0 + 2 * MS_PER_DAY, '{"v":6}', 6),      # same point again
]


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(ROWS, INGESTED)


def as_rows(df):
    return sorted(tuple(r) for r in df.select(*INGESTED.names).collect())


def test_append_makes_day_chunks(spark, feed, folder):
    path = f"{folder}/feed"
    store.append(feed.where("ingest_seq <= 3"), path)
    store.append(feed.where("ingest_seq > 3"), path)
    assert as_rows(read_feed(spark, path)) == ROWS
    days = sorted(d for d in os.listdir(path) if d.startswith("day="))
    assert days == ["day=2023-12-09", "day=2023-12-10", "day=2023-12-11"]


def test_bootstrap_replaces_everything(spark, feed, folder):
    path = f"{folder}/feed"
    store.append(feed, path)
    store.bootstrap(gen_range(spark, 100, D0 + 5 * MS_PER_DAY, users=3), path)
    stored = read_feed(spark, path)
    assert stored.count() == 100 and stored.select("day").distinct().count() == 1
    assert {r.user_id for r in stored.collect()} == {"0", "1", "2"}


def test_range_reads_only_its_days(spark, feed, folder):
    path = f"{folder}/feed"
    store.append(feed, path)
    kept = time_range(read_feed(spark, path), D0 + MS_PER_DAY, D0 + 2 * MS_PER_DAY,
                      upper_inclusive=False)
    assert [r.notify_id for r in kept.collect()] == ["n4"]
    assert kept.select("notify_id").inputFiles()
    files = {r[0] for r in kept.select(F.input_file_name()).collect()}
    assert all("day=2023-12-10" in f for f in files)


def test_validation(spark, folder):
    rows = [("a", "n", 1, "{}", 1), (None, "n", 1, "{}", 2), ("a", None, 1, "{}", 3),
            ("a", "n", 1, None, 4), ("a", "n", 1, "[1]", 5), ("", "", None, "{}", 6)]
    df = spark.createDataFrame(rows, INGESTED)
    valid, rejected = validate_split(df)
    assert [r.ingest_seq for r in valid.orderBy("ingest_seq").collect()] == [1, 6]
    assert {r.ingest_seq: r.reject_reason for r in rejected.collect()} == {
        2: "user_id", 3: "notify_id", 4: "data", 5: "data"}
    store.append_validated(df.where("timestamp is not null"), f"{folder}/ok", f"{folder}/bad")
    assert read_feed(spark, f"{folder}/ok").count() == 1
    assert spark.read.parquet(f"{folder}/bad").count() == 4
    assert validate_strict(valid).count() == 2
    with pytest.raises(Exception, match="invalid row, column notify_id"):
        validate_strict(df.where("ingest_seq = 3")).collect()


def test_last_write_wins(feed):
    by_time = [ROWS[1], ROWS[2], ROWS[3], ROWS[5]]
    assert as_rows(upsert_latest(feed)) == by_time
    assert as_rows(upsert_latest(feed, BY_POINT)) == [r for r in ROWS if r[4] != 5]
    assert as_rows(upsert_latest(feed.repartition(5))) == by_time


def test_compaction_touches_only_its_days(spark, feed, folder):
    path = f"{folder}/feed"
    store.append(feed, path)
    untouched = {f: os.path.getmtime(f"{path}/day=2023-12-11/{f}")
                 for f in os.listdir(f"{path}/day=2023-12-11")}
    store.compact_days(spark, path, [dt.date(2023, 12, 9), dt.date(2023, 12, 10)])
    assert as_rows(read_feed(spark, path)) == [r for r in ROWS if r[4] != 1]
    store.compact_days(spark, path, [dt.date(2023, 12, 9), dt.date(2023, 12, 10)])
    assert as_rows(read_feed(spark, path)) == [r for r in ROWS if r[4] != 1]
    assert untouched == {f: os.path.getmtime(f"{path}/day=2023-12-11/{f}")
                         for f in os.listdir(f"{path}/day=2023-12-11")}


def test_first_time_and_last_payload(spark):
    rows = [("a", "n", 5, "mid", 1), ("a", "n", 9, "old write", 2), ("a", "n", 9, "new write", 3),
            ("a", "n", 2, "first", 4), ("b", "n", 7, "other user", 5)]
    got = sorted(tuple(r) for r in first_per_id(spark.createDataFrame(rows, INGESTED)).collect())
    assert got == [("a", "n", 2, "new write"), ("b", "n", 7, "other user")]


def test_truncate_keeps_the_columns(spark, feed, folder):
    path = f"{folder}/feed"
    feed.write.parquet(path)
    store.truncate(spark, path)
    empty = spark.read.parquet(path)
    assert empty.count() == 0 and empty.columns == INGESTED.names


def test_ttl_boundary(spark):
    now = 10**12
    rows = [("a", "n", now - 5000, "{}", 1), ("a", "n", now - 5001, "{}", 2),
            ("a", "n", now + 1, "{}", 3)]
    df = spark.createDataFrame(rows, INGESTED)
    kept = store.retain_ttl(df, now, ttl_seconds=5)
    assert sorted(r.ingest_seq for r in kept.collect()) == [1, 3]
    by_ingest = df.withColumn("ingest_ms", F.lit(now))
    assert store.retain_ttl(by_ingest, now, 5, basis="ingest_ms").count() == 3


@pytest.mark.parametrize("past_midnight, kept", [(0, 6), (1, 6), (MS_PER_DAY, 3)])
def test_whole_chunks_are_dropped(spark, feed, folder, past_midnight, kept):
    # The first chunk ends at D0 + 1 day; it goes once as_of - 30 days has reached that.
    as_of = D0 + 30 * MS_PER_DAY + past_midnight
    path = f"{folder}/feed"
    store.append(feed, path)
    view = store.retain_chunks(feed, as_of)
    dropped = store.drop_chunks(spark, path, as_of)
    assert view.count() == kept == read_feed(spark, path).count()
    assert dropped == (["day=2023-12-09"] if kept == 3 else [])


def test_salted_layout_keeps_key_order(spark, folder):
    feed = gen_range(spark, 5000, D0, users=50)
    path = f"{folder}/salted"
    store.write_salted(feed, path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5000
    assert sorted(d for d in os.listdir(path) if d.startswith("salt=")) == [
        f"salt={n}" for n in range(6)]
    for name in os.listdir(f"{path}/salt=3"):
        if name.endswith(".parquet"):
            keys = [bytes(r.row_key) for r in spark.read.parquet(f"{path}/salt=3/{name}").collect()]
            assert keys == sorted(keys)


def test_points_round_trip(feed):
    points = forms.to_points(feed.withColumn("kind", F.lit("k")), ("data", "kind"))
    assert points.count() == 12
    assert forms.point_filter(points, "notifications", user_id="b", field="kind").count() == 2
    back = forms.from_points(points, ("data", "kind"))
    assert sorted((r.notify_id, r.data, r.kind) for r in back.collect()) == [
        (f"n{i}", f'{{"v":{i if i < 5 else 6}}}', "k") for i in range(1, 6)]


def test_cells_round_trip(spark):
    rows = [("a", "n", 5, '{"v":1}', 2), ("é", "m", -1, None, 3)]
    df = spark.createDataFrame([("a", "old", 5, "{}", 1), *rows], INGESTED)
    back = forms.cells_to_records(forms.records_to_cells(df))
    assert sorted(tuple(r) for r in back.collect()) == [r[:4] for r in rows]


def test_record_json_ignores_unknown_keys(spark):
    text = '{"user_id":"a","notify_id":"n","timestamp":5,"data":{"v":1},"other":[1]}'
    row = forms.decode_record_json(spark.createDataFrame([(text,)], "value string")).first()
    assert tuple(row) == ("a", "n", 5, '{"v":1}', None)


def test_normalize_drops_unknown_and_null(spark):
    df = spark.createDataFrame([("a", None, 5, 1)], "user_id string, data string, timestamp long, x int")
    assert tuple(normalize_record(df, NOTIFICATIONS).first()) == ("a", None, 5, None)


def test_any_time_type_loads(spark):
    source = spark.sql("""SELECT 1 AS user_id, 2 AS notify_id, '{}' AS data, 3L AS ingest_seq,
      TIMESTAMP_NTZ'2024-01-01 00:00:00.0019' AS ntz, TIMESTAMP'2024-01-01 00:00:00.0019Z' AS ltz,
      1704067200001L AS ms""")
    for column in ("ntz", "ltz", "ms"):
        assert load_notifications(source, timestamp=column).first().timestamp == 1704067200001


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


class Unset:
    """A session that names no shared folder."""

    def __init__(self, master):
        self.conf = {}
        self.sparkContext = self
        self.master = master


def test_only_a_local_session_may_go_without_a_shared_folder():
    assert shared_folder(Unset("local[4]")) == shared_folder(Unset("local[2]"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Unset("yarn"))


def test_write_rules_per_dialect(spark):
    rows = [("a", "n1", 5, "{}", 1), ("a", "n2", 5, "{}", 2), ("a", "n2", 5, '{"v":1}', 3),
            (None, "n3", 5, "{}", 4), ("a", "n4", 6, None, 5)]
    df = spark.createDataFrame(rows, INGESTED)
    kept = {d: sorted(r.ingest_seq for r in dialects.as_stored(df, d).collect())
            for d in dialects.RULES}
    assert kept == {
        "key_range": [3], "append": [1, 2, 3], "retention_range": [1, 3, 4, 5],
        "counted_points": [1, 3, 4, 5], "inclusive_points": [1, 3, 4, 5]}
    assert {r.data for r in dialects.as_stored(df, "counted_points").collect()} == {None}


def test_retention_per_dialect(spark):
    day = MS_PER_DAY
    as_of = D0 + 40 * day + 5
    rows = [("a", "n", as_of - n * day, "{}", n) for n in range(40)]
    df = spark.createDataFrame(rows, INGESTED)
    kept = {d: dialects.retained(df, d, as_of).count() for d in dialects.RULES}
    assert kept == {"key_range": 4, "append": 31, "retention_range": 4,
                    "counted_points": 40, "inclusive_points": 40}
