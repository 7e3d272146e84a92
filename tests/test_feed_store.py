"""The feed interface, in every dialect: write, fetch, flush, fetch again."""

import pytest

from tidefeed.operators.dialects import RULES
from tidefeed.schema import INGESTED
from tidefeed.store import FeedStore
from tidefeed.streaming.ingest import read_files, run_available

NOW = 1_706_659_200_000


@pytest.fixture(scope="module")
def ten(spark):
    """Ten rows, users 0 to 4, one millisecond apart."""
    return spark.createDataFrame(
        [(str(i % 5), str(i), NOW - 100 + i, "{}", i) for i in range(10)], INGESTED)


@pytest.mark.parametrize("dialect", RULES)
def test_write_fetch_flush(spark, ten, folder, dialect):
    store = FeedStore(spark, folder + "/feed", dialect)
    assert store.fetch_asc("1", as_of=NOW).count() == 0
    store.insert(ten.where("ingest_seq < 6"))
    ten.where("ingest_seq >= 6").write.parquet(folder + "/in")
    run_available(store.insert_stream(
        read_files(spark, folder + "/in", INGESTED), folder + "/progress"))
    again = FeedStore(spark, folder + "/feed", dialect)
    times = [r.timestamp for r in again.fetch_asc("1", as_of=NOW).orderBy("timestamp").collect()]
    assert times == [NOW - 99, NOW - 94]
    assert again.fetch_desc("6", as_of=NOW).count() == 0
    assert again.fetch_desc(None, as_of=NOW).count() == 10
    more = [r.timestamp for r in again.fetch_desc("1", NOW - 94, as_of=NOW).collect()]
    # Cut to the second, the cursor of the counting dialect lies before all ten rows.
    assert more == [] if dialect == "counted_points" else NOW - 99 in more
    assert again.rows(as_of=NOW).count() == 10
    again.flush()
    assert again.fetch_asc("1", as_of=NOW).count() == 0 and again.rows().count() == 0


def test_insert_rejects_invalid_rows(spark, folder):
    bad = spark.createDataFrame([("a", None, 5, "{}", 1)], INGESTED)
    store = FeedStore(spark, folder + "/feed", "key_range")
    with pytest.raises(Exception, match="invalid row, column notify_id"):
        store.insert(bad)
    assert store.rows().count() == 0
    loose = FeedStore(spark, folder + "/loose", "inclusive_points")
    loose.insert(bad)
    assert loose.rows().count() == 1


@pytest.mark.parametrize("dialect", RULES)
def test_fetch_all_equals_single_fetches(spark, folder, dialect):
    """Daily rows of two users, ids written at several times, some written twice."""
    day = 86_400_000
    rows = [(u, f"n{i % 5}", NOW - i * day + k, f'{{"k":{i}}}', 100 - i)
            for u in ("1", "2") for i in range(-1, 8) for k in (0, 5)]
    store = FeedStore(spark, folder + "/feed", dialect)
    store.insert(spark.createDataFrame(rows, INGESTED))
    store.insert(spark.createDataFrame([r for r in rows if r[4] % 2], INGESTED))
    asked = [(n, u, d, f) for n, (u, d, f) in enumerate(
        (u, d, f) for u in ("1", "2", "9") for d in ("desc", "asc")
        for f in (None, NOW - 2 * day, NOW - 2 * day + 5, NOW - 20 * day, NOW + 9 * day))]
    frame = spark.createDataFrame(asked, "req_id bigint, user_id string, direction string, from_time bigint")
    got: dict = {}
    for r in store.fetch_all(frame, as_of=NOW, limit=4).collect():
        own = got.setdefault(r.req_id, [])
        if r.timestamp is not None:
            own.append((r.timestamp, r.notify_id, r.n if dialect == "counted_points" else r.data))
    for n, user, direction, cursor in asked:
        fetch = store.fetch_desc if direction == "desc" else store.fetch_asc
        single = fetch(user, cursor, as_of=NOW, limit=4).collect()
        want = [(r.timestamp, r.notify_id, r.n if dialect == "counted_points" else r.data) for r in single]
        assert sorted(got[n], key=str) == sorted(want, key=str), (user, direction, cursor)


@pytest.mark.parametrize("dialect", ["key_range", "inclusive_points", "retention_range"])
def test_the_later_write_stays(spark, folder, dialect):
    """Two inserts and two micro-batches; each later write has the smaller sequence."""
    store = FeedStore(spark, folder + "/feed", dialect)

    def row(value, sequence):
        return spark.createDataFrame([("a", "n", NOW - 5, f'{{"v":{value}}}', sequence)], INGESTED)

    def shown():
        return [r.data for r in store.fetch_desc("a", as_of=NOW).collect()]

    store.insert(row(1, 90))
    store.insert(row(2, 80))
    assert shown() == ['{"v":2}'] and [r.data for r in store.rows().collect()] == ['{"v":2}']
    for value, sequence in ((3, 70), (4, 60)):
        row(value, sequence).write.mode("append").parquet(folder + "/in")
        run_available(store.insert_stream(
            read_files(spark, folder + "/in", INGESTED), folder + "/progress"))
        assert shown() == [f'{{"v":{value}}}']
    store.insert(row(5, 1))
    assert shown() == ['{"v":5}']


def test_flush_under_dynamic_overwrite(spark, ten, folder):
    store = FeedStore(spark, folder + "/feed")
    store.insert(ten)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        store.flush()
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")
    assert store.rows().count() == 0


def test_unknown_dialect(spark, folder):
    with pytest.raises(ValueError, match="unknown dialect"):
        FeedStore(spark, folder, "other")
