"""Roll-ups and exact percentiles against plain Python, on edge rows and on skewed rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidefeed.operators import metrics, percentiles, rollup
from tidefeed.operators.feed import DESC, feed_keyrange
from tidefeed.operators.identity import BY_TIME, upsert_latest
from tidefeed.schema import INGESTED, MS_PER_HOUR
from tidefeed.sources import derived
from tidefeed.streaming import ingest, trailing


@pytest.fixture(scope="module")
def feed(spark):
    return derived.notifications(spark, SF_DIR).cache()


def test_slots_make_up_the_interval(spark):
    pick = random.Random(1)
    cases = [(pick.randint(-300, 300), pick.randint(-300, 300)) for _ in range(300)] + [(0, 0), (5, 5), (-8, 8), (0, 64), (1, 1_000_000)]
    for levels in (0, 3, 9):
        frame = spark.createDataFrame([c for c in cases if c[1] - c[0] < 5000 or levels == 9], "low long, high long")
        got = frame.select("low", "high", rollup.interval_slots(F.col("low"), F.col("high"), levels).alias("s")).collect()
        for row in got:
            units = [u for s in row.s for u in range(s.slot << s.level, s.slot + 1 << s.level)]
            assert sorted(units) == list(range(row.low, row.high))
            if row.high - row.low < 2 ** (levels + 1):
                assert len(row.s) <= 2 * max(1, row.high - row.low).bit_length()


@pytest.mark.parametrize("interval", [1000, 7000, MS_PER_HOUR, 23_415_000, 86_400_000, 40 * 86_400_000])
def test_trailing_counts_equal_exact_ones(spark, feed, interval):
    """From one table, whatever the interval."""
    seconds = feed.withColumn("timestamp", F.col("timestamp") - F.col("timestamp") % 1000)
    counts = rollup.dyadic_rollup(feed)
    got = sorted(map(tuple, rollup.trailing_counts(counts, interval).collect()))
    assert got == sorted(map(tuple, metrics.trailing_count_exact(seconds, interval).collect()))


def test_milliseconds_as_units(spark, feed):
    few = feed.where("ingest_seq < 200")
    counts = rollup.dyadic_rollup(few, unit_ms=1, levels=30)
    for interval in (1, 123_456_789):
        got = rollup.trailing_counts(counts, interval, unit_ms=1, levels=30)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, metrics.trailing_count_exact(few, interval).collect()))


def test_rollups_add_up(spark, feed):
    parts = [rollup.dyadic_rollup(feed.where(F.col("ingest_seq") % 3 == k)) for k in range(3)]
    assert sorted(rollup.add_rollups(*parts).collect()) == sorted(rollup.dyadic_rollup(feed).collect())


def test_levels_hold_the_same_events(spark, feed):
    counts = rollup.dyadic_rollup(feed)
    assert {r.n for r in counts.groupBy("level").agg(F.sum("events").alias("n")).collect()} == {feed.count()}


def test_counting_reads_no_event(spark, feed, folder):
    rollup.dyadic_rollup(feed).write.parquet(f"{folder}/rollup")
    got = rollup.trailing_counts(spark.read.parquet(f"{folder}/rollup"), MS_PER_HOUR)
    plan = got._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("/rollup" in line for line in scans) and "NestedLoop" not in plan


def test_rollup_edges(spark):
    rows = [("a", "n", t, "{}", i) for i, t in enumerate([-1, 0, 999, 1000, -86_400_000, None])] + [(None, "n", 5, "{}", 9)]
    frame = spark.createDataFrame(rows, INGESTED)
    counts = rollup.dyadic_rollup(frame)
    asked = spark.createDataFrame(
        [("a", -1000, 1000), ("a", 0, 1000), ("a", 0, 1000), ("a", 5000, 0), ("b", 0, 9000), (None, 0, 9000), ("a", -(1 << 40), 1 << 40)],
        "user_id string, from_ms long, to_ms long")
    got = [tuple(r) for r in rollup.interval_counts(counts, asked).collect()]
    assert sorted(got, key=str) == sorted(
        [("a", -1000, 1000, 3), ("a", 0, 1000, 2), ("a", 0, 1000, 2), ("a", 5000, 0, 0), ("b", 0, 9000, 0), (None, 0, 9000, 0),
         ("a", -(1 << 40), 1 << 40, 5)], key=str)
    assert rollup.dyadic_rollup(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        rollup.trailing_counts(counts, 1500)


def test_streamed_rollup_counts_late_and_repeated_batches(spark, feed, folder):
    for part in range(4):
        feed.where(F.col("ingest_seq") * 7919 % 4 == part).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    query = ingest.run_available(trailing.stream_rollup(
        ingest.read_files(spark, f"{folder}/in", INGESTED, 1), f"{folder}/out", f"{folder}/progress"))
    assert len(query.recentProgress) == 4
    again = spark.read.parquet(f"{folder}/out").where("batch_id = 2").drop("batch_id")
    ingest.write_batch(again, f"{folder}/out", 2)
    assert sorted(trailing.read_rollup(spark, f"{folder}/out").collect()) == sorted(rollup.dyadic_rollup(feed).collect())


# ---- percentiles --------------------------------------------------------------------------

def plain(rows, percents):
    groups = {}
    for key, value in rows:
        if value is not None:
            groups.setdefault(key, []).append(value)
    out = []
    for key, values in groups.items():
        values.sort()
        out.append((key, *[values[max(1, math.ceil(p * len(values) / 100)) - 1] for p in percents]))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1, 5, 12, 16])
@pytest.mark.parametrize("values", ["small", "wide", "negative", "extreme", "equal"])
def test_percentiles_equal_sorted_values(spark, bits, values):
    pick = random.Random(bits)
    draw = {"small": lambda: pick.randint(0, 40), "wide": lambda: pick.randint(0, 1 << 50), "negative": lambda: pick.randint(-5000, 5000),
            "extreme": lambda: pick.choice([-(1 << 63), (1 << 63) - 1, 0, pick.randint(-(1 << 62), 1 << 62)]), "equal": lambda: 7}[values]
    if values in ("extreme", "wide") and bits == 1:
        pytest.skip("as many passes as bits")
    rows = [(pick.choice(["a", "b", None, "c"]), draw()) for _ in range(400)] + [("one", draw()), ("none", None), ("a", None)]
    frame = spark.createDataFrame(rows, "k string, v long")
    percents = (0, 1, 50, 95, 100)
    got = percentiles.exact_percentiles(frame, ["k"], "v", percents, bits)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, percents)
    assert got.columns == ["k", "p0", "p1", "p50", "p95", "p100"]


def test_percentiles_of_everything_and_of_nothing(spark):
    frame = spark.createDataFrame([(i,) for i in range(1, 101)], "v long")
    assert [tuple(r) for r in percentiles.exact_percentiles(frame, [], "v", (50, 95)).collect()] == [(50, 95)]
    assert percentiles.exact_percentiles(frame.limit(0), [], "v", (50,)).count() == 0
    with pytest.raises(ValueError):
        percentiles.exact_percentiles(frame, [], "v", (101,))


def test_a_hot_group_is_spread(spark):
    """One group with a third of a million distinct values: no task gets more than a bounded part of it."""
    frame = spark.range(300_000).select(
        F.when(F.col("id") % 100 == 0, F.col("id") % 7).otherwise(99).alias("k"), (F.col("id") * 7919 % 300_007).alias("v"))
    got = {r.k: (r.p50, r.p95) for r in percentiles.exact_percentiles(frame, ["k"], "v", (50, 95)).collect()}
    values = sorted(i * 7919 % 300_007 for i in range(300_000) if i % 100)
    assert got[99] == (values[math.ceil(len(values) / 2) - 1], values[math.ceil(len(values) * 0.95) - 1])


def test_latency_summary_without_a_success(spark):
    rows = [("a", True, 5), ("a", False, 900), ("b", False, 3), (None, True, 2)]
    log = spark.createDataFrame(rows, "k string, ok boolean, latency_ms long")
    got = {r.k: (r.attempts, r.avg_ok_ms, r.p50_ok_ms, r.p95_ok_ms) for r in metrics.latency_summary(log, "k").collect()}
    assert got == {"a": (2, 5, 5, 5), "b": (1, None, None, None), None: (1, 2, 2, 2)}
    assert metrics.latency_summary(log).first().p95_ok_ms == 5


# ---- pages of all users --------------------------------------------------------------------

def test_chosen_rows_fetch_their_payload(spark, feed):
    again = derived.hourly(feed).unionByName(derived.hourly(feed).where("ingest_seq % 10 = 0"))
    got = feed_keyrange(again, DESC, 1_706_659_200_000, limit=5)
    latest = upsert_latest(derived.hourly(feed), BY_TIME).where("timestamp between 0 and 1706659200000").collect()
    by_user = {}
    for row in sorted(latest, key=lambda r: -r.timestamp):
        by_user.setdefault(row.user_id, []).append(row)
    expected = [(u, r.notify_id, r.timestamp, r.data, k) for u, rows in by_user.items() for k, r in enumerate(rows[:5], 1)]
    assert sorted(tuple(r[c] for c in ("user_id", "notify_id", "timestamp", "data", "rank")) for r in got.collect()) == sorted(expected)


def test_no_payload_before_the_limit(spark, feed):
    """What is grouped and ranked has user, time and sequence only."""
    got = feed_keyrange(feed, DESC, 1_706_659_200_000)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    narrow = [line for line in lines if "Aggregate [user_id" in line and "max(ingest_seq" in line]
    assert narrow and all("data" not in line and "notify_id" not in line for line in narrow)
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in physical


def test_levels_do_not_travel(spark, feed):
    """Units and blocks are shuffled, and grow into a row per level where they arrive."""
    plan = rollup.dyadic_rollup(feed)._jdf.queryExecution().executedPlan().toString()
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(shuffled) >= 4 and not [line for line in shuffled if "level" in line or "slot" in line]


def test_lower_and_upper_levels_of_a_hot_user(spark):
    """Every level sums the units itself, on both sides of a block's edge and of zero."""
    rows = spark.range(40_000).select(F.lit("hot").alias("user_id"), ((F.col("id") - 17_000) * 3001).alias("timestamp"))
    got = rollup.dyadic_rollup(rows).collect()
    want = {}
    for i in range(40_000):
        for level in range(rollup.LEVELS + 1):
            key = ("hot", level, (i - 17_000) * 3001 // 1000 >> level)
            want[key] = want.get(key, 0) + 1
    assert len(got) == len(want) and {(r.user_id, r.level, r.slot): r.events for r in got} == want
