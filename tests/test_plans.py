"""The physical plans: what is pushed down, pruned, limited early, and what must not occur."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidefeed.functions.scalar import day_of
from tidefeed.operators import dialects, metrics, monitor, store
from tidefeed.operators import feed as Q
from tidefeed.plans import ordered
from tidefeed.schema import INGESTED, MS_PER_DAY
from tidefeed.sources import derived
from tidefeed.sources.monitor import load_monitor_log
from tidefeed.sources.notifications import gen_range, read_feed
from tidefeed.workload.queries import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "feed")
    store.append(gen_range(spark, 2000, 1_705_000_000_000, 1_000_000, 20), path)
    return read_feed(spark, path)


def test_one_page_is_a_top_k_over_a_pruned_scan(stored):
    text = plan(Q.feed(stored, "desc", "8", 1_705_320_000_000))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "EqualTo(user_id,8)" in text and "LessThan(timestamp,1705320000000)" in text
    assert "PartitionFilters: [isnotnull(day" in text and "<= 2024-01-15" in text


def test_scan_reads_only_the_columns_it_needs(stored):
    text = plan(Q.counted_points(stored, "desc", 1_706_659_200_000))
    assert "ReadSchema: struct<user_id:string,notify_id:string,timestamp:bigint>" in text


def test_pages_of_all_users_are_limited_before_the_shuffle(stored):
    text = plan(Q.feed(stored, "desc"))
    assert text.count("WindowGroupLimit") == 2
    assert text.index("Final") < text.index("Exchange") < text.index("Partial")


def test_last_write_wins_combines_before_the_shuffle(stored):
    text = plan(Q.feed_keyrange(stored, "desc", 1_706_659_200_000))
    assert "partial_max(ingest_seq" in text


def test_row_key_bounds_reach_the_scan(spark, stored, tmp_path):
    store.write_salted(stored.drop("day"), str(tmp_path / "salted"))
    salted = spark.read.parquet(str(tmp_path / "salted"))
    text = plan(Q.rowkey_range_scan(salted, "8", "desc", 1_706_659_200_000))
    assert "GreaterThan(row_key" in text and "LessThanOrEqual(row_key" in text


def test_salt_and_day_reach_the_directories(spark, stored, tmp_path):
    store.write_salted(stored.drop("day"), str(tmp_path / "salted"))
    salted = spark.read.parquet(str(tmp_path / "salted"))
    text = plan(Q.rowkey_range_scan(salted, "8", "desc", 1_706_659_200_000))
    assert "PartitionFilters: [isnotnull(salt" in text
    ttl = plan(store.retain_ttl(stored, 1_706_659_200_000))
    assert "PartitionFilters: [isnotnull(day" in ttl
    held = plan(dialects.held(store.retain_ttl(stored, 1_706_659_200_000), "key_range"))
    assert "PartitionFilters: [isnotnull(day" in held


def test_log_search_skips_days(spark, tmp_path):
    rows = spark.createDataFrame([("r1", 5), ("r2", 90_000_000)], "requestID string, timestamp bigint")
    days = rows.select(day_of("timestamp").cast("string").alias("day"), F.struct("*").alias("_source"))
    days.write.partitionBy("day").json(str(tmp_path / "log"))
    log = load_monitor_log(spark, str(tmp_path / "log"), wrapped=True)
    found = monitor.monitor_search(log, min_time=86_400_000)
    assert [r.requestID for r in found.collect()] == ["r2"]
    assert "PartitionFilters: [isnotnull(day" in plan(found)


def test_trailing_counts_split_a_hot_user(spark):
    rows = spark.range(20_000).select(F.lit("hot").alias("user_id"), (F.col("id") * 62).alias("timestamp"))
    counts = metrics.trailing_count_sliced(rows, 1000)
    assert "_block" in plan(counts)
    assert {r.trailing_count for r in counts.where("timestamp > 2000").collect()} <= {16, 17, 18}
    for bad in (0, -16_000, 10):
        with pytest.raises(ValueError, match="interval"):
            metrics.trailing_count_sliced(rows, bad)
    with pytest.raises(ValueError, match="interval"):
        metrics.trailing_count_exact(rows, 0)


def test_slices_split_a_hot_key_and_a_hot_instant(spark):
    rows = spark.range(8000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 50).cast("string"))
        .alias("user_id"),
        F.lit(7).alias("timestamp"), "id")
    sizes = [r["count"] for r in ordered.range_slices(
        rows, "user_id", ["timestamp", "id"]).groupBy(ordered.SLICE).count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 8000 / 8


def test_carried_side_has_one_row_per_slice_at_most(spark):
    rows = spark.range(4000).select(F.lit("hot").alias("k"), "id")
    sliced = ordered.range_slices(rows, "k", ["id"])
    assert ordered._crossings(sliced, "k").count() == 7


def test_rows_without_a_key_are_numbered_too(spark):
    key = F.when(F.col("id") % 4 == 0, "k")
    rows = spark.range(4000).select(key.alias("k"), "id")
    got = ordered.positions(rows, "k", ["id"]).groupBy("k").agg(
        F.max("position"), F.countDistinct("position")).collect()
    assert sorted(map(tuple, got), key=str) == [("k", 1000, 1000), (None, 3000, 3000)]
    before = ordered.previous_value(rows, "k", ["id"], "id", "before")
    assert before.where("before is null").count() == 2
    assert before.where("k is null and before >= id").count() == 0


def test_trailing_count_groups_are_bounded_by_their_width(spark):
    df = spark.range(1000).select(
        F.lit("hot").alias("k"), F.lit(5).alias("t"), F.lit(1).cast("bigint").alias("v"))
    got = ordered.running_total_by_time(df, "k", "t", "v", "s", MS_PER_DAY).collect()
    assert [tuple(r) for r in got] == [("hot", 5, 1000, 1000)]


STREAMS = {name for name in QUERIES if name.startswith("st")}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_python_and_no_pairing_of_everything(spark, name):
    text = plan(QUERIES[name](spark, SF_DIR))
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin", "ExistingRDD"):
        assert operator not in text, operator


PARTITIONING = [
    {"spark.sql.shuffle.partitions": "3"},
    {"spark.sql.shuffle.partitions": "17"},
    # Neighbouring partitions merged at run time, to one or to several slices.
    {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "true"},
    {
        "spark.sql.shuffle.partitions": "60",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1kb",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4kb",
    },
    {"spark.sql.adaptive.enabled": "false"},
]


def test_results_do_not_depend_on_partitioning(spark):
    feed = derived.hourly(derived.notifications(spark, SF_DIR))
    seen, slices = set(), []
    for settings in PARTITIONING:
        before = {k: spark.conf.get(k, None) for k in settings}
        for k, v in settings.items():
            spark.conf.set(k, v)
        try:
            rows = Q.feed_pages(feed).select("user_id", "rank", "notify_id", "page").collect()
            sliced = ordered.range_slices(feed, "user_id", ["timestamp", "ingest_seq"])
            slices.append(sliced.select(ordered.SLICE).distinct().count())
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        seen.add(tuple(sorted(map(tuple, rows))))
    assert len(seen) == 1
    assert slices[:3] == [3, 17, 1] and 1 < slices[3] < 60 and slices[4] == 8
