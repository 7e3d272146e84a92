"""The dictionary of series: numbers that stay, hot series, repeated loads."""

from pyspark.sql import functions as F

from tidefeed.operators import series
from tidefeed.session import new_folder

SCHEMA = "measurement string, user_id string, notify_id string, time long, field string, value string"


def points(spark, rows):
    return spark.createDataFrame([("m", u, n, t, "data", f"v{t}") for u, n, t in rows], SCHEMA)


def numbers(frame):
    return {(r.user_id, r.notify_id): r.series_id for r in frame.collect()}


def test_later_loads_keep_all_numbers(spark):
    path = new_folder(spark, "series")
    first = points(spark, [("b", "1", 1), ("a", "2", 2), ("b", "1", 3), (None, "1", 4)])
    series.append_points(first, path)
    assert numbers(series.read_series(spark, path)) == {(None, "1"): 1, ("a", "2"): 2, ("b", "1"): 3}
    second = points(spark, [("a", "1", 5), ("b", "1", 6), (None, None, 7), ("a", None, 8)])
    series.append_points(second, path)
    assert numbers(series.read_series(spark, path)) == {
        (None, "1"): 1, ("a", "2"): 2, ("b", "1"): 3, (None, None): 4, ("a", None): 5, ("a", "1"): 6}
    back = series.points_of(spark, path)
    assert sorted(map(str, back.collect())) == sorted(map(str, first.unionByName(second).collect()))
    assert sorted(r.time for r in series.points_of(spark, path, user_id="b").collect()) == [1, 3, 6]
    assert series.points_of(spark, path, user_id="none").count() == 0


def test_a_failed_load_is_repeated(spark):
    path = new_folder(spark, "series")
    rows = points(spark, [("a", "1", 1), ("b", "1", 2)])
    series.append_points(rows.limit(0), path)
    assert series.read_series(spark, path).count() == 0
    # The series are written, the points not; and a load that never ended lies beside them.
    series.new_series(rows).write.parquet(f"{path}/series/load-0")
    spark.range(3).write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/series/load-1")
    series.append_points(rows, path)
    assert numbers(series.read_series(spark, path)) == {("a", "1"): 1, ("b", "1"): 2}
    assert series.points_of(spark, path).count() == 2


def test_hot_series_meet_a_broadcast_and_the_others_a_shuffle(spark):
    many = spark.range(60_000).select(
        F.lit("m").alias("measurement"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), F.col("id") % 5000)).alias("user_id"),
        F.when(F.col("id") % 3 == 0, None).otherwise(F.lit("n")).alias("notify_id"), F.col("id").alias("time"), F.lit("x").alias("field"))
    known = series.new_series(many)
    assert known.agg(F.count("*"), F.min("series_id"), F.max("series_id"), F.count_distinct("series_id")).first()[:] == (
        5001, 1, 5001, 5001)
    coded = series.encode_points(many, known, limit=0)
    plan = coded._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in plan and "Union" in plan
    whole = series.encode_points(many, known)
    assert whole._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 0
    assert coded.exceptAll(whole).count() == whole.exceptAll(coded).count() == 0
    back = series.decode_points(coded, known, limit=0)
    assert back.columns == many.columns and back.exceptAll(many).count() == many.exceptAll(back).count() == 0
    assert coded.groupBy("series_id").count().agg(F.max("count")).first()[0] == 20_000
