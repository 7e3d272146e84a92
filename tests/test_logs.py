"""Log reports, latency summaries and trailing counts."""

import glob
import random

import pytest

from tidefeed.operators import metrics, monitor
from tidefeed.schema import INGESTED, MONITOR_LOG
from tidefeed.sources.monitor import load_monitor_log

LOG = [
    ("r1", "u", "g", "read", 10, "node_1", 1000, '{"size":5,"requestedTimestamp":-3599000}'),
    ("r2", "u", "g", "read", 11, "my node_2 x", 2000, '{"size":"7"}'),
    ("r3", "u", "g", "read", 12, "other", 1500, "{}"),
    ("r4", "u", "g", "read", 13, None, 1500, "{}"),
    ("r5", "u", "g", "write", 14, "node_1", 1500, "{bad"),
]


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(LOG, MONITOR_LOG)


def ids_of(df):
    return sorted(r.requestID for r in df.collect())


def test_search_bounds_are_strict(log):
    assert ids_of(monitor.monitor_search(log, "read")) == ["r1", "r2", "r3", "r4"]
    assert ids_of(monitor.monitor_search(log, "read", 1000)) == ["r2", "r3", "r4"]
    assert ids_of(monitor.monitor_search(log, "read", 1000, 2000)) == ["r3", "r4"]
    assert ids_of(monitor.monitor_search(log, None, None, 2000)) == ["r1", "r3", "r4", "r5"]


def test_report_and_export(spark, log, folder):
    report = monitor.monitor_report(log, "node_")
    rows = {r.requestID: (r.duration, r["size"], r.distance) for r in report.collect()}
    assert rows == {"r1": (10, 5, 1.0), "r2": (11, 7, 0.0), "r5": (14, 0, 0.0)}
    monitor.export_report(report, f"{folder}/report")
    parts = glob.glob(f"{folder}/report/step=read/*.csv")
    lines = sorted(line for p in parts for line in open(p).read().splitlines())
    assert lines == ["r1,10,5,1.00", "r2,11,7,0.00", "requestID,duration,size,distance"]


def test_log_documents_are_read_by_glob(spark, log, folder):
    log.write.json(f"{folder}/log-1")
    log.selectExpr("struct(*) AS _source").write.json(f"{folder}/hits-1")
    for path, wrapped in ((f"{folder}/log-*", False), (f"{folder}/hits-*", True)):
        back = load_monitor_log(spark, path, wrapped)
        assert back.schema == MONITOR_LOG
        assert sorted(map(tuple, back.collect()), key=str) == sorted(LOG, key=str)


def test_latency_counts_failures_in_the_average(spark):
    rows = [("a", True, 10, 0, 10), ("a", True, 21, 5, 26), ("a", False, 99, 7, 106),
            ("b", False, 5, 1, 6)]
    ops = spark.createDataFrame(
        rows, "phase string, ok boolean, latency_ms long, start_ms long, end_ms long")
    got = {r.phase: tuple(r)[1:] for r in metrics.latency_summary(ops, "phase").collect()}
    assert got == {"a": (3, 1, 10, 15, 10, 21, "0.010"), "b": (1, 1, 0, None, None, None, "0.000")}
    spent = {r.phase: tuple(r)[1:] for r in metrics.elapsed_summary(ops, "phase").collect()}
    assert spent == {"a": (106, "0.106"), "b": (5, "0.005")}
    assert all(r.has_error for r in metrics.phase_has_error(ops, "phase").collect())


def counted_rows():
    """One user owns half of the rows and a sixth of all rows share one millisecond."""
    rng = random.Random(11)
    return [
        ("hot" if i % 2 else str(rng.randrange(9)), f"n{i}",
         7777 if i % 6 == 1 else rng.randrange(20_000) - 2_000, "{}", i)
        for i in range(2000)
    ]


@pytest.mark.parametrize("interval", [1, 1600, 50_000])
def test_exact_trailing_count(spark, interval):
    rows = counted_rows()
    got = {
        (r.user_id, r.timestamp): (r.n, r.trailing_count)
        for r in metrics.trailing_count_exact(
            spark.createDataFrame(rows, INGESTED), interval).collect()
    }
    times = {}
    for user, _, t, _, _ in rows:
        times.setdefault(user, []).append(t)
    assert got == {
        (u, t): (ts.count(t), sum(t - interval <= x <= t for x in ts))
        for u, ts in times.items() for t in set(ts)
    }


@pytest.mark.parametrize("interval", [160, 1600, 32_000])
def test_sliced_trailing_count(spark, interval):
    rows = counted_rows()
    got = {
        (r.user_id, r.timestamp): (r.n, r.trailing_count)
        for r in metrics.trailing_count_sliced(
            spark.createDataFrame(rows, INGESTED), interval).collect()
    }
    width = interval // 16
    times, expected = {}, {}
    for user, _, t, _, _ in rows:
        times.setdefault(user, []).append(t)
    for u, ts in times.items():
        for t in set(ts):
            s = t // width
            full = sum(s - 16 <= x // width <= s - 1 for x in ts)
            oldest = sum(x // width == s - 16 for x in ts)
            now = sum(x // width == s and x <= t for x in ts)
            gone = int(oldest * ((t - s * width) * 16 / interval))
            expected[u, t] = (ts.count(t), full + now - gone)
    assert got == expected
