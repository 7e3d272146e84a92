"""Jumping to a page by the index, and whole ranges by slices of time, against the plain forms."""

import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from tidefeed.operators import feed as Q
from tidefeed.operators import requests, store
from tidefeed.operators.identity import BY_POINT, upsert_latest
from tidefeed.schema import INGESTED, MS_PER_DAY
from tidefeed.session import written
from tidefeed.sources import derived
from tidefeed.sources.notifications import read_feed

AS_OF = 1_706_659_200_000


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows of one user in one millisecond, a null user, and days without rows."""
    feed = derived.hourly(derived.notifications(spark, SF_DIR)).where("ingest_seq < 500")
    hot = spark.range(300).select(
        F.lit("8").alias("user_id"), F.col("id").cast("string").alias("notify_id"), F.lit(AS_OF - 40 * MS_PER_DAY).alias("timestamp"),
        F.lit("{}").alias("data"), (F.col("id") + 10_000).alias("ingest_seq"))
    nobody = feed.where("ingest_seq % 25 = 0").withColumn("user_id", F.lit(None).cast("string"))
    return written(feed.unionByName(hot).unionByName(nobody.withColumn("ingest_seq", F.col("ingest_seq") + 50_000)), "skewed")


@pytest.mark.parametrize("direction", [Q.DESC, Q.ASC])
def test_every_page_equals_the_walk(spark, skewed, folder, direction):
    store.append(skewed, f"{folder}/feed")
    table = read_feed(spark, f"{folder}/feed")
    index = written(Q.page_index(table), "index")
    walk = {}
    for row in Q.feed_pages(skewed, direction, 7).collect():
        walk.setdefault(row.page, []).append(tuple(row))
    for number in (0, 1, 3, 40, 200):
        got = Q.feed_page(table, index, number, direction, limit=7)
        assert sorted(map(tuple, got.collect()), key=str) == sorted(walk.get(number, []), key=str)
        one = Q.feed_page(table, index, number, direction, "8", 7)
        assert sorted(map(tuple, one.collect())) == sorted(r for r in walk.get(number, []) if r[0] == "8")
    assert Q.feed_page(table, index, 0, direction, "nobody").count() == 0
    with pytest.raises(ValueError):
        Q.feed_page(table, index, -1)


def test_a_page_reads_its_days_only(spark, skewed, folder):
    store.append(skewed, f"{folder}/feed")
    table = read_feed(spark, f"{folder}/feed")
    index = written(Q.page_index(table), "index")
    late = Q.feed_page(table, index, 2, Q.DESC, "3", 5)
    days = {r.d for r in late.select(F.from_unixtime(F.col("timestamp") / 1000, "yyyy-MM-dd").alias("d")).collect()}
    plan = late._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    named = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "day" in named and len(days) <= 5 and named.count("2024-") + named.count("day#") <= 2 * len(days) + 4
    assert scan.count("PushedFilters") == 1 and "EqualTo(user_id,3)" in scan


def test_an_empty_feed_has_no_pages(spark, skewed):
    none = skewed.limit(0)
    assert Q.page_index(none).count() == 0
    assert Q.feed_page(none, Q.page_index(none), 0).count() == 0


# ---- whole ranges ---------------------------------------------------------------------------

def asked(spark):
    rows = [(i, ["8", "3", "5", "nobody", None][i % 5], [Q.DESC, Q.ASC][i % 2],
             None if i % 3 == 0 else AS_OF - (i * 7919 % 60) * MS_PER_DAY + i * 1_234_567) for i in range(60)]
    rows += [(100, "8", None, 5), (101, "8", Q.ASC, AS_OF + 5), (102, "8", Q.DESC, -5), (103, "3", Q.DESC, 1), (7, "3", Q.ASC, None), (7, "3", Q.ASC, None)]
    return spark.createDataFrame(rows, "req_id long, user_id string, direction string, from_time long")


def plain(requests_rows, rows, low_of, high_of, columns):
    out = []
    for q in requests_rows:
        found = [r for r in rows if q.user_id is not None and q.direction is not None and r.user_id == q.user_id
                 and low_of(q) <= r.timestamp <= high_of(q)]
        known = (q.req_id, q.user_id, q.direction, q.from_time)
        out += [(*known, *[r[c] for c in columns]) for r in found] or [(*known, *[None] * len(columns))]
    return sorted(out, key=str)


@pytest.mark.parametrize("slice_ms", [MS_PER_DAY, 3_600_000 * 5, 400 * MS_PER_DAY])
def test_ranges_equal_the_plain_join(spark, skewed, slice_ms):
    got = requests.batch_fetch_dialect(skewed, asked(spark), "inclusive_points", AS_OF, slice_ms=slice_ms)
    latest = upsert_latest(skewed, BY_POINT).collect()
    low = lambda q: 0 if q.direction == Q.DESC or q.from_time is None else q.from_time
    high = lambda q: q.from_time if q.direction == Q.DESC and q.from_time is not None else AS_OF
    assert sorted(map(tuple, got.collect()), key=str) == plain(
        asked(spark).collect(), latest, low, high, ["notify_id", "timestamp", "data"])


def test_ranges_of_an_empty_feed(spark, skewed):
    got = requests.batch_fetch_dialect(skewed.limit(0), asked(spark), "counted_points", AS_OF)
    assert got.columns == ["req_id", "user_id", "direction", "from_time", "notify_id", "timestamp", "n"]
    assert got.count() == 66 and got.where("timestamp is not null").count() == 0


def test_a_busy_user_is_dealt_by_slice(spark, skewed):
    """Rows meet requests by user and slice of time, never by the user alone."""
    got = requests.batch_fetch_dialect(skewed, asked(spark), "inclusive_points", AS_OF)
    plan = got._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "user_id" in line]
    assert joins and all("_slice" in line for line in joins) and "NestedLoop" not in plan


def test_one_payload_for_each_row_on_a_page(spark, skewed):
    """Many requests for the same pages: the payload is joined to distinct rows, before pages fan out."""
    many = spark.range(3000).select(
        F.col("id").alias("req_id"), F.lit("8").alias("user_id"), F.when(F.col("id") % 2 == 0, Q.DESC).otherwise(Q.ASC).alias("direction"),
        F.when(F.col("id") % 5 > 0, F.lit(AS_OF) - F.col("id") % 50 * MS_PER_DAY).alias("from_time"))
    got = requests.batch_fetch(skewed, many)
    by_cursor = {}
    for row in got.collect():
        by_cursor.setdefault((row.direction, row.from_time), {}).setdefault(row.req_id, []).append((row.rank, row.notify_id, row.timestamp, row.data))
    for (direction, cursor), pages in by_cursor.items():
        expected = [(k, r.notify_id, r.timestamp, r.data) for k, r in enumerate(Q.feed(skewed, direction, "8", cursor).collect(), 1)]
        assert all(sorted(p, key=str) == sorted(expected or [(None, None, None, None)], key=str) for p in pages.values())


def test_schema_of_answers(spark, skewed):
    got = requests.batch_fetch(skewed, asked(spark))
    assert got.columns == ["req_id", "user_id", "direction", "from_time", "rank", "notify_id", "timestamp", "data"]
    assert set(INGESTED.names) >= {"notify_id", "timestamp", "data"}


@pytest.mark.parametrize("together", [1, 3, 10**6])
def test_ranges_of_busy_users(spark, skewed, monkeypatch, together):
    """However few rows are kept together, and with slices that a request reaches without a row inside."""
    monkeypatch.setattr(requests, "ROWS_TOGETHER", together)
    got = requests.batch_fetch_dialect(skewed, asked(spark), "inclusive_points", AS_OF)
    latest = upsert_latest(skewed, BY_POINT).collect()
    low = lambda q: 0 if q.direction == Q.DESC or q.from_time is None else q.from_time
    high = lambda q: q.from_time if q.direction == Q.DESC and q.from_time is not None else AS_OF
    assert sorted(map(tuple, got.collect()), key=str) == plain(
        asked(spark).collect(), latest, low, high, ["notify_id", "timestamp", "data"])


@pytest.mark.parametrize("dialect", ["counted_points", "inclusive_points"])
def test_ranges_broadcast_no_requests(spark, skewed, dialect):
    """Dealt requests have another size than their file: neither they nor the rows are broadcast."""
    asked_in_file = written(asked(spark), "asked")
    got = requests.batch_fetch_dialect(skewed, asked_in_file, dialect, AS_OF)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "_chunk" in line]
    assert joins and all("strategy=merge" in line for line in joins)
    physical = got._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in physical.splitlines() if "BroadcastHashJoin" in line and "_chunk" in line]


# ---- pages cut from blocks ------------------------------------------------------------------

def long_feed(spark):
    """Two users with 400 rows each, rows without an id or a sequence, and one row written four times."""
    rows = [(u, None if i % 7 == 0 else f"n{i:04d}", i // 3, f'{{"k":{i}}}', None if i % 11 == 0 else i) for u in ("u", "v") for i in range(400)]
    return spark.createDataFrame(rows + [("v", "n0200", 66, '{"k":200}', 200)] * 3, "user_id string, notify_id string, timestamp long, data string, ingest_seq long")


@pytest.mark.parametrize("pages_together, limit", [(1, 1), (1, 20), (4, 20), (4, 7)])
def test_pages_are_cut_from_blocks(spark, monkeypatch, pages_together, limit):
    """Few cursors far apart leave gaps between pages; pages begin at every place of a block and end in the next."""
    monkeypatch.setattr(requests, "BLOCK_PAGES", pages_together)
    feed = written(long_feed(spark), "feed")
    cursors = [None, -5, 0, 1, 20, 21, 22, 26, 27, 66, 67, 90, 133, 500]
    rows = [(n * 2 + k, "uv"[n % 2], (Q.DESC, Q.ASC)[k], c) for n, c in enumerate(cursors * 2) for k in (0, 1)]
    got = {}
    asked_now = spark.createDataFrame(rows, "req_id long, user_id string, direction string, from_time long")
    for r in requests.batch_fetch(feed, asked_now, limit, 5).collect():
        got.setdefault(r.req_id, []).append((r["rank"], r.timestamp, r.notify_id, r.data))
    lowest = lambda r: (r.timestamp, r.notify_id is not None, r.notify_id or "", -1 if r.ingest_seq is None else r.ingest_seq)
    everything = feed.collect()
    for n, user, direction, c in rows:
        kept = sorted((r for r in everything if r.user_id == user and (
            c is None or (r.timestamp < c if direction == Q.DESC else r.timestamp > c))), key=lowest, reverse=direction == Q.DESC)
        page = [(k, r.timestamp, r.notify_id, r.data) for k, r in enumerate(kept[:limit], 1)]
        assert sorted(got[n], key=str) == sorted(page or [(None,) * 4], key=str)


def test_a_request_meets_one_block(spark, skewed):
    """A page is one lookup, not one for each of its rows."""
    plan = requests.batch_fetch(skewed, asked(spark))._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert any("_block" in line for line in joins) and not any("_spot" in line or "_place" in line for line in joins)


def test_slices_are_looked_for_only_where_some_can_be_left_out(spark, skewed, monkeypatch):
    looked = []
    original = requests._near_cursors
    monkeypatch.setattr(requests, "_near_cursors", lambda *a: looked.append(1) or original(*a))
    few = asked(spark).where("req_id < 3")
    expected = sum(Q.feed(skewed, r.direction, r.user_id, r.from_time).count() for r in few.collect())
    assert requests.batch_fetch(skewed, few).where("rank is not null").count() == expected > 20
    assert looked
    looked.clear()
    assert requests.batch_fetch(skewed, asked(spark)).where("req_id = 0").count() == 20
    assert not looked


# ---- last payloads within the retention -----------------------------------------------------

def test_only_ids_that_reach_a_cursor_are_looked_up(spark, monkeypatch):
    """Ids with several rows, ties, missing payloads, ids and sequences, against the plain form."""
    day = MS_PER_DAY
    rows = [("u", f"n{i // 4}", AS_OF - 10 * day + i * 1000, None if i % 9 == 0 else f'{{"k":{i}}}', i) for i in range(160)]
    rows += [("u", None, AS_OF - 9 * day + i, f'{{"none":{i}}}', i) for i in range(3)]
    rows += [("u", "tie", AS_OF - 8 * day, f'{{"t":{i}}}', None if i == 2 else i) for i in range(3)]
    rows += [("v", "old", AS_OF - 40 * day, "{}", 1), ("v", "old", AS_OF - day, '{"new":1}', 2), ("v", "ahead", AS_OF + day, "{}", 3)] * 2
    feed = spark.createDataFrame(rows, INGESTED)
    ends = [None, AS_OF - 10 * day + 1, AS_OF - 10 * day + 50_000, AS_OF - 10 * day + 81_500, AS_OF - 9 * day + 2, AS_OF - 8 * day, AS_OF - 50 * day, AS_OF + 2 * day]
    wanted = [(n * 4 + k, "uv"[k // 2], (Q.DESC, Q.ASC)[k % 2], c) for n, c in enumerate(ends) for k in range(4)] + [(90, "w", Q.ASC, None), (91, None, Q.ASC, None)]
    sizes = []
    original = requests.batch_fetch
    monkeypatch.setattr(requests, "batch_fetch", lambda df, asked, *a: sizes.append(asked.count()) or original(df, asked, *a))
    got = {}
    found = requests.batch_fetch_dialect(
        feed, spark.createDataFrame(wanted, "req_id long, user_id string, direction string, from_time long"), "retention_range", AS_OF, 30 * 24 * 3600)
    for r in found.collect():
        got.setdefault(r.req_id, []).append((r["rank"], r.notify_id, r.timestamp, r.data))
    looked_up = set()
    for req, user, direction, c in wanted:
        end, by_id = AS_OF if c is None else c, {}
        for r in rows:
            if r[0] == user and AS_OF - 30 * day <= r[2]:
                by_id.setdefault(r[1], []).append(r)
        page = []
        for ident, versions in by_id.items():
            before = [r for r in versions if r[2] < end]
            if before:
                newest = max(before, key=lambda r: (r[2], -1 if r[4] is None else r[4]))
                page.append((min(r[2] for r in versions), ident is not None, ident or "", ident, newest[3], len(before) < len(versions)))
        page = sorted(page, key=lambda r: r[:3], reverse=direction == Q.DESC)[:20]
        looked_up |= {(user, p[3], end) for p in page if p[5]}
        expected = [(k, p[3], p[0], p[4]) for k, p in enumerate(page, 1)]
        assert sorted(got[req], key=str) == sorted(expected or [(None,) * 4], key=str)
    assert sizes == [len(looked_up)] and 0 < len(looked_up) < 10
