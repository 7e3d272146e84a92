"""Feed pages: the dialect matrix against plain Python, ties, paging, and hot users."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidefeed.operators import feed as Q
from tidefeed.operators import forms, store
from tidefeed.operators import requests
from tidefeed.operators.requests import (
    _needed_slices,
    batch_fetch,
    gen_requests,
    request_span,
)
from tidefeed.schema import INGESTED, MS_PER_DAY

AS_OF = 1_706_659_200_000
TTL = 3 * 86_400
OLDEST = AS_OF - TTL * 1000
F0 = AS_OF - 3_600_500       # a cursor that is also the time of a row

TIMES = [
    -5, 0, 1, OLDEST - 1, OLDEST, OLDEST + 1, F0 - 501, F0 - 500, F0 - 1, F0, F0 + 1, F0 + 499,
    F0 + 500, AS_OF - 1, AS_OF, AS_OF + 1, AS_OF + 999, AS_OF + 86_400_000,
]


def edge_rows():
    """Every edge time once or twice, for users that must not be mixed up."""
    rows, seq = [], 0
    for user in ("8", "8:", "a:b", "", "u"):
        for t in TIMES if user != "u" else TIMES[:3]:
            for copy in range(2 if t in (F0, OLDEST, AS_OF) else 1):
                rows.append((user, f"n{seq % 7}", t, f'{{"v":{seq}}}', seq))
                seq += 1
    return rows


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(edge_rows(), INGESTED)


# (dialect, direction, cursor given) -> does the range admit t?
ADMITS = {
    ("append", "desc", False): lambda t: True,
    ("append", "desc", True): lambda t: t < F0,
    ("append", "asc", False): lambda t: True,
    ("append", "asc", True): lambda t: t > F0,
    ("key_range", "desc", False): lambda t: 0 <= t <= AS_OF,
    ("key_range", "desc", True): lambda t: 0 <= t < F0,
    ("key_range", "asc", False): lambda t: t >= OLDEST,
    ("key_range", "asc", True): lambda t: t > F0,
    ("retention_range", "desc", False): lambda t: OLDEST <= t < AS_OF,
    ("retention_range", "desc", True): lambda t: OLDEST <= t < F0,
    ("retention_range", "asc", False): lambda t: OLDEST <= t < AS_OF,
    ("retention_range", "asc", True): lambda t: OLDEST <= t < F0,
    ("counted_points", "desc", False): lambda t: 0 <= t <= AS_OF,
    ("counted_points", "desc", True): lambda t: 0 <= t <= F0 - 500,
    ("counted_points", "asc", False): lambda t: 0 <= t <= AS_OF,
    ("counted_points", "asc", True): lambda t: F0 - 500 <= t <= AS_OF,
    ("inclusive_points", "desc", False): lambda t: 0 <= t <= AS_OF,
    ("inclusive_points", "desc", True): lambda t: 0 <= t <= F0,
    ("inclusive_points", "asc", False): lambda t: 0 <= t <= AS_OF,
    ("inclusive_points", "asc", True): lambda t: F0 <= t <= AS_OF,
}


@pytest.mark.parametrize("case", ADMITS, ids=str)
def test_admitted_times(spark, case):
    dialect, direction, given = case
    frame = spark.createDataFrame([(t,) for t in TIMES], "timestamp bigint")
    bounds = Q.admitted(dialect, direction, F0 if given else None, AS_OF, TTL)
    got = sorted(r.timestamp for r in bounds.apply(frame).collect())
    assert got == sorted(t for t in TIMES if ADMITS[case](t))


def by_python(rows, dialect, direction, user, cursor, limit):
    admits = ADMITS[(dialect, direction, cursor is not None)]
    kept = [r for r in rows if r[0] == user and admits(r[2])]
    if dialect == "key_range":
        latest = {}
        for r in sorted(kept, key=lambda r: r[4]):
            latest[r[2]] = r
        kept = list(latest.values())
    if dialect == "retention_range":
        merged = {}
        for r in sorted(kept, key=lambda r: (r[2], r[4])):
            first = merged.get(r[1], r)
            merged[r[1]] = (r[0], r[1], first[2], r[3], r[4])
        kept = list(merged.values())
    if dialect == "inclusive_points":
        latest = {}
        for r in sorted(kept, key=lambda r: r[4]):
            latest[(r[1], r[2])] = r
        kept = list(latest.values())
    kept.sort(key=lambda r: (r[2], r[1], r[4]), reverse=direction == "desc")
    return [tuple(r[:4]) for r in kept][:limit]


FETCH = {
    "append": lambda df, d, u, c, n: Q.feed(df, d, u, c, n),
    "key_range": lambda df, d, u, c, n: Q.feed_keyrange(df, d, AS_OF, u, c, TTL, n),
    "retention_range": lambda df, d, u, c, n: Q.feed_retention_range(df, d, AS_OF, u, c, TTL, n),
    "inclusive_points": lambda df, d, u, c, n: Q.inclusive_points(
        forms.encode_record_json(df), d, AS_OF, u, c),
}


@pytest.mark.parametrize("dialect, direction, cursor", list(itertools.product(
    FETCH, ("desc", "asc"), (None, F0))))
def test_page_of_one_user(edges, dialect, direction, cursor):
    limit = 5 if dialect != "inclusive_points" else 10**6
    for user in ("8", "u", "nobody"):
        got = [tuple(r) for r in FETCH[dialect](edges, direction, user, cursor, limit).collect()]
        assert got == by_python(edge_rows(), dialect, direction, user, cursor, limit)


@pytest.mark.parametrize("dialect", ["append", "key_range", "retention_range"])
@pytest.mark.parametrize("direction", ["desc", "asc"])
def test_pages_of_all_users(edges, dialect, direction):
    got = {}
    for r in FETCH[dialect](edges, direction, None, None, 4).orderBy("user_id", "rank").collect():
        got.setdefault(r.user_id, []).append(tuple(r)[:4])
    for user in ("8", "8:", "a:b", "", "u"):
        assert got.get(user, []) == by_python(edge_rows(), dialect, direction, user, None, 4)


def test_counted_points(edges):
    got = {
        (r.user_id, r.timestamp): (r.n, r.notify_id)
        for r in Q.counted_points(edges, "desc", AS_OF, "8|a:b").collect()
    }
    expected = {}
    for user, notify, t, _, _ in edge_rows():
        if user in ("8", "a:b") and 0 <= t <= AS_OF:
            expected.setdefault((user, t), set()).add(notify)
    assert got == {
        k: (len(v), next(iter(v)) if len(v) == 1 else None) for k, v in expected.items()
    }


@pytest.mark.parametrize("direction", ["desc", "asc"])
@pytest.mark.parametrize("cursor", [None, F0])
@pytest.mark.parametrize("user", ["8", "8:", "a:b", ""])
def test_row_key_scan_equals_key_range(edges, direction, cursor, user):
    keyed = store.with_row_key(edges.where("timestamp >= 0"))
    scan = Q.rowkey_range_scan(keyed, user, direction, AS_OF, cursor, TTL)
    same = Q.feed_keyrange(edges.where("timestamp >= 0"), direction, AS_OF, user, cursor, TTL)
    assert scan.collect() == same.collect()


def test_dialects_agree_on_plain_data(spark):
    rows = [("8", f"n{i:03d}", AS_OF - 7000 * i - 3, "{}", i) for i in range(100)]
    df = spark.createDataFrame(rows, INGESTED)
    cursor = AS_OF - 7000 * 40
    pages = [
        Q.feed(df, "desc", "8", cursor).collect(),
        Q.feed_keyrange(df, "desc", AS_OF, "8", cursor).collect(),
        Q.feed_retention_range(df, "desc", AS_OF, "8", cursor).collect(),
        Q.inclusive_points(forms.encode_record_json(df), "desc", AS_OF, "8", cursor).limit(
            20).collect(),
    ]
    assert all(p == pages[0] and len(p) == 20 for p in pages)


# ---- the whole walk, and hot users --------------------------------------------------------

def skewed_rows(seed=7, n=1500):
    """Half of the rows are one user's, and a third of those fall in one millisecond."""
    rng = random.Random(seed)
    rows = []
    for seq in range(n):
        user = "hot" if seq % 2 else str(rng.randrange(40))
        t = 5000 if user == "hot" and seq % 3 == 0 else rng.randrange(10_000)
        rows.append((user, f"n{rng.randrange(10**6)}", t, f'{{"v":{seq}}}', seq))
    return rows


@pytest.fixture(scope="module")
def skewed(spark):
    return spark.createDataFrame(skewed_rows(), INGESTED).repartition(6)


@pytest.mark.parametrize("direction", ["desc", "asc"])
def test_pages_concatenate_to_the_feed(skewed, direction):
    pages = Q.feed_pages(skewed, direction, 20)
    got = {}
    for r in pages.orderBy("user_id", "rank").collect():
        assert r.page == (r["rank"] - 1) // 20
        got.setdefault(r.user_id, []).append((r["rank"], r.notify_id, r.timestamp, r.data))
    expected = {}
    for r in sorted(skewed_rows(), key=lambda r: (r[2], r[1], r[4]), reverse=direction == "desc"):
        feed = expected.setdefault(r[0], [])
        feed.append((len(feed) + 1, r[1], r[2], r[3]))
    assert got == expected


def test_keyset_walk_loses_no_tied_rows(skewed):
    cursors = {
        r.page: r for r in Q.page_cursors(Q.feed_pages(skewed, "desc", 20)).where(
            "user_id = 'hot'").collect()
    }
    pages = Q.feed_pages(skewed, "desc", 20).where("user_id = 'hot'").orderBy("rank").collect()
    for page in (3, 12, 20):
        c = cursors[page]
        after = Q.feed_after(skewed, "desc", "hot", c.cursor_ms, c.cursor_id).collect()
        expected = [r for r in pages if r.page == page + 1]
        assert [(r.notify_id, r.timestamp) for r in after] == [
            (r.notify_id, r.timestamp) for r in expected
        ]


def request_rows():
    rng = random.Random(3)
    rows = []
    for n in range(240):
        user = "hot" if n % 3 else str(rng.randrange(45))
        cursor = rng.choice([None, 5000, 0, 9999, 20_000, -1, rng.randrange(10_000)])
        rows.append((n, user, cursor, rng.choice(["desc", "asc"])))
    return rows


@pytest.mark.parametrize(
    "slice_ms, limit", [(MS_PER_DAY, 20), (700, 20), (40, 20), (1, 3)])
def test_batch_fetch_answers_like_single_fetches(spark, skewed, slice_ms, limit):
    schema = "req_id bigint, user_id string, from_time bigint, direction string"
    asked = spark.createDataFrame(request_rows(), schema)
    got = {}
    for r in batch_fetch(skewed, asked, limit, slice_ms).orderBy("req_id", "rank").collect():
        got.setdefault(r.req_id, [])
        if r["rank"] is not None:
            got[r.req_id].append((r.user_id, r.notify_id, r.timestamp, r.data))
    rows = skewed_rows()
    for n, user, cursor, direction in request_rows():
        kept = [
            r for r in rows if r[0] == user and (
                cursor is None or (r[2] < cursor if direction == "desc" else r[2] > cursor))
        ]
        kept.sort(key=lambda r: (r[2], r[1], r[4]), reverse=direction == "desc")
        assert got[n] == [tuple(r[:4]) for r in kept[:limit]]


def test_only_slices_near_a_cursor_are_needed(spark):
    rows = [("u", f"n{i}", i * 10, "{}", i) for i in range(1000)]
    cursors = spark.createDataFrame(
        [("u", "desc", 5000), ("u", "asc", 8000), ("u", "desc", 1 << 62)],
        "user_id string, direction string, _at bigint")
    needed = _needed_slices(spark.createDataFrame(rows, INGESTED), cursors, 100, 20)
    # Ten rows in a slice: the cursor's own slice and the two whole ones beyond it.
    assert sorted(r._part for r in needed.collect()) == [48, 49, 50, 80, 81, 82, 98, 99]


def test_requests_without_user_or_direction_stay(spark, skewed):
    schema = "req_id bigint, user_id string, from_time bigint, direction string"
    asked = spark.createDataFrame([(1, None, None, "desc"), (2, "hot", None, None), (3, "none", 5, "asc")], schema)
    assert [(r.req_id, r["rank"]) for r in batch_fetch(skewed, asked).orderBy("req_id").collect()] == [
        (1, None), (2, None), (3, None)]
    wrong = spark.createDataFrame([(1, "hot", None, "DESC")], schema)
    with pytest.raises(Exception, match="unknown direction: DESC"):
        batch_fetch(skewed, wrong).count()


def test_batch_fetch_numbers_without_payload(spark, skewed, monkeypatch):
    """The payload is in no slice: it is fetched for the rows of pages alone."""
    seen = []
    original = requests.range_slices
    monkeypatch.setattr(requests, "range_slices", lambda df, *a: seen.append(df.columns) or original(df, *a))
    asked = spark.createDataFrame(
        [(1, "hot", None, "desc")], "req_id bigint, user_id string, from_time bigint, direction string")
    assert batch_fetch(skewed, asked).where("data is not null").count() == 20
    assert seen and all("data" not in columns for columns in seen)


def test_generated_requests(spark, edges):
    span = spark.createDataFrame([(7919, 50, 90)], "users bigint, min_ms bigint, max_ms bigint")
    rows = gen_requests(spark.range(4000), F.col("id"), span).collect()
    assert all(r.from_time is None or 50 <= r.from_time < 90 for r in rows)
    assert all((r.from_time is None) == (r.phase == "first") for r in rows)
    assert len({r.user_id for r in rows}) > 2000
    # Every phase and direction goes to even and odd users alike.
    kinds = {(int(r.user_id) % 2, r.phase, r.direction) for r in rows}
    assert len(kinds) == 8
    assert request_span(edges.where("user_id = '8'")).first().users == 9


def test_bad_request_settings_fail(spark):
    table = spark.createDataFrame([(10, 5, 5)], "users bigint, min_ms bigint, max_ms bigint")
    with pytest.raises(Exception, match="min_ms must be below max_ms"):
        gen_requests(spark.range(2), F.col("id"), table).collect()


def test_keyset_walk_keeps_rows_of_one_time_and_id(spark):
    rows = [("u", "n", 5, f'{{"k":{i}}}', i) for i in range(3)] + [("u", "m", 4, "{}", 9)]
    table = spark.createDataFrame(rows, INGESTED)
    first = Q.feed_after(table, "desc", "u", 9, "", limit=2).collect()
    assert [r.data for r in first] == ['{"k":2}', '{"k":1}']
    after = Q.feed_after(table, "desc", "u", 5, "n", cursor_seq=1).collect()
    assert [r.data for r in after] == ['{"k":0}', "{}"]
    back = Q.feed_after(table, "asc", "u", 5, "n", cursor_seq=0).collect()
    assert [r.data for r in back] == ['{"k":1}', '{"k":2}']
