"""The same results in SQL, for the tables as DuckDB sees them."""

from __future__ import annotations

AS_OF = 1706659200000
CURSOR = 1705320000000
DAY = 86400000
HOUR = 3600000
TTL = 3 * DAY
LONG_TTL = 30 * DAY
HALF = 1 << 40

FEED = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS notify_id,
  epoch_us(ts) // 1000 AS timestamp, props AS data, event_id AS ingest_seq FROM events"""
HOURLY = f"""SELECT user_id, notify_id, timestamp // {HOUR} * {HOUR} AS timestamp, data,
  ingest_seq FROM ({FEED})"""
SHARED = f"""SELECT user_id, user_id || '-' || CAST(timestamp // {DAY} AS VARCHAR) AS notify_id,
  timestamp, data, ingest_seq FROM ({FEED})"""
REPLAYED = f"""SELECT * FROM ({FEED}) UNION ALL
  SELECT * FROM ({FEED}) WHERE ingest_seq % 10 = 0"""
DIRTY = """SELECT CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS user_id,
  CASE WHEN event_id % 97 <> 0 THEN CAST(event_id AS VARCHAR) END AS notify_id,
  epoch_us(ts) // 1000 AS timestamp,
  CASE event_id % 89 WHEN 0 THEN NULL WHEN 1 THEN '{bad' WHEN 2 THEN '[1]' WHEN 3 THEN '{"k": 1, "k": 2}'
    WHEN 4 THEN '{}' WHEN 5 THEN '{"k": 1' WHEN 6 THEN '{"k": 1} and more' ELSE props END AS data,
  event_id AS ingest_seq FROM events"""
IS_OBJECT = "coalesce(json_valid(data) AND data LIKE '{%', false)"
REASONED = f"""SELECT *, CASE WHEN user_id IS NULL THEN 'user_id'
  WHEN notify_id IS NULL THEN 'notify_id' WHEN NOT {IS_OBJECT} THEN 'data' ELSE '' END
  AS reject_reason FROM ({DIRTY})"""
LARGE = f"""SELECT notify_id, CASE WHEN {IS_OBJECT} THEN '' ELSE 'data' END AS reject_reason, length(data) AS n_chars,
  CASE WHEN {IS_OBJECT} THEN CAST(json_extract(data, '$.k') AS BIGINT) ELSE 0 END AS k,
  CASE WHEN {IS_OBJECT} THEN length(data) ELSE 2 END AS n_kept
  FROM (SELECT notify_id, CASE ingest_seq % 291
    WHEN 0 THEN '{{"k": 7, "a": ' || repeat('[', 1200) || repeat(']', 1200) || '}}'
    WHEN 1 THEN '{{"' || repeat('n', 60000) || '": 1, "k": 7}}'
    WHEN 2 THEN '{{"x": ' || repeat('9', 1500) || ', "k": 7}}'
    WHEN 3 THEN '{{"k": 7, "a": ' || repeat('{{"b":', 1100) || '[]' || repeat('}}', 1100) || '}}'
    WHEN 4 THEN '{{"k": 7, "a": ' || repeat('[', 1200) || repeat(']', 1199) || '}}'
    WHEN 5 THEN '{{"' || repeat('n', 60000) || '": 1, "k": 7'
    WHEN 6 THEN '{{"x": 0' || repeat('9', 1500) || ', "k": 7}}'
    WHEN 7 THEN '{{"x": ' || repeat('9', 1500) || '}} {{}}' ELSE data END AS data FROM ({FEED}))"""
SHARED_POINTS = f"""SELECT 'notifications' AS measurement, user_id, notify_id, timestamp AS time,
  ingest_seq, 'data' AS field, data AS value FROM ({SHARED}) WHERE data IS NOT NULL"""
SERIES = f"""SELECT row_number() OVER (ORDER BY later, measurement, user_id, notify_id) AS series_id, measurement, user_id, notify_id
  FROM (SELECT measurement, user_id, notify_id, min(time) >= {CURSOR} AS later
  FROM ({SHARED_POINTS}) GROUP BY measurement, user_id, notify_id)"""
TYPED = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS notify_id,
  epoch_us(ts) // 1000 AS timestamp, props AS data, event_type FROM events"""
LATENCY = "CAST(round(value * 100) AS BIGINT)"
LOG = f"""SELECT CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END AS backend,
  event_type AS phase, epoch_us(ts) // 1000 AS start_ms, {LATENCY} AS latency_ms,
  epoch_us(ts) // 1000 + {LATENCY} AS end_ms, event_id % 10 <> 0 AS ok FROM events"""
K = "json_extract_string(props, '$.k')"
MONITOR = f"""SELECT CAST(event_id AS VARCHAR) AS "requestID", CAST(user_id AS VARCHAR) AS "userID",
  CAST(user_id % 10 AS VARCHAR) AS "groupID", event_type AS step, {LATENCY} AS duration,
  (CASE WHEN user_id % 3 = 0 THEN 'other_' ELSE 'node_' END) || (user_id % 4) AS "nodeName",
  epoch_us(ts) // 1000 AS timestamp,
  '{{' || concat_ws(',',
    CASE event_id % 50 WHEN 0 THEN NULL WHEN 1 THEN '"size":"' || {K} || '"'
      WHEN 2 THEN '"size":12.7' ELSE '"size":' || {K} END,
    CASE WHEN event_id % 50 <> 3 THEN '"requestedTimestamp":'
      || CAST(epoch_us(ts) // 1000 - {LATENCY} * 1000 AS VARCHAR) END) || '}}' AS extension
  FROM events"""
SIZE = """coalesce(CAST(trunc(TRY_CAST(json_extract_string(extension, '$.size') AS DOUBLE))
  AS BIGINT), 0)"""
REQUESTED = """coalesce(TRY_CAST(json_extract_string(extension, '$.requestedTimestamp')
  AS BIGINT), 0)"""


def hours(ms: str) -> str:
    """Milliseconds as hours, rounded half up to hundredths in whole numbers: DuckDB's round()
    of a double takes 0.285 for a little less."""
    return f"((({ms}) * 100 + {HOUR // 2}) // {HOUR} / 100.0::DOUBLE)"


REPORT = f"""SELECT step, "requestID", duration, {SIZE} AS size,
  {hours(f'timestamp - {REQUESTED}')} AS distance
  FROM ({MONITOR}) WHERE contains("nodeName", 'node_')"""

COLS = "user_id, notify_id, timestamp, data"


def user_page(table: str, direction: str, where: str = "TRUE") -> str:
    return f"""SELECT {COLS} FROM ({table}) WHERE user_id = '8' AND {where}
      ORDER BY timestamp {direction}, notify_id {direction} LIMIT 20"""


def all_pages(table: str, direction: str, where: str = "TRUE") -> str:
    return f"""SELECT {COLS}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id
      ORDER BY timestamp {direction}, notify_id {direction}) AS INTEGER) AS rank
      FROM ({table}) WHERE {where}) WHERE rank <= 20"""


def latest(table: str, identity: str, columns: str = "*") -> str:
    return f"""SELECT {columns} FROM (SELECT *, row_number() OVER (PARTITION BY {identity}
      ORDER BY ingest_seq DESC) AS rn FROM ({table})) WHERE rn = 1"""


ALL = f"{COLS}, ingest_seq"


def merged(table: str, where: str = "TRUE") -> str:
    return f"""SELECT user_id, notify_id, min(timestamp) AS timestamp,
      arg_max(data, timestamp) AS data FROM ({table}) WHERE {where} GROUP BY user_id, notify_id"""


def counted(where: str) -> str:
    return f"""SELECT user_id, timestamp, count(DISTINCT notify_id) AS n,
      CASE WHEN count(DISTINCT notify_id) = 1 THEN min(notify_id) END AS notify_id
      FROM ({HOURLY}) WHERE {where} GROUP BY user_id, timestamp"""


def pages(direction: str) -> str:
    return f"""SELECT {COLS}, rank, (rank - 1) // 20 AS page FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id
        ORDER BY timestamp {direction}, notify_id {direction}) AS rank FROM ({HOURLY}))"""


def page_cursors(direction: str, pick: str) -> str:
    return f"""SELECT user_id, page, count(*) AS "rows",
      {pick}({{'t': timestamp, 'i': notify_id}}).t AS cursor_ms,
      {pick}({{'t': timestamp, 'i': notify_id}}).i AS cursor_id,
      CAST({pick}({{'t': timestamp, 'i': notify_id}}).i AS BIGINT) AS cursor_seq
      FROM ({pages(direction)}) GROUP BY user_id, page"""


def java_hash(text: str) -> str:
    """Over code points below 65536, which covers the given tables."""
    total = f"""list_reduce(list_transform(string_split({text}, ''),
      lambda c: CAST(unicode(c) AS BIGINT)), lambda a, c: (a * 31 + c) % 4294967296, 0::BIGINT)"""
    return f"""(SELECT CASE WHEN t >= 2147483648 THEN t - 4294967296 ELSE t END
      FROM (SELECT {total} AS t))"""


def hashed(table: str) -> str:
    """``table`` with the hash of its users, computed once per user."""
    return f"""SELECT f.*, u.hash FROM ({table}) f JOIN (SELECT user_id, {java_hash('user_id')}
      AS hash FROM (SELECT DISTINCT user_id FROM ({table}))) u ON f.user_id = u.user_id"""


ROW_KEY = """hex(encode(CAST(abs(hash % 6) AS VARCHAR) || '-' || user_id || ':'))
  || lpad(hex(timestamp), 16, '0')"""


def base32(value: str, width: int) -> str:
    digits = " || ".join(
        f"substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST({value} >> {5 * i} & 31 AS INTEGER) + 1, 1)"
        for i in range(width - 1, -1, -1)
    )
    return f"({digits})"


def half(seed: str, at: int) -> str:
    return f"CAST('0x' || substr(md5({seed}), {at}, 10) AS BIGINT)"


def with_halves(table: str, seed: str) -> str:
    return f"""SELECT *, {half(seed, 1)} AS hi40, {half(seed, 11)} AS lo40 FROM ({table})"""


ULID = f"{base32('timestamp', 10)} || {base32('hi40', 8)} || {base32('lo40', 8)}"
ID_SEED = "'id|' || CAST(ingest_seq AS VARCHAR)"


def spoiled(table: str) -> str:
    return f"""SELECT user_id, ingest_seq, timestamp, hi40, lo40, CASE ingest_seq % 40
      WHEN 0 THEN substr(good, 1, 25) WHEN 1 THEN substr(good, 1, 25) || 'U'
      WHEN 2 THEN '8' || substr(good, 2) WHEN 3 THEN lower(good)
      WHEN 4 THEN translate(good, '01', 'OI') WHEN 5 THEN translate(good, '01', 'ol')
      ELSE good END AS ulid, good
      FROM (SELECT *, {ULID} AS good FROM ({with_halves(table, ID_SEED)}))"""


MONOTONIC = f"""SELECT ingest_seq, timestamp, hi40 + low // {HALF} AS carried, low % {HALF} AS lo40
  FROM (SELECT ingest_seq, timestamp,
    CASE WHEN timestamp // {HOUR} % 10 = 0 THEN {HALF - 1} ELSE hi40 END AS hi40,
    CASE WHEN timestamp // {HOUR} % 10 = 0 THEN {HALF - 3} ELSE lo40 END
      + row_number() OVER (PARTITION BY timestamp ORDER BY ingest_seq) - 1 AS low
    FROM ({with_halves(HOURLY, "'ms|' || CAST(timestamp AS VARCHAR)")}))"""

SPAN = f"""SELECT max(CAST(user_id AS BIGINT)) + 1 AS users, min(timestamp) AS lo,
  max(timestamp) AS hi FROM ({FEED})"""


def drawn(name: str) -> str:
    return half(f"'{name}|' || ingest_seq", 1)


REQUESTS = f"""SELECT ingest_seq AS req_id,
  CAST({drawn('request user')} % users AS VARCHAR) AS user_id,
  CASE WHEN {drawn('request phase')} % 2 = 1 THEN lo + {drawn('request time')} % (hi - lo) END
    AS from_time,
  CASE WHEN {drawn('request direction')} % 2 = 0 THEN 'desc' ELSE 'asc' END AS direction,
  CASE WHEN {drawn('request phase')} % 2 = 1 THEN 'more' ELSE 'first' END AS phase
  FROM ({FEED}), ({SPAN})"""


BATCH = f"""WITH n AS ({HOURLY}), r AS ({REQUESTS}),
  j AS (SELECT r.req_id, n.notify_id, n.timestamp, n.data, CASE WHEN r.direction = 'desc'
      THEN row_number() OVER (PARTITION BY r.req_id ORDER BY n.timestamp DESC, n.notify_id DESC)
      ELSE row_number() OVER (PARTITION BY r.req_id ORDER BY n.timestamp, n.notify_id) END AS rank
    FROM r JOIN n ON n.user_id = r.user_id AND (r.from_time IS NULL
      OR (r.direction = 'desc' AND n.timestamp < r.from_time)
      OR (r.direction = 'asc' AND n.timestamp > r.from_time)))
  SELECT r.req_id, r.user_id, r.direction, CAST(r.from_time AS VARCHAR) AS from_time,
    CAST(j.rank AS VARCHAR) AS rank, j.notify_id, CAST(j.timestamp AS VARCHAR) AS timestamp, j.data
  FROM r LEFT JOIN (SELECT * FROM j WHERE rank <= 20) j ON j.req_id = r.req_id"""

BATCH_AT = AS_OF - DAY
SHARED_TWICE = f"""SELECT * FROM ({SHARED}) UNION ALL SELECT * FROM ({SHARED}) WHERE ingest_seq % 10 = 0"""


def _answers(rows: str, inside: str, columns: str) -> str:
    """Requests with every row of their user that lies inside; requests without rows stay."""
    return f"""WITH n AS ({rows}), r AS ({REQUESTS})
      SELECT r.req_id, r.user_id, r.direction, CAST(r.from_time AS VARCHAR) AS from_time, {columns}
      FROM r LEFT JOIN n ON n.user_id = r.user_id AND {inside}"""


def _ranked(rows: str) -> str:
    """The first 20 of (req_id, direction, notify_id, timestamp, data) rows per request."""
    return f"""SELECT r.req_id, r.user_id, r.direction, CAST(r.from_time AS VARCHAR) AS from_time,
        CAST(j.rank AS VARCHAR) AS rank, j.notify_id, CAST(j.timestamp AS VARCHAR) AS timestamp, j.data
      FROM ({REQUESTS}) r LEFT JOIN (SELECT * FROM (SELECT *, CASE WHEN direction = 'desc'
          THEN row_number() OVER (PARTITION BY req_id ORDER BY timestamp DESC, notify_id DESC)
          ELSE row_number() OVER (PARTITION BY req_id ORDER BY timestamp, notify_id) END AS rank
        FROM ({rows})) WHERE rank <= 20) j ON j.req_id = r.req_id"""


BATCH_KEY_RANGE = _ranked(f"""SELECT r.req_id, r.direction, n.* FROM ({REQUESTS}) r JOIN (
    SELECT user_id, timestamp, arg_max(notify_id, ingest_seq) AS notify_id, arg_max(data, ingest_seq) AS data
    FROM (SELECT * REPLACE (timestamp // {HOUR} * {HOUR} AS timestamp) FROM ({SHARED_TWICE}))
    GROUP BY user_id, timestamp) n ON n.user_id = r.user_id AND CASE
      WHEN direction = 'desc' THEN timestamp >= 0 AND CASE WHEN from_time IS NULL THEN timestamp <= {BATCH_AT}
        ELSE timestamp < from_time END
      WHEN from_time IS NULL THEN timestamp >= {BATCH_AT - 10 * TTL} ELSE timestamp > from_time END""")
BATCH_RETENTION = _ranked(f"""SELECT r.req_id, r.direction, n.notify_id, min(timestamp) AS timestamp,
    arg_max(data, timestamp * 1000000 + ingest_seq) AS data
  FROM ({REQUESTS}) r JOIN ({SHARED_TWICE}) n ON n.user_id = r.user_id
    AND timestamp >= {BATCH_AT - 4 * TTL} AND timestamp < coalesce(from_time, {BATCH_AT})
  GROUP BY r.req_id, r.direction, n.notify_id""")
_LOW = "CASE WHEN direction = 'desc' THEN 0 ELSE coalesce(from_time, 0) END"
_HIGH = f"CASE WHEN direction = 'desc' THEN coalesce(from_time, {BATCH_AT}) ELSE {BATCH_AT} END"
BATCH_COUNTED = _answers(
    f"""SELECT user_id, timestamp, count(*) AS n, CASE WHEN count(*) = 1 THEN min(notify_id) END AS notify_id
      FROM (SELECT DISTINCT user_id, notify_id, timestamp FROM ({SHARED_TWICE})) GROUP BY user_id, timestamp""",
    f"timestamp BETWEEN ({_LOW}) // 1000 * 1000 AND ({_HIGH}) // 1000 * 1000",
    "notify_id, CAST(timestamp AS VARCHAR) AS timestamp, CAST(n AS VARCHAR) AS n")
BATCH_INCLUSIVE = _answers(
    f"""SELECT user_id, notify_id, timestamp, arg_max(data, ingest_seq) AS data FROM ({SHARED_TWICE})
      GROUP BY user_id, notify_id, timestamp""",
    f"timestamp BETWEEN {_LOW} AND {_HIGH}", "notify_id, CAST(timestamp AS VARCHAR) AS timestamp, data")

WIDTH = DAY // 16
SLICED = f"""WITH e AS (SELECT user_id, timestamp, count(*) AS n, timestamp // {WIDTH} AS s
    FROM ({FEED}) GROUP BY user_id, timestamp),
  c AS (SELECT user_id, s, CAST(sum(n) AS BIGINT) AS n FROM e GROUP BY user_id, s),
  p AS (SELECT e.user_id, e.timestamp, e.n, e.s,
      (SELECT coalesce(sum(c.n), 0) FROM c WHERE c.user_id = e.user_id
        AND c.s BETWEEN e.s - 16 AND e.s - 1) AS full_slices,
      (SELECT coalesce(sum(c.n), 0) FROM c WHERE c.user_id = e.user_id AND c.s = e.s - 16)
        AS oldest,
      sum(e.n) OVER (PARTITION BY e.user_id, e.s ORDER BY e.timestamp) AS so_far FROM e)
  SELECT user_id, timestamp, n, CAST(full_slices + so_far
    - floor(oldest * ((timestamp - s * {WIDTH}) * 16 / {DAY}.0::DOUBLE)) AS BIGINT) AS trailing_count
  FROM p"""

PERCENTILES = ", ".join(f"quantile_disc(v, {p / 100}) AS p{p}" for p in (0, 1, 50, 95, 100))


def trailing_seconds(interval: int, named: bool = False) -> str:
    """Events of the last interval per user and second with an event, both ends included."""
    extra = f", CAST({interval} AS BIGINT) AS interval_ms" if named else ""
    return f"""SELECT user_id, timestamp, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY timestamp
        RANGE BETWEEN {interval} PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_count{extra} FROM (
        SELECT user_id, timestamp // 1000 * 1000 AS timestamp, count(*) AS n FROM ({FEED}) GROUP BY ALL)"""


ORACLE: dict[str, str] = {
    "s01_load_notifications": FEED,
    "s02_load_monitor_log": MONITOR,
    "s03_gen_notifications": f"""SELECT CAST({half("'user|' || ingest_seq", 1)} % 1000 AS VARCHAR)
      AS user_id, {ULID} AS notify_id, timestamp, '{{"foo":"bar"}}' AS data, ingest_seq
      FROM ({with_halves(FEED, ID_SEED)})""",
    "w01_validate_split": REASONED,
    "w01_valid_rows": f"SELECT {ALL} FROM ({REASONED}) WHERE reject_reason = ''",
    "w02_append": f"""SELECT {ALL}, strftime(make_timestamp(timestamp // {DAY} * {DAY} * 1000),
      '%Y-%m-%d') AS day FROM ({FEED})""",
    "w02_append_validated": REASONED,
    "w03_upsert_by_time": latest(HOURLY, "user_id, timestamp", ALL),
    "w03_upsert_by_point": HOURLY,
    "w03_compact_days": f"""SELECT {ALL} FROM ({HOURLY}) WHERE timestamp < {AS_OF - 9 * DAY}
      UNION ALL {latest(f'SELECT * FROM ({HOURLY}) WHERE timestamp >= {AS_OF - 9 * DAY}',
                        'user_id, timestamp', ALL)}""",
    "w04_append_microbatch": FEED,
    "w05_truncate": f"SELECT * FROM ({FEED}) WHERE FALSE",
    "w06_expire_by_ingest_time": f"""SELECT * FROM (SELECT *, timestamp + ingest_seq % 5 * {DAY} AS ingested_ms FROM ({FEED}))
      WHERE ingested_ms >= {AS_OF - 12 * DAY}""",
    "w01_validate_sizes": LARGE,
    "w07_stream_maintained": f"""SELECT * FROM ({latest(HOURLY, "user_id, timestamp", ALL)})
      WHERE timestamp // {DAY} >= {AS_OF + 15 * DAY - 30 * DAY} // {DAY}""",
    "w06_retain_ttl": f"SELECT * FROM ({FEED}) WHERE timestamp >= {AS_OF - TTL}",
    "w07_retain_chunks": f"""SELECT * FROM ({FEED})
      WHERE (timestamp // {DAY} + 1) * {DAY} > {AS_OF + 5 * DAY + HOUR - 30 * DAY}""",
    "w07_retain_chunks_view": f"""SELECT * FROM ({FEED})
      WHERE (timestamp // {DAY} + 1) * {DAY} > {AS_OF + HOUR - 7 * DAY}""",
    "w08_day_chunks": f"""SELECT strftime(make_timestamp(timestamp // {DAY} * {DAY} * 1000),
      '%Y-%m-%d') AS day, count(*) AS "rows", min(timestamp) AS first_ms,
      max(timestamp) AS last_ms FROM ({FEED}) GROUP BY timestamp // {DAY}""",
    "w09_salted_layout": f"""SELECT {ALL}, CAST(abs(hash % 6) AS INTEGER) AS salt,
      {ROW_KEY} AS row_key_hex FROM ({hashed(FEED)})""",
    "w10_to_points": f"""SELECT 'notifications' AS measurement, user_id, notify_id,
      timestamp AS time, field, value FROM ({TYPED})
      UNPIVOT (value FOR field IN (data, event_type))""",
    "w10_from_points": f"SELECT 'notifications' AS measurement, * FROM ({TYPED})",
    "w10_series_dictionary": SERIES,
    "w10_series_points": f"""SELECT series_id, time, ingest_seq, field, value FROM ({SHARED_POINTS})
      JOIN ({SERIES}) USING (measurement, user_id, notify_id)""",
    "w10_from_series": SHARED_POINTS,
    "w10_series_of_user": f"SELECT * FROM ({SHARED_POINTS}) WHERE user_id = '8'",
    "w11_to_tagged_metric": f"""SELECT 'notifications' AS metric, timestamp, timestamp AS value,
      user_id AS tag_user, notify_id AS tag_notify, 2::BIGINT AS tag_count FROM ({FEED})""",
    "w11_from_tagged_metric": f"""SELECT user_id, notify_id, timestamp,
      CAST(NULL AS VARCHAR) AS data FROM ({FEED})""",
    "w12_encode_record_json": f"""SELECT 'notifications' AS metric, user_id, notify_id, timestamp,
      ingest_seq, CAST(to_json({{'user_id': user_id, 'notify_id': notify_id,
      'timestamp': timestamp, 'data': data, 'ingest_seq': ingest_seq}}) AS VARCHAR) AS value
      FROM ({FEED})""",
    "w12_decode_record_json": FEED,
    "w13_export_report": REPORT,
    "q01_feed_desc_first": user_page(FEED, "desc"),
    "q02_feed_asc_first": user_page(FEED, "asc"),
    "q01_feed_desc_more": user_page(FEED, "desc", f"timestamp < {CURSOR}"),
    "q02_feed_asc_more": user_page(FEED, "asc", f"timestamp > {CURSOR}"),
    "q01_feed_desc_more_all_users": all_pages(FEED, "desc", f"timestamp < {CURSOR}"),
    "q02_feed_asc_more_all_users": all_pages(FEED, "asc", f"timestamp > {CURSOR}"),
    "q05_feed_retention_range_desc_first": user_page(merged(
        SHARED, f"timestamp >= {AS_OF - TTL} AND timestamp < {AS_OF}"), "desc"),
    "q05_feed_retention_range_asc_first": user_page(merged(
        SHARED, f"timestamp >= {AS_OF - TTL} AND timestamp < {AS_OF}"), "asc"),
    "q05_feed_retention_range_desc_more_all_users": all_pages(merged(
        SHARED, f"timestamp >= {AS_OF - LONG_TTL} AND timestamp < {CURSOR}"), "desc"),
    "q05_feed_retention_range_asc_more_all_users": all_pages(merged(
        SHARED, f"timestamp >= {AS_OF - LONG_TTL} AND timestamp < {CURSOR}"), "asc"),
    "q06_counted_points_desc": counted(f"""user_id IN ('3', '8', '12')
      AND timestamp BETWEEN 0 AND {(CURSOR + 123) // 1000 * 1000}"""),
    "q06_counted_points_asc": counted(f"""user_id IN ('3', '8', '12')
      AND timestamp BETWEEN {(CURSOR + 123) // 1000 * 1000} AND {AS_OF}"""),
    "q06_counted_points_desc_all_users": counted(f"timestamp BETWEEN 0 AND {AS_OF}"),
    "q06_counted_points_asc_all_users": counted(f"timestamp BETWEEN 0 AND {AS_OF}"),
    "q07_inclusive_points_desc": f"""SELECT {COLS} FROM ({FEED})
      WHERE user_id = '8' AND timestamp BETWEEN 0 AND {CURSOR}""",
    "q07_inclusive_points_asc": f"""SELECT {COLS} FROM ({FEED})
      WHERE user_id = '8' AND timestamp BETWEEN {CURSOR} AND {AS_OF}""",
    "q07_inclusive_points_desc_all_users": f"""SELECT {COLS} FROM ({FEED})
      WHERE timestamp BETWEEN 0 AND {CURSOR}""",
    "q07_inclusive_points_asc_all_users": f"""SELECT {COLS} FROM ({FEED})
      WHERE timestamp BETWEEN {CURSOR} AND {AS_OF}""",
    "q08_feed_pages_desc": pages("desc"),
    "q08_feed_pages_asc": pages("asc"),
    "q08_page_cursors_desc": page_cursors("desc", "min"),
    "q08_page_cursors_asc": page_cursors("asc", "max"),
    "q08_jump_to_page": f"""SELECT *, 'desc' AS direction FROM ({pages("desc")}) WHERE user_id = '8' AND page = 2
      UNION ALL SELECT *, 'asc' FROM ({pages("asc")}) WHERE user_id = '8' AND page = 2""",
    "q08_jump_to_page_all_users": f"SELECT * FROM ({pages('desc')}) WHERE page = 1",
    "q08_feed_after": user_page(
        HOURLY, "desc", f"(timestamp < {CURSOR} OR (timestamp = {CURSOR} AND notify_id < '5000'))"),
    "q09_feed_all_users_desc": all_pages(FEED, "desc"),
    "q09_feed_all_users_asc": all_pages(FEED, "asc"),
    "q10_gen_requests": f"""SELECT * REPLACE (CAST(from_time AS VARCHAR) AS from_time)
      FROM ({REQUESTS})""",
    "q11_batch_fetch": BATCH,
    "q11_batch_fetch_key_range": BATCH_KEY_RANGE,
    "q11_batch_fetch_retention_range": BATCH_RETENTION,
    "q11_batch_fetch_counted_points": BATCH_COUNTED,
    "q11_batch_fetch_inclusive_points": BATCH_INCLUSIVE,
    "q12_monitor_search": f"""SELECT * FROM ({MONITOR}) WHERE step = 'purchase'
      AND timestamp > {CURSOR - 7 * DAY} AND timestamp < {CURSOR}""",
    "q13_monitor_node_filter": f"""SELECT * FROM ({MONITOR})
      WHERE contains("nodeName", 'node_')""",
    "q14_monitor_report": REPORT,
    "q15_point_filter": f"""SELECT 'notifications' AS measurement, user_id, notify_id,
      timestamp AS time, field, value FROM (SELECT * FROM ({TYPED}) WHERE user_id = '8')
      UNPIVOT (value FOR field IN (data, event_type))""",
    "a01_points_per_timestamp": f"""SELECT user_id, timestamp, count(*) AS n FROM ({HOURLY})
      GROUP BY user_id, timestamp""",
    "a02_latency_summary": f"""SELECT *, CAST(avg_ms // 1000 AS VARCHAR) || '.'
      || lpad(CAST(avg_ms % 1000 AS VARCHAR), 3, '0') AS avg_text FROM (
      SELECT backend, phase, count(*) AS attempts, count(*) FILTER (NOT ok) AS failures,
        CAST(coalesce(sum(latency_ms) FILTER (ok), 0) // count(*) AS BIGINT) AS avg_ms,
        CAST(sum(latency_ms) FILTER (ok) // nullif(count(*) FILTER (ok), 0) AS BIGINT) AS avg_ok_ms,
        CAST(quantile_disc(latency_ms, 0.5) FILTER (ok) AS BIGINT) AS p50_ok_ms,
        CAST(quantile_disc(latency_ms, 0.95) FILTER (ok) AS BIGINT) AS p95_ok_ms
      FROM ({LOG}) GROUP BY backend, phase)""",
    "a03_elapsed_summary": f"""SELECT *, CAST(elapsed_ms // 1000 AS VARCHAR) || '.'
      || lpad(CAST(elapsed_ms % 1000 AS VARCHAR), 3, '0') AS elapsed_text FROM (
      SELECT backend, phase, max(end_ms) - min(start_ms) AS elapsed_ms FROM ({LOG})
      GROUP BY backend, phase)""",
    "a04_phase_has_error": f"""SELECT backend, phase, bool_or(NOT ok) AS has_error FROM ({LOG})
      GROUP BY backend, phase""",
    "a05_trailing_count_sliced": SLICED,
    "a06_trailing_count_any_interval": " UNION ALL ".join(trailing_seconds(ms, True) for ms in (HOUR, 23415000, DAY)),
    "st03_stream_dedup_any_delay": FEED,
    "st04_stream_any_interval": trailing_seconds(23415000),
    "a05_interval_counts": f"""WITH n AS ({FEED}), r AS (SELECT req_id, user_id, from_time AS from_ms,
        from_time + req_id * 7919 % {20 * DAY} - {DAY} AS to_ms FROM ({REQUESTS}) WHERE from_time IS NOT NULL)
      SELECT r.*, count(n.user_id) AS events FROM r LEFT JOIN n ON n.user_id = r.user_id
        AND n.timestamp >= from_ms // 1000 * 1000 AND n.timestamp < to_ms // 1000 * 1000 GROUP BY ALL""",
    "a02_exact_percentiles": f"""WITH l AS (SELECT phase, latency_ms * 1000003 % 9999999967 - start_ms AS v FROM ({LOG}))
      SELECT phase, {PERCENTILES} FROM l GROUP BY phase UNION ALL SELECT 'all', {PERCENTILES} FROM l""",
    "a06_trailing_count_exact": f"""SELECT user_id, timestamp, n, trailing_count FROM (
      SELECT user_id, timestamp, n, CAST(sum(n) OVER (PARTITION BY user_id ORDER BY timestamp
        RANGE BETWEEN {DAY} PRECEDING AND CURRENT ROW) AS BIGINT) AS trailing_count FROM (
        SELECT user_id, timestamp, count(*) AS n FROM ({FEED}) GROUP BY user_id, timestamp))""",
    "a07_first_per_key": merged(SHARED),
    "f01_java_string_hash": f"SELECT doc_id, {java_hash('text')} AS hash FROM documents",
    "f02_f03_salted_key": f"""SELECT notify_id,
      {', '.join(f'abs(hash % {n}) AS salt_{n}' for n in (1, 6, 10, 100))},
      {', '.join(f"lpad(CAST(abs(hash % {n}) AS VARCHAR), {w}, '0') || '-' || user_id AS key_{n}"
                 for n, w in ((1, 1), (6, 1), (10, 1), (100, 2)))}
      FROM ({hashed(FEED)})""",
    "f04_row_key": f"SELECT notify_id, {ROW_KEY} AS row_key_hex FROM ({hashed(FEED)})",
    "f05_records_to_cells": f"""SELECT row_key_hex, unnest(['notify_id', 'user_id', 'timestamp',
        'data']) AS qualifier, unnest([hex(encode(notify_id)), hex(encode(user_id)),
        lpad(hex(timestamp), 16, '0'), hex(encode(data))]) AS value_hex
      FROM (SELECT *, {ROW_KEY} AS row_key_hex FROM ({hashed(FEED)}))""",
    "f05_cells_to_records": f"SELECT {COLS} FROM ({FEED})",
    "f05_typed_bytes": """SELECT event_id, event_id - 5000 AS as_long,
      event_id % 4000000000 AS as_int,
      CASE WHEN event_id % 3 <> 0 AND event_id % 2 = 1 THEN 'true' ELSE 'false' END AS as_bool,
      event_type AS as_string FROM events""",
    "f06_parse_json_lenient": f"""SELECT ingest_seq,
      CASE WHEN {IS_OBJECT} THEN data ELSE '{{}}' END AS data,
      CASE WHEN {IS_OBJECT} THEN data END AS data_or_null FROM ({DIRTY})""",
    "f07_epoch_ms": f"""SELECT notify_id, timestamp, timestamp AS back_ms,
      strftime(make_timestamp(timestamp * 1000), '%Y-%m-%d') AS day FROM ({FEED})""",
    "f08_json_int_default0": f"""SELECT "requestID", {SIZE} AS size, {REQUESTED} AS requested_ms
      FROM ({MONITOR})""",
    "f09_hours_between": f"""SELECT backend, phase, start_ms, latency_ms,
      {hours('latency_ms * 1000')} AS hours FROM ({LOG})""",
    "f10_format_duration": f"""SELECT start_ms, latency_ms, CAST(latency_ms // 1000 AS VARCHAR)
      || '.' || lpad(CAST(latency_ms % 1000 AS VARCHAR), 3, '0') AS text FROM ({LOG})""",
    "f11_truncate_to_second": f"""SELECT notify_id, timestamp // 1000 * 1000 AS second_ms
      FROM ({FEED})""",
    "f12_or_list_match": f"""SELECT notify_id,
      CASE WHEN user_id IN ('3', '8', '12') THEN 'true' ELSE 'false' END AS in_fixed,
      CASE WHEN user_id IN ('3', '8', '12') OR user_id = json_extract_string(data, '$.k')
        THEN 'true' ELSE 'false' END AS in_row FROM ({FEED})""",
    "f13_assign_ulids": f"SELECT {ALL}, {ULID} AS ulid FROM ({with_halves(FEED, ID_SEED)})",
    "f14_assign_monotonic_ulids": f"""SELECT ingest_seq, timestamp, {ULID} AS ulid,
      CASE WHEN NOT overflow THEN {ULID} END AS strict_ulid,
      CAST(overflow AS VARCHAR) AS overflow FROM (
      SELECT ingest_seq, timestamp, carried % {HALF} AS hi40, lo40, carried >= {HALF} AS overflow
      FROM ({MONOTONIC}))""",
    "f15_f16_audit_ulids": f"""SELECT ingest_seq, ulid, problem,
      CASE WHEN problem = '' THEN CAST(timestamp AS VARCHAR) END AS ms,
      CASE WHEN problem = '' THEN CAST(hi40 AS VARCHAR) END AS hi40,
      CASE WHEN problem = '' THEN CAST(lo40 AS VARCHAR) END AS lo40,
      CASE WHEN problem = '' THEN lpad(hex(timestamp), 12, '0') || lpad(hex(hi40), 10, '0')
        || lpad(hex(lo40), 10, '0') END AS bytes_hex
      FROM (SELECT *, CASE ingest_seq % 40 WHEN 0 THEN 'length' WHEN 1 THEN 'character'
        WHEN 2 THEN 'time' ELSE '' END AS problem FROM ({spoiled(FEED)}))""",
    "f15_ulid_order_violations": f"""SELECT user_id, ingest_seq, good AS ulid, previous FROM (
      SELECT *, lag(good) OVER (PARTITION BY user_id ORDER BY ingest_seq) AS previous
      FROM ({spoiled(HOURLY)}) WHERE ingest_seq % 40 > 2) WHERE good <= previous""",
    "f16_ulid_from_bytes": f"""SELECT ingest_seq, good AS ulid FROM ({spoiled(FEED)})
      WHERE ingest_seq % 40 > 2""",
    "f17_normalize_record": DIRTY,
    "st01_stream_ingest": REASONED,
    "st02_stream_upsert": latest(HOURLY, "user_id, timestamp", ALL),
    "st03_stream_dedup": FEED,
    "st04_stream_trailing_count": f"""SELECT user_id, slice_ms - back * {HOUR} AS window_ms,
      CAST(sum(events) AS BIGINT) AS events FROM (
        SELECT user_id, timestamp // {HOUR} * {HOUR} AS slice_ms, count(*) AS events
        FROM ({FEED}) GROUP BY 1, 2), range(16) b(back) GROUP BY 1, 2""",
    "st05_stream_feed_top20": all_pages(FEED, "desc"),
}

for _d, _first, _more in (
    ("desc", f"timestamp BETWEEN 0 AND {AS_OF}",
     f"timestamp >= 0 AND timestamp < {CURSOR}"),
    ("asc", f"timestamp >= {AS_OF - TTL}", f"timestamp > {CURSOR}"),
):
    _upserted = latest(HOURLY, "user_id, timestamp", ALL)
    _long = f"timestamp >= {AS_OF - LONG_TTL}" if _d == "asc" else _first
    _id = f"q03_feed_keyrange_{_d}" if _d == "desc" else f"q04_feed_keyrange_{_d}"
    ORACLE[f"{_id}_first"] = user_page(_upserted, _d, _long)
    ORACLE[f"{_id}_more"] = user_page(_upserted, _d, _more)
    ORACLE[f"{_id}_first_all_users"] = all_pages(_upserted, _d, _first)
    ORACLE[f"{_id}_more_all_users"] = all_pages(_upserted, _d, _more)
    ORACLE[f"q16_rowkey_range_scan_{_d}"] = user_page(_upserted, _d, _more)

_DIRTY_HOURLY = f"""SELECT user_id, notify_id, timestamp // {HOUR} * {HOUR} AS timestamp, data,
  ingest_seq, reject_reason FROM ({REASONED})"""
_VALID = f"SELECT * FROM ({_DIRTY_HOURLY}) WHERE reject_reason = ''"
_POINTS = latest(_DIRTY_HOURLY, "user_id, notify_id, timestamp", ALL)
_LATER = AS_OF + 5 * DAY
_WITHIN_TTL = f"SELECT * FROM ({FEED}) WHERE timestamp >= {AS_OF - TTL}"
ORACLE |= {
    "w02_w03_stored_key_range": latest(_VALID, "user_id, timestamp", ALL),
    "w02_w03_stored_append": f"SELECT {ALL} FROM ({_VALID})",
    "w02_w03_stored_retention_range": _POINTS,
    "w02_w03_stored_counted_points": f"""SELECT user_id, notify_id, timestamp,
      CAST(NULL AS VARCHAR) AS data, ingest_seq FROM ({_POINTS})""",
    "w02_w03_stored_inclusive_points": _POINTS,
    "w06_w07_retained_key_range": _WITHIN_TTL,
    "w06_w07_retained_append": f"""SELECT * FROM ({FEED})
      WHERE (timestamp // {DAY} + 1) * {DAY} > {_LATER - 30 * DAY}""",
    "w06_w07_retained_retention_range": _WITHIN_TTL,
    "w06_w07_retained_counted_points": FEED,
    "w06_w07_retained_inclusive_points": FEED,
}
