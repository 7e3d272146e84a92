"""Every operator as a query over the given tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefeed.functions import scalar as S
from tidefeed.functions import ulid as U
from tidefeed.operators import feed as Q
from tidefeed.operators import dialects, forms, ids, metrics, monitor, percentiles, requests, rollup, series, store
from tidefeed.operators.identity import BY_POINT, BY_TIME, first_per_id, upsert_latest
from tidefeed.operators.validate import validate_split, with_reject_reason
from tidefeed.schema import INGESTED, MS_PER_DAY, MS_PER_HOUR, NOTIFICATIONS, TTL_SECONDS
from tidefeed.session import new_folder, written
from tidefeed.sources import derived
from tidefeed.sources.monitor import load_monitor_log
from tidefeed.sources.notifications import gen_notifications, read_feed
from tidefeed.streaming import ingest, maintain, seen, top_feed, trailing

Query = Callable[[SparkSession, str], DataFrame]

# Parameters shared with the checking SQL.
AS_OF = 1_706_659_200_000        # 2024-01-31T00:00Z
CURSOR = 1_705_320_000_000       # 2024-01-15T12:00Z
USER = "8"
USERS = "3|8|12"
LONG_TTL = 30 * 24 * 60 * 60
INTERVAL = MS_PER_DAY
STREAM_INTERVAL = 16 * MS_PER_HOUR
NODE_MARKER = "node_"
STEP = "purchase"

QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


def each_direction(
    name: str,
    build: Callable[[DataFrame, str], DataFrame],
    table: Callable[[SparkSession, str], DataFrame],
    desc: str = "",
    asc: str = "",
) -> None:
    """Register a query for both directions; ``name`` says where id and direction go."""
    for direction, number in ((Q.DESC, desc), (Q.ASC, asc)):
        QUERIES[name.format(id=number, dir=direction)] = (
            lambda spark, folder, d=direction: build(table(spark, folder), d)
        )


def feed_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.notifications(spark, folder)


def hourly_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.hourly(feed_table(spark, folder))


def shared_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.shared_ids(feed_table(spark, folder))


def dirty_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.dirty(derived.events(spark, folder))


def log_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.operation_log(derived.events(spark, folder))


def monitor_table(spark: SparkSession, folder: str) -> DataFrame:
    return derived.monitor_log(derived.events(spark, folder))


def json_points(spark: SparkSession, folder: str) -> DataFrame:
    return forms.encode_record_json(feed_table(spark, folder))


# ---- sources and writes -----------------------------------------------------------------

@query("s01_load_notifications")
def _(spark, folder):
    return feed_table(spark, folder)


@query("s02_load_monitor_log")
def _(spark, folder):
    path = new_folder(spark, "log")
    day = S.day_of("timestamp").cast("string").alias("day")
    hits = monitor_table(spark, folder).select(day, F.struct("*").alias("_source"))
    hits.hint("rebalance", "day").write.partitionBy("day").json(f"{path}/monitor-log")
    return load_monitor_log(spark, f"{path}/monitor-log", wrapped=True).drop("day")


@query("s03_gen_notifications")
def _(spark, folder):
    source = derived.events(spark, folder)
    return gen_notifications(source, F.col("event_id"), S.epoch_ms(source, "ts"))


@query("w01_validate_split")
def _(spark, folder):
    return with_reject_reason(dirty_table(spark, folder))


@query("w01_validate_sizes")
def _(spark, folder):
    return with_reject_reason(derived.large_payloads(feed_table(spark, folder))).select(
        "notify_id", "reject_reason", F.length("data").alias("n_chars"), S.json_integer("data", "$.k").alias("k"),
        F.length(S.lenient_json_object("data")).alias("n_kept"))


@query("w01_valid_rows")
def _(spark, folder):
    return validate_split(dirty_table(spark, folder))[0]


@query("w02_append")
def _(spark, folder):
    path = new_folder(spark, "feed")
    store.append(feed_table(spark, folder), path)
    return read_feed(spark, path).withColumn("day", F.col("day").cast("string"))


@query("w02_append_validated")
def _(spark, folder):
    path, rejected = new_folder(spark, "feed"), new_folder(spark, "rejected")
    store.append_validated(dirty_table(spark, folder), path, rejected)
    kept = read_feed(spark, path).select(*INGESTED.names, F.lit("").alias("reject_reason"))
    return kept.unionByName(spark.read.parquet(rejected))


def _ages_at(dialect: str) -> int:
    """A time at which some rows of the dialect have aged out and some have not."""
    return AS_OF + (5 * MS_PER_DAY if dialects.RULES[dialect].retention == "chunks" else 0)


for _dialect in dialects.RULES:
    QUERIES[f"w02_w03_stored_{_dialect}"] = lambda spark, folder, d=_dialect: dialects.as_stored(
        derived.hourly(dirty_table(spark, folder)), d
    )
    QUERIES[f"w06_w07_retained_{_dialect}"] = lambda spark, folder, d=_dialect: dialects.retained(
        feed_table(spark, folder), d, _ages_at(d)
    )


@query("w03_upsert_by_time")
def _(spark, folder):
    return upsert_latest(hourly_table(spark, folder), BY_TIME)


@query("w03_upsert_by_point")
def _(spark, folder):
    again = derived.replayed(hourly_table(spark, folder))
    return upsert_latest(again, BY_POINT)


@query("w03_compact_days")
def _(spark, folder):
    path = new_folder(spark, "feed")
    feed = hourly_table(spark, folder)
    store.append(feed, path)
    days = [store.first_kept_day(AS_OF, k) for k in range(0, 10)]
    store.compact_days(spark, path, days)
    return read_feed(spark, path).drop("day")


@query("w04_append_microbatch")
def _(spark, folder):
    path, rejected = _ingested(spark, folder, stream_feed(spark, folder))
    return spark.read.parquet(path).select(*INGESTED.names)


@query("w05_truncate")
def _(spark, folder):
    path = new_folder(spark, "feed")
    feed_table(spark, folder).write.parquet(path)
    store.truncate(spark, path)
    return spark.read.parquet(path)


@query("w06_retain_ttl")
def _(spark, folder):
    return store.retain_ttl(feed_table(spark, folder), AS_OF)


@query("w06_expire_by_ingest_time")
def _(spark, folder):
    """Files in which all, some and no rows have aged."""
    path = new_folder(spark, "feed")
    late = feed_table(spark, folder).withColumn("ingested_ms", F.col("timestamp") + F.col("ingest_seq") % 5 * MS_PER_DAY)
    late.withColumn("day", S.day_of("timestamp")).hint("rebalance", "day").write.partitionBy("day").parquet(path)
    store.expire_rows(spark, path, AS_OF, 12 * 24 * 60 * 60)
    return spark.read.parquet(path).drop("day")


@query("w07_retain_chunks")
def _(spark, folder):
    path = new_folder(spark, "feed")
    store.append(feed_table(spark, folder), path)
    store.drop_chunks(spark, path, AS_OF + 5 * MS_PER_DAY + MS_PER_HOUR)
    return read_feed(spark, path).drop("day")


@query("w07_retain_chunks_view")
def _(spark, folder):
    kept = store.retain_chunks(feed_table(spark, folder), AS_OF + MS_PER_HOUR, 7)
    return kept.drop("day")


@query("w08_day_chunks")
def _(spark, folder):
    return store.day_chunks(feed_table(spark, folder))


@query("w09_salted_layout")
def _(spark, folder):
    path = new_folder(spark, "salted")
    store.write_salted(feed_table(spark, folder), path)
    stored = spark.read.parquet(path)
    return stored.select(*INGESTED.names, "salt", F.hex("row_key").alias("row_key_hex"))


@query("w10_to_points")
def _(spark, folder):
    return forms.to_points(_typed_feed(spark, folder), ("data", "event_type"))


@query("w10_from_points")
def _(spark, folder):
    fields = ("data", "event_type")
    return forms.from_points(forms.to_points(_typed_feed(spark, folder), fields), fields)


def _series_store(spark, folder):
    """Points in two loads; the day of the cut has series in both."""
    path, points = new_folder(spark, "series-store"), forms.to_points(shared_table(spark, folder))
    series.append_points(points.where(F.col("time") < CURSOR), path)
    series.append_points(points.where(F.col("time") >= CURSOR), path)
    return path


@query("w10_series_dictionary")
def _(spark, folder):
    return series.read_series(spark, _series_store(spark, folder))


@query("w10_series_points")
def _(spark, folder):
    return spark.read.parquet(f"{_series_store(spark, folder)}/points")


@query("w10_from_series")
def _(spark, folder):
    return series.points_of(spark, _series_store(spark, folder))


@query("w10_series_of_user")
def _(spark, folder):
    return series.points_of(spark, _series_store(spark, folder), user_id=USER)


@query("w11_to_tagged_metric")
def _(spark, folder):
    points = forms.to_tagged_metric(feed_table(spark, folder))
    tags = F.col("tags")
    return points.select(
        "metric", "timestamp", "value",
        tags["user_id"].alias("tag_user"), tags["notify_id"].alias("tag_notify"),
        F.size(tags).cast("bigint").alias("tag_count"),
    )


@query("w11_from_tagged_metric")
def _(spark, folder):
    return forms.from_tagged_metric(forms.to_tagged_metric(feed_table(spark, folder)))


@query("w12_encode_record_json")
def _(spark, folder):
    return json_points(spark, folder)


@query("w12_decode_record_json")
def _(spark, folder):
    return forms.decode_record_json(json_points(spark, folder))


@query("w13_export_report")
def _(spark, folder):
    path = new_folder(spark, "report")
    monitor.export_report(monitor.monitor_report(monitor_table(spark, folder), NODE_MARKER), path)
    schema = "requestID string, duration bigint, size bigint, distance double, step string"
    return spark.read.schema(schema).option("header", True).csv(path)


def _typed_feed(spark, folder):
    source = derived.events(spark, folder)
    return source.select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_id").cast("string").alias("notify_id"),
        S.epoch_ms(source, "ts").alias("timestamp"),
        F.col("props").alias("data"),
        "event_type",
    )


# ---- feed pages -------------------------------------------------------------------------

FEED_IDS = {"desc": "q01", "asc": "q02"}
KEYRANGE_IDS = {"desc": "q03", "asc": "q04"}

each_direction("{id}_feed_{dir}_first", lambda df, d: Q.feed(df, d, USER), feed_table, **FEED_IDS)
each_direction("{id}_feed_{dir}_more", lambda df, d: Q.feed(df, d, USER, CURSOR), feed_table,
               **FEED_IDS)
each_direction("{id}_feed_{dir}_more_all_users", lambda df, d: Q.feed(df, d, None, CURSOR),
               feed_table, **FEED_IDS)
each_direction("{id}_feed_keyrange_{dir}_first",
               lambda df, d: Q.feed_keyrange(df, d, AS_OF, USER, ttl_seconds=LONG_TTL),
               hourly_table, **KEYRANGE_IDS)
each_direction("{id}_feed_keyrange_{dir}_more",
               lambda df, d: Q.feed_keyrange(df, d, AS_OF, USER, CURSOR), hourly_table,
               **KEYRANGE_IDS)
each_direction("{id}_feed_keyrange_{dir}_first_all_users",
               lambda df, d: Q.feed_keyrange(df, d, AS_OF), hourly_table, **KEYRANGE_IDS)
each_direction("{id}_feed_keyrange_{dir}_more_all_users",
               lambda df, d: Q.feed_keyrange(df, d, AS_OF, None, CURSOR), hourly_table,
               **KEYRANGE_IDS)
each_direction("q05_feed_retention_range_{dir}_first",
               lambda df, d: Q.feed_retention_range(df, d, AS_OF, USER), shared_table)
each_direction("q05_feed_retention_range_{dir}_more_all_users",
               lambda df, d: Q.feed_retention_range(df, d, AS_OF, None, CURSOR, LONG_TTL),
               shared_table)
each_direction("q06_counted_points_{dir}",
               lambda df, d: Q.counted_points(df, d, AS_OF, USERS, CURSOR + 123), hourly_table)
each_direction("q06_counted_points_{dir}_all_users",
               lambda df, d: Q.counted_points(df, d, AS_OF), hourly_table)
each_direction("q07_inclusive_points_{dir}",
               lambda df, d: Q.inclusive_points(df, d, AS_OF, USER, CURSOR), json_points)
each_direction("q07_inclusive_points_{dir}_all_users",
               lambda df, d: Q.inclusive_points(df, d, AS_OF, None, CURSOR), json_points)
each_direction("q08_feed_pages_{dir}", lambda df, d: Q.feed_pages(df, d).drop("ingest_seq"),
               hourly_table)
each_direction("q08_page_cursors_{dir}", lambda df, d: Q.page_cursors(Q.feed_pages(df, d), d),
               hourly_table)
each_direction("q09_feed_all_users_{dir}", lambda df, d: Q.feed(df, d), feed_table)


def _salted(spark, folder):
    path = new_folder(spark, "salted")
    store.write_salted(hourly_table(spark, folder), path)
    return spark.read.parquet(path)


each_direction("q16_rowkey_range_scan_{dir}",
               lambda df, d: Q.rowkey_range_scan(df, USER, d, AS_OF, CURSOR), _salted)


def _stored_with_index(spark, folder):
    """A feed in day chunks, and its page index beside it."""
    path = new_folder(spark, "feed")
    store.append(hourly_table(spark, folder), path)
    return read_feed(spark, path), written(Q.page_index(read_feed(spark, path)), "page-index")


@query("q08_jump_to_page")
def _(spark, folder):
    """The third page of one user, newest first and oldest first."""
    feed, index = _stored_with_index(spark, folder)
    both = [Q.feed_page(feed, index, 2, d, USER).withColumn("direction", F.lit(d)) for d in (Q.DESC, Q.ASC)]
    return both[0].unionByName(both[1]).drop("ingest_seq")


@query("q08_jump_to_page_all_users")
def _(spark, folder):
    feed, index = _stored_with_index(spark, folder)
    return Q.feed_page(feed, index, 1, Q.DESC).drop("ingest_seq")


@query("q08_feed_after")
def _(spark, folder):
    return Q.feed_after(hourly_table(spark, folder), Q.DESC, USER, CURSOR, "5000")


def _requests(spark, folder):
    feed = feed_table(spark, folder)
    return requests.gen_requests(feed, F.col("ingest_seq"), requests.request_span(feed))


def _as_text(df: DataFrame, *names: str) -> DataFrame:
    """Whole numbers that may be null as text, so that every client shows them alike."""
    return df.withColumns({n: F.col(n).cast("string") for n in names})


@query("q10_gen_requests")
def _(spark, folder):
    return _as_text(_requests(spark, folder), "from_time")


@query("q11_batch_fetch")
def _(spark, folder):
    answers = requests.batch_fetch(hourly_table(spark, folder), _asked(spark, folder))
    return _as_text(answers, "from_time", "rank", "timestamp")


def _asked(spark, folder):
    asked = _requests(spark, folder).select("req_id", "user_id", "from_time", "direction")
    return written(asked, "requests")


def _batch(dialect: str):
    def run(spark, folder):
        rows = derived.replayed(shared_table(spark, folder))
        rows = derived.hourly(rows) if dialect == "key_range" else rows
        ttl = TTL_SECONDS * 10 if dialect == "key_range" else TTL_SECONDS * 4
        found = requests.batch_fetch_dialect(
            rows, _asked(spark, folder), dialect, AS_OF - MS_PER_DAY, ttl)
        return _as_text(found, *[c for c in ("from_time", "rank", "timestamp", "n") if c in found.columns])
    return run


for _dialect in ("key_range", "retention_range", "counted_points", "inclusive_points"):
    QUERIES[f"q11_batch_fetch_{_dialect}"] = _batch(_dialect)


@query("q12_monitor_search")
def _(spark, folder):
    log = monitor_table(spark, folder)
    return monitor.monitor_search(log, STEP, CURSOR - 7 * MS_PER_DAY, CURSOR)


@query("q13_monitor_node_filter")
def _(spark, folder):
    return monitor.monitor_node_filter(monitor_table(spark, folder), NODE_MARKER)


@query("q14_monitor_report")
def _(spark, folder):
    return monitor.monitor_report(monitor_table(spark, folder), NODE_MARKER)


@query("q15_point_filter")
def _(spark, folder):
    points = forms.to_points(_typed_feed(spark, folder), ("data", "event_type"))
    return forms.point_filter(points, "notifications", user_id=USER)


# ---- aggregations -----------------------------------------------------------------------

@query("a01_points_per_timestamp")
def _(spark, folder):
    return metrics.points_per_timestamp(hourly_table(spark, folder))


@query("a02_latency_summary")
def _(spark, folder):
    return metrics.latency_summary(log_table(spark, folder), "backend", "phase")


@query("a02_exact_percentiles")
def _(spark, folder):
    """Of one group that holds all rows, and of many."""
    log = log_table(spark, folder).withColumn("spread", F.col("latency_ms") * 1_000_003 % 9_999_999_967 - F.col("start_ms"))
    whole = percentiles.exact_percentiles(log, (), "spread", (0, 1, 50, 95, 100)).select(F.lit("all").alias("phase"), "*")
    each = percentiles.exact_percentiles(log, ("phase",), "spread", (0, 1, 50, 95, 100))
    return whole.unionByName(each)


@query("a03_elapsed_summary")
def _(spark, folder):
    return metrics.elapsed_summary(log_table(spark, folder), "backend", "phase")


@query("a04_phase_has_error")
def _(spark, folder):
    return metrics.phase_has_error(log_table(spark, folder), "backend", "phase")


@query("a05_trailing_count_sliced")
def _(spark, folder):
    return metrics.trailing_count_sliced(feed_table(spark, folder), INTERVAL)


#: An hour, an interval that is no power of two, and a day.
ANY_INTERVALS = (MS_PER_HOUR, 23_415_000, MS_PER_DAY)


@query("a06_trailing_count_any_interval")
def _(spark, folder):
    counts = written(rollup.dyadic_rollup(feed_table(spark, folder)), "rollup")
    every = [rollup.trailing_counts(counts, ms).withColumn("interval_ms", F.lit(ms).cast("bigint")) for ms in ANY_INTERVALS]
    return every[0].unionByName(every[1]).unionByName(every[2])


@query("a05_interval_counts")
def _(spark, folder):
    """The events of each user from each request's time on, for a length drawn from its number."""
    counts = written(rollup.dyadic_rollup(feed_table(spark, folder)), "rollup")
    asked = _requests(spark, folder).select(
        "req_id", "user_id", F.col("from_time").alias("from_ms"),
        (F.col("from_time") + F.col("req_id") * 7919 % (20 * MS_PER_DAY) - MS_PER_DAY).alias("to_ms"))
    return rollup.interval_counts(counts, asked.where("from_ms IS NOT NULL"))


@query("a06_trailing_count_exact")
def _(spark, folder):
    return metrics.trailing_count_exact(feed_table(spark, folder), INTERVAL)


@query("a07_first_per_key")
def _(spark, folder):
    return first_per_id(shared_table(spark, folder))


# ---- scalars ----------------------------------------------------------------------------

@query("f01_java_string_hash")
def _(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    return docs.select("doc_id", S.java_string_hash("text").cast("bigint").alias("hash"))


@query("f02_f03_salted_key")
def _(spark, folder):
    feed = feed_table(spark, folder)
    return feed.select(
        "notify_id",
        *[S.salt_bucket("user_id", n).cast("bigint").alias(f"salt_{n}") for n in (1, 6, 10, 100)],
        *[S.salted_key("user_id", n).alias(f"key_{n}") for n in (1, 6, 10, 100)],
    )


@query("f04_row_key")
def _(spark, folder):
    feed = feed_table(spark, folder)
    return feed.select("notify_id", F.hex(S.row_key("user_id", "timestamp")).alias("row_key_hex"))


@query("f05_records_to_cells")
def _(spark, folder):
    cells = forms.records_to_cells(feed_table(spark, folder))
    return cells.select(
        F.hex("row_key").alias("row_key_hex"), "qualifier", F.hex("value").alias("value_hex")
    )


@query("f05_cells_to_records")
def _(spark, folder):
    return forms.cells_to_records(forms.records_to_cells(feed_table(spark, folder)), strict=True)


@query("f05_typed_bytes")
def _(spark, folder):
    source = derived.events(spark, folder)
    key, half = F.col("event_id") - 5000, F.col("event_id") % 4000000000
    flag = F.when(F.col("event_id") % 3 != 0, F.unhex(F.lpad(
        (F.col("event_id") % 2).cast("string"), 2, "0")))
    return source.select(
        "event_id",
        S.long_of(S.big_endian(key)).alias("as_long"),
        S.int_of(F.unhex(F.lpad(F.hex(half), 8, "0"))).cast("bigint").alias("as_int"),
        S.bool_of(flag).cast("string").alias("as_bool"),
        S.string_of(F.col("event_type").cast("binary")).alias("as_string"),
    )


@query("f06_parse_json_lenient")
def _(spark, folder):
    feed = dirty_table(spark, folder)
    return feed.select(
        "ingest_seq",
        S.lenient_json_object("data").alias("data"),
        S.lenient_json_object("data", None).alias("data_or_null"),
    )


@query("f07_epoch_ms")
def _(spark, folder):
    feed = feed_table(spark, folder)
    back = F.unix_millis(S.event_time("timestamp"))
    return feed.select(
        "notify_id", "timestamp", back.alias("back_ms"),
        S.day_of("timestamp").cast("string").alias("day"),
    )


@query("f08_json_int_default0")
def _(spark, folder):
    return monitor_table(spark, folder).select(
        "requestID",
        S.json_integer("extension", "$.size").alias("size"),
        S.json_integer("extension", "$.requestedTimestamp").alias("requested_ms"),
    )


@query("f09_hours_between")
def _(spark, folder):
    log = log_table(spark, folder)
    return log.select(
        "backend", "phase", "start_ms", "latency_ms",
        S.hours_between(F.col("latency_ms") * 1000, F.lit(0)).alias("hours"),
    )


@query("f10_format_duration")
def _(spark, folder):
    log = log_table(spark, folder)
    return log.select("start_ms", "latency_ms", S.format_duration("latency_ms").alias("text"))


@query("f11_truncate_to_second")
def _(spark, folder):
    feed = feed_table(spark, folder)
    return feed.select("notify_id", S.truncate_to_second("timestamp").alias("second_ms"))


@query("f12_or_list_match")
def _(spark, folder):
    feed = feed_table(spark, folder)
    choices = F.concat_ws("|", F.lit(USERS), F.get_json_object("data", "$.k"))
    return feed.select(
        "notify_id",
        S.or_list_match("user_id", USERS).cast("string").alias("in_fixed"),
        S.or_list_match("user_id", choices).cast("string").alias("in_row"),
    )


@query("f13_assign_ulids")
def _(spark, folder):
    return ids.assign_ulids(feed_table(spark, folder))


@query("f14_assign_monotonic_ulids")
def _(spark, folder):
    # Every tenth hour starts so near the end of the random range that it runs over.
    feed = hourly_table(spark, folder)
    hi, lo = U.random_halves(F.lit("ms"), F.col("timestamp"))
    full = S.slice_number("timestamp", MS_PER_HOUR) % 10 == 0
    start = (
        F.when(full, U.HALF - 1).otherwise(hi),
        F.when(full, U.HALF - 3).otherwise(lo),
    )
    made = ids.assign_monotonic_ulids(feed, start=start)
    return made.select(
        "ingest_seq", "timestamp", "ulid", "strict_ulid",
        F.col("overflow").cast("string").alias("overflow"),
    )


@query("f15_f16_audit_ulids")
def _(spark, folder):
    audited = ids.audit_ulids(derived.ulids(feed_table(spark, folder)))
    parts = [F.col(c).cast("string").alias(c) for c in ("ms", "hi40", "lo40")]
    return audited.select("ingest_seq", "ulid", "problem", *parts, "bytes_hex")


@query("f15_ulid_order_violations")
def _(spark, folder):
    return ids.ulid_order_violations(derived.ulids(hourly_table(spark, folder)))


@query("f16_ulid_from_bytes")
def _(spark, folder):
    audited = ids.audit_ulids(derived.ulids(feed_table(spark, folder)))
    good = audited.where("problem = ''")
    return good.select("ingest_seq", U.from_bytes(F.unhex("bytes_hex")).alias("ulid"))


@query("f17_normalize_record")
def _(spark, folder):
    source = dirty_table(spark, folder).withColumn("unknown", F.lit(1))
    return S.normalize_record(source, NOTIFICATIONS, "ingest_seq")


# ---- streams ----------------------------------------------------------------------------

def stream_events(spark, folder):
    """The events files as a stream; the glob lets it be a file or a folder of files."""
    schema = derived.events(spark, folder).schema
    return ingest.read_files(spark, f"{folder}/events.parquet*", schema)


def stream_feed(spark, folder):
    return derived.to_notifications(stream_events(spark, folder))


def _ingested(spark, folder, stream):
    path, rejected = new_folder(spark, "ingest"), new_folder(spark, "rejected")
    ingest.run_available(
        ingest.stream_ingest(stream, path, rejected, new_folder(spark, "progress"))
    )
    return path, rejected


@query("st01_stream_ingest")
def _(spark, folder):
    path, rejected = _ingested(spark, folder, derived.dirty(stream_events(spark, folder)))
    kept = spark.read.parquet(path).select(*INGESTED.names, F.lit("").alias("reject_reason"))
    aside = spark.read.parquet(rejected).select(*INGESTED.names, "reject_reason")
    return kept.unionByName(aside)


@query("st02_stream_upsert")
def _(spark, folder):
    path, _rejected = _ingested(spark, folder, derived.hourly(stream_feed(spark, folder)))
    return ingest.latest_view(spark, path).select(*INGESTED.names)


@query("w07_stream_maintained")
def _(spark, folder):
    """Four waves of writes, each merged with what is there, half of the days dropped after the third."""
    arriving, path, progress = (new_folder(spark, name) for name in ("arriving", "ingest", "progress"))
    rejected, feed = new_folder(spark, "rejected"), derived.hourly(feed_table(spark, folder))
    quarter = feed.agg(F.max("ingest_seq")).first()[0] // 4 + 1
    aged = AS_OF + 15 * MS_PER_DAY
    for wave in range(4):
        feed.where(S.whole_div("ingest_seq", quarter) == wave).write.mode("append").parquet(arriving)
        stream = ingest.read_files(spark, arriving, INGESTED, 100_000)
        ingest.run_available(ingest.stream_ingest(stream, path, rejected, progress))
        maintain.merge_batches(spark, path, progress, identity=BY_TIME, as_of=aged if wave == 3 else None)
        maintain.drop_merged(spark, path)
        if wave == 2:
            maintain.drop_streamed_chunks(spark, path, progress, aged)
    return ingest.latest_view(spark, path).select(*INGESTED.names)


@query("st03_stream_dedup")
def _(spark, folder):
    path = new_folder(spark, "dedup")
    once = ingest.stream_dedup(derived.replayed(stream_feed(spark, folder)))
    ingest.run_available(ingest.append_stream(once, path, new_folder(spark, "progress")))
    return spark.read.parquet(path)


@query("st03_stream_dedup_any_delay")
def _(spark, folder):
    """Waves in no order of time, with replays in the same wave and in later ones."""
    arriving, path, keys, progress = (new_folder(spark, name) for name in ("arriving", "dedup", "seen", "progress"))
    feed = feed_table(spark, folder)
    for wave in range(3):
        new = feed.where(F.col("ingest_seq") * 7919 % 3 == wave)
        again = feed.where(F.col("ingest_seq") * 7919 % 3 < wave).where("ingest_seq % 5 = 0")
        new.unionByName(derived.replayed(again)).write.mode("append").parquet(arriving)
        stream = ingest.read_files(spark, arriving, INGESTED, 100_000)
        ingest.run_available(seen.stream_dedup_seen(stream, path, keys, progress, buckets=16))
        seen.merge_seen(spark, keys, progress)
    return maintain.read_streamed(spark, path).select(*INGESTED.names)


@query("st04_stream_trailing_count")
def _(spark, folder):
    path = new_folder(spark, "slices")
    counts = trailing.slice_counts(stream_feed(spark, folder), STREAM_INTERVAL, delay_seconds=None)
    ingest.run_available(
        trailing.stream_trailing_count(counts, path, new_folder(spark, "progress"))
    )
    return trailing.trailing_windows(spark, path, STREAM_INTERVAL)


@query("st04_stream_any_interval")
def _(spark, folder):
    path = new_folder(spark, "rollup")
    ingest.run_available(trailing.stream_rollup(stream_feed(spark, folder), path, new_folder(spark, "progress")))
    return rollup.trailing_counts(trailing.read_rollup(spark, path), 23_415_000)


@query("st05_stream_feed_top20")
def _(spark, folder):
    path = new_folder(spark, "top")
    ingest.run_available(
        top_feed.stream_top_feed(stream_feed(spark, folder), path, new_folder(spark, "progress"))
    )
    return top_feed.read_top_feed(spark, path)
