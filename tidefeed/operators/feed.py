"""Feed pages in five dialects.

A dialect says which rows count as one, which times a cursor admits, and whether the answer is
one page or all of it. Newest first means (time, id) descending and oldest first ascending, so
each order is exactly the other one reversed. ``as_of`` stands for the clock.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions.scalar import day_of, or_list_match, whole_div
from tidefeed.operators.forms import decode_record_json
from tidefeed.operators.identity import BY_POINT, BY_TIME, first_per_id, upsert_latest
from tidefeed.plans.ordered import positions
from tidefeed.plans.pruning import broadcast_if_few, time_range
from tidefeed.schema import MS_PER_SECOND, PAGE_SIZE, TTL_SECONDS
from tidefeed.session import written

DESC, ASC = "desc", "asc"
COLUMNS = ("user_id", "notify_id", "timestamp", "data")


@dataclass(frozen=True)
class TimeRange:
    """Bounds of one fetch; None leaves a side open."""

    lower: int | None = None
    lower_inclusive: bool = True
    upper: int | None = None
    upper_inclusive: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        return time_range(
            df, self.lower, self.upper, self.lower_inclusive, self.upper_inclusive
        )


def _second(ms: int) -> int:
    return ms // MS_PER_SECOND * MS_PER_SECOND


def admitted(
    dialect: str,
    direction: str,
    from_time: int | None,
    as_of: int,
    ttl_seconds: int = TTL_SECONDS,
) -> TimeRange:
    """The times that a fetch in this dialect and direction may return."""
    first = from_time is None
    oldest = as_of - ttl_seconds * MS_PER_SECOND
    if dialect == "append":
        if first:
            return TimeRange()
        if direction == DESC:
            return TimeRange(upper=from_time, upper_inclusive=False)
        return TimeRange(lower=from_time, lower_inclusive=False)
    if dialect == "key_range":
        if direction == DESC:
            return TimeRange(
                lower=0, upper=as_of if first else from_time, upper_inclusive=first
            )
        return TimeRange(lower=oldest if first else from_time, lower_inclusive=first)
    if dialect == "retention_range":
        # The cursor is the upper end in both directions.
        return TimeRange(
            lower=oldest, upper=as_of if first else from_time, upper_inclusive=False
        )
    if dialect == "counted_points":
        if direction == DESC:
            return TimeRange(lower=0, upper=_second(as_of if first else from_time))
        return TimeRange(lower=_second(0 if first else from_time), upper=_second(as_of))
    if dialect == "inclusive_points":
        if direction == DESC:
            return TimeRange(lower=0, upper=as_of if first else from_time)
        return TimeRange(lower=0 if first else from_time, upper=as_of)
    raise ValueError(f"unknown dialect: {dialect}")


def _order(direction: str, *ties: str) -> list:
    names = ("timestamp", *ties)
    return [F.desc(c) if direction == DESC else F.asc(c) for c in names]


def page(
    df: DataFrame,
    direction: str,
    user_id: str | None,
    limit: int = PAGE_SIZE,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """The first ``limit`` rows in feed order: of one user, or of every user.

    One user's page is a top-k, kept as k rows per task. For every user the limit is pushed
    below the shuffle, so a task sends at most k rows of a user, however many it read.
    """
    ties = ("notify_id", "ingest_seq") if "ingest_seq" in df.columns else ("notify_id",)
    order = _order(direction, *ties)
    if user_id is not None:
        return df.where(F.col("user_id") == user_id).orderBy(*order).limit(limit).select(
            *COLUMNS, *keep
        )
    ranked = df.withColumn(
        "rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order))
    )
    return ranked.where(F.col("rank") <= limit).select(*COLUMNS, *keep, "rank")


def _of_user(df: DataFrame, user_id: str | None) -> DataFrame:
    return df if user_id is None else df.where(F.col("user_id") == user_id)


def feed(
    df: DataFrame,
    direction: str,
    user_id: str | None = None,
    from_time: int | None = None,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """A page of an append-only table; a cursor is strict."""
    kept = admitted("append", direction, from_time, as_of=0).apply(df)
    return page(kept, direction, user_id, limit)


def feed_keyrange(
    df: DataFrame,
    direction: str,
    as_of: int,
    user_id: str | None = None,
    from_time: int | None = None,
    ttl_seconds: int = TTL_SECONDS,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """A page where a later write at the same user and time replaces the earlier one.

    For every user, the rows of all pages are chosen by user, time and sequence alone; only they fetch
    their id and payload.
    """
    kept = admitted("key_range", direction, from_time, as_of, ttl_seconds).apply(df)
    if user_id is not None:
        return page(upsert_latest(_of_user(kept, user_id), BY_TIME), direction, user_id, limit)
    last = kept.groupBy(*BY_TIME).agg(F.max("ingest_seq").alias("ingest_seq"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(*_order(direction)))
    chosen = last.withColumn("rank", place).where(F.col("rank") <= limit)
    same = [F.col(f"c.{c}").eqNullSafe(F.col(f"r.{c}")) for c in (*BY_TIME, "ingest_seq")]
    found = chosen.alias("c").join(kept.alias("r"), same)
    # A write that is stored twice is there once.
    return found.groupBy("c.user_id", "rank").agg(
        F.max(F.struct("r.timestamp", "r.notify_id", "r.data")).alias("_row")
    ).select("user_id", "_row.notify_id", "_row.timestamp", "_row.data", "rank").select(*COLUMNS, "rank")


def feed_retention_range(
    df: DataFrame,
    direction: str,
    as_of: int,
    user_id: str | None = None,
    from_time: int | None = None,
    ttl_seconds: int = TTL_SECONDS,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """A page within the retention, one row per id: first time, last payload."""
    kept = admitted("retention_range", direction, from_time, as_of, ttl_seconds).apply(df)
    return page(first_per_id(_of_user(kept, user_id)), direction, user_id, limit)


def counted_points(
    df: DataFrame,
    direction: str,
    as_of: int,
    users: str | None = None,
    from_time: int | None = None,
) -> DataFrame:
    """Points per user and time, for the ``a|b|c`` users or all of them; no page limit.

    Range ends are cut to the second. An id is reported where the instant has only one.
    """
    kept = admitted("counted_points", direction, from_time, as_of).apply(df)
    if users is not None:
        kept = kept.where(or_list_match("user_id", users))
    once = kept.groupBy(*BY_POINT).agg(F.count("*").alias("writes"))
    return once.groupBy("user_id", "timestamp").agg(
        F.count("*").alias("n"),
        F.when(F.count("*") == 1, F.min("notify_id")).alias("notify_id"),
    )


def inclusive_points(
    points: DataFrame,
    direction: str,
    as_of: int,
    user_id: str | None = None,
    from_time: int | None = None,
) -> DataFrame:
    """All records in an inclusive range, decoded from tagged JSON points; no page limit.

    User and time are columns of the point, so only the points that stay are decoded.
    """
    kept = admitted("inclusive_points", direction, from_time, as_of).apply(points)
    latest = upsert_latest(_of_user(kept, user_id), ("metric", *BY_POINT))
    records = decode_record_json(latest).select(*COLUMNS)
    if user_id is None:
        return records
    return records.orderBy(*_order(direction, "notify_id"))


def feed_pages(
    df: DataFrame, direction: str = DESC, limit: int = PAGE_SIZE
) -> DataFrame:
    """Every row with its rank in the user's feed and the page it falls on, from 0.

    This is the whole "fetch more" walk of every user at once, numbered over slices of the
    sorted table.
    """
    order = ["timestamp", "notify_id", "ingest_seq"]
    numbered = positions(df, "user_id", order, "rank", descending=direction == DESC)
    page_number = whole_div(F.col("rank") - 1, limit)
    return numbered.select(*COLUMNS, "ingest_seq", "rank", page_number.alias("page"))


def page_index(df: DataFrame) -> DataFrame:
    """(user_id, day, rows, before): how many rows a user has on a day, and before that day.

    It is as large as users times days, and is stored beside the feed, so that any page is found
    without its predecessors. A later write changes only its own day's count and what follows it.
    """
    day = F.col("day") if "day" in df.columns else day_of("timestamp")
    counts = df.groupBy("user_id", day.alias("day")).agg(F.count("*").alias("rows"))
    before = Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0).cast("bigint")))


def _days_of_page(index: DataFrame, page_number: int, direction: str, limit: int) -> DataFrame:
    """(user_id, day, _skipped) of the days that hold rows of a page; _skipped rows come before the first of them."""
    whole = F.sum("rows").over(Window.partitionBy("user_id"))
    ahead = whole - F.col("before") - F.col("rows") if direction == DESC else F.col("before")
    first, last = page_number * limit, (page_number + 1) * limit
    touched = index.withColumn("_ahead", ahead).where((F.col("_ahead") < last) & (F.col("_ahead") + F.col("rows") > first))
    return touched.select("user_id", "day", F.min("_ahead").over(Window.partitionBy("user_id")).alias("_skipped"))


def feed_page(df: DataFrame, index: DataFrame, page_number: int, direction: str = DESC, user_id: str | None = None,
              limit: int = PAGE_SIZE) -> DataFrame:
    """Page ``page_number``, from 0, of one user's feed or of every user's, as in ``feed_pages``.

    The index tells the days that hold it, and only their rows are read: of a table in day chunks, one
    or two directories for a user with enough rows. ``index`` must be that of the rows of ``df``.
    """
    if page_number < 0:
        raise ValueError("pages are numbered from 0")
    order = ["timestamp", "notify_id", "ingest_seq"]
    chunked = df if "day" in df.columns else df.withColumn("day", day_of("timestamp"))
    first, last = page_number * limit, (page_number + 1) * limit
    columns = (*COLUMNS, "ingest_seq", "rank", "page")
    if user_id is not None:
        days = _days_of_page(index.where(F.col("user_id") == user_id), page_number, direction, limit).collect()
        skipped = days[0]["_skipped"] if days else 0
        kept = chunked.where((F.col("user_id") == user_id) & F.col("day").isin([row.day for row in days]))
        place = F.row_number().over(Window.partitionBy("user_id").orderBy(*_order(direction, *order[1:])))
        # A page's end is a constant here, so tasks keep no more rows than come before it in its days.
        numbered = kept.withColumn("_place", place).where(F.col("_place") <= last - skipped)
        ranked = numbered.withColumn("rank", F.col("_place").cast("bigint") + skipped)
    else:
        days = written(_days_of_page(index, page_number, direction, limit), "page-days")
        same = F.col("d.user_id").eqNullSafe(F.col("r.user_id")) & F.col("d.day").eqNullSafe(F.col("r.day"))
        kept = chunked.alias("r").join(broadcast_if_few(days, days.count()).alias("d"), same).select("r.*", "d._skipped")
        numbered = positions(kept, "user_id", order, "_place", descending=direction == DESC)
        ranked = numbered.withColumn("rank", F.col("_place") + F.col("_skipped"))
    return ranked.where((F.col("rank") > first) & (F.col("rank") <= last)).withColumn(
        "page", F.lit(page_number).cast("bigint")).select(*columns)


def page_cursors(pages: DataFrame, direction: str = DESC) -> DataFrame:
    """Per user and page, the cursor that continues after it."""
    pick = F.min if direction == DESC else F.max
    last = pick(F.struct("timestamp", "notify_id", "ingest_seq")).alias("last")
    return pages.groupBy("user_id", "page").agg(F.count("*").alias("rows"), last).select(
        "user_id",
        "page",
        "rows",
        F.col("last.timestamp").alias("cursor_ms"),
        F.col("last.notify_id").alias("cursor_id"),
        F.col("last.ingest_seq").alias("cursor_seq"),
    )


def feed_after(
    df: DataFrame,
    direction: str,
    user_id: str,
    cursor_ms: int,
    cursor_id: str,
    limit: int = PAGE_SIZE,
    cursor_seq: int | None = None,
) -> DataFrame:
    """The page after a (time, id, sequence) cursor; rows tied with the cursor are not lost.

    Without a sequence the page begins after all rows of the cursor's time and id.
    """
    time, ident, written_as = F.col("timestamp"), F.col("notify_id"), F.col("ingest_seq")
    if direction == DESC:
        kept = time_range(df, upper=cursor_ms)
        beyond = (time < cursor_ms) | (ident < cursor_id)
        later = written_as < cursor_seq if cursor_seq is not None else F.lit(False)
    else:
        kept = time_range(df, lower=cursor_ms)
        beyond = (time > cursor_ms) | (ident > cursor_id)
        later = written_as > cursor_seq if cursor_seq is not None else F.lit(False)
    beyond = beyond | ((ident == cursor_id) & later)
    return page(kept.where(beyond), direction, user_id, limit)


def user_key_prefix(user_id: str, buckets: int) -> bytes:
    """The row-key bytes before the time, of one user given as a literal."""
    hashed = 0
    units = user_id.encode("utf-16-be")
    for i in range(0, len(units), 2):
        hashed = (hashed * 31 + int.from_bytes(units[i:i + 2], "big")) & 0xFFFFFFFF
    signed = hashed - (1 << 32) if hashed >= 1 << 31 else hashed
    salt = abs(signed) % buckets
    width = len(str(max(buckets - 1, 0)))
    return f"{salt:0{width}d}-{user_id}:".encode()


def rowkey_range_scan(
    df: DataFrame,
    user_id: str,
    direction: str,
    as_of: int,
    from_time: int | None = None,
    ttl_seconds: int = TTL_SECONDS,
    buckets: int = 6,
    limit: int = PAGE_SIZE,
) -> DataFrame:
    """A key-range page by comparing binary row keys between start and stop.

    The bounds are literals, so on a stored ``row_key`` column they reach the Parquet scan.
    Keys have a fixed length after the prefix, which keeps out users whose own id continues it.
    """
    prefix = user_key_prefix(user_id, buckets)
    key = F.col("row_key")

    def at(ms: int) -> bytes:
        return prefix + (ms & 0xFFFFFFFFFFFFFFFF).to_bytes(8, "big")

    first = from_time is None
    if direction == DESC:
        end = F.lit(at(as_of if first else from_time))
        bounds = (key > F.lit(prefix + bytes(4))) & (key <= end if first else key < end)
    else:
        start = as_of - ttl_seconds * MS_PER_SECOND if first else from_time
        stop = F.lit(prefix + b"\xff" * 8)
        bounds = (key >= F.lit(at(start)) if first else key > F.lit(at(start))) & (key <= stop)
    whole = F.octet_length(key) == len(prefix) + 8
    if "salt" in df.columns:
        # On a stored salted layout only the user's directory is read.
        df = df.where(F.col("salt") == int(prefix.split(b"-")[0]))
    kept = upsert_latest(df.where(bounds & whole), ("row_key",))
    order = F.desc("row_key") if direction == DESC else F.asc("row_key")
    return kept.orderBy(order).limit(limit).select(*COLUMNS)
