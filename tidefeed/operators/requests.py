"""A table of fetch requests, and the answers to all of them in one job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.functions.scalar import floor_to, slice_number, whole_div
from tidefeed.functions.ulid import random_halves
from tidefeed.operators.feed import ASC, DESC
from tidefeed.operators.identity import BY_POINT, BY_TIME, upsert_latest
from tidefeed.plans.ordered import range_slices, running_total
from tidefeed.plans.pruning import BROADCAST_ROWS, broadcast_if_few, time_range
from tidefeed.schema import MS_PER_DAY, MS_PER_SECOND, PAGE_SIZE, TTL_SECONDS
from tidefeed.session import written

# Open cursors stand outside all times, and far enough inside bigint for arithmetic.
BEFORE_ALL, AFTER_ALL = -(1 << 62), 1 << 62

# Rows of one user that a request for a range meets at once.
ROWS_TOGETHER = 256

# Pages' worth of rows that lie together in one block, where pages are cut out.
BLOCK_PAGES = 4


def gen_requests(numbers: DataFrame, number: Column, span: DataFrame) -> DataFrame:
    """Fetch requests, one per row of ``numbers``, drawn from digests of the row's number.

    ``span`` is one row of ``users, min_ms, max_ms``. User, direction, phase and cursor are
    independent of each other and uniform: a first page has no cursor, a further one has one
    in ``[min_ms, max_ms)``.
    """
    def checked(good: Column, value: Column, problem: str) -> Column:
        return F.when(good, value).otherwise(F.raise_error(F.lit(problem)).cast("bigint"))

    def drawn(name: str) -> Column:
        return random_halves(F.lit(name), F.col("req_id"))[0]

    base = numbers.select(
        number.cast("bigint").alias("req_id"),
        span.select(F.struct("users", "min_ms", "max_ms")).scalar().alias("_span"),
    )
    low, high = F.col("_span.min_ms"), F.col("_span.max_ms")
    base = base.withColumn("_width", checked(high > low, high - low, "min_ms must be below max_ms"))
    more = drawn("request phase") % 2 == 1
    return base.select(
        "req_id",
        (drawn("request user") % F.col("_span.users")).cast("string").alias("user_id"),
        F.when(more, low + drawn("request time") % F.col("_width")).alias("from_time"),
        F.when(drawn("request direction") % 2 == 0, DESC).otherwise(ASC).alias("direction"),
        F.when(more, "more").otherwise("first").alias("phase"),
    )


def request_span(df: DataFrame) -> DataFrame:
    """The one row of totals that ``gen_requests`` needs, from a feed with users 0..n-1."""
    return df.agg(
        (F.max(F.col("user_id").cast("bigint")) + 1).alias("users"),
        F.min("timestamp").alias("min_ms"),
        F.max("timestamp").alias("max_ms"),
    )


def _needed_slices(
    df: DataFrame, cursors: DataFrame, slice_ms: int, limit: int
) -> DataFrame:
    """(user, slice) pairs of the time line that can hold a row of some page.

    Going back from a cursor, a slice is needed while the whole slices between it and the
    cursor's own have fewer than ``limit`` rows; the nearest cursor decides. Both directions
    come from one window over a user's slices, of which there is one per slice of the time
    span, however many rows or cursors the user has.
    """
    wanted = broadcast_if_few(cursors.select("user_id").distinct(), cursors.count())
    zero = F.lit(0).cast("bigint")
    held = (
        df.join(wanted, "user_id", "left_semi")
        .groupBy("user_id", slice_number("timestamp", slice_ms).alias("_part"))
        .agg(F.count("*").alias("_rows"))
        .select("*", F.lit(False).alias("_back"), F.lit(False).alias("_forth"))
    )
    asked = cursors.groupBy("user_id", slice_number("_at", slice_ms).alias("_part")).agg(
        zero.alias("_rows"),
        F.bool_or(F.col("direction") == DESC).alias("_back"),
        F.bool_or(F.col("direction") != DESC).alias("_forth"),
    )
    parts = held.unionByName(asked).groupBy("user_id", "_part").agg(
        F.sum("_rows").alias("_rows"),
        F.bool_or("_back").alias("_back"),
        F.bool_or("_forth").alias("_forth"),
    )
    order = Window.partitionBy("user_id").orderBy("_part")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    counted = parts.withColumn("_through", F.sum("_rows").over(so_far))
    before = F.col("_through") - F.col("_rows")
    between_back = F.min(F.when(F.col("_back"), before)).over(ahead) - F.col("_through")
    between_forth = before - F.max(F.when(F.col("_forth"), F.col("_through"))).over(so_far)
    return (
        counted.withColumns({"_to_next": between_back, "_from_last": between_forth})
        .where((F.col("_rows") > 0) & ((F.col("_to_next") < limit) | (F.col("_from_last") < limit)))
        .select("user_id", "_part")
    )


KEY = ("user_id", "timestamp", "notify_id", "ingest_seq")
ANSWER = ("req_id", "user_id", "direction", "from_time", "rank", "notify_id", "timestamp")


def _checked(requests: DataFrame) -> DataFrame:
    """The requests; a direction that is neither null nor known fails the query."""
    direction = F.col("direction")
    problem = F.raise_error(F.concat(F.lit("unknown direction: "), direction)).cast("boolean")
    known = direction.isNull() | direction.isin(DESC, ASC)
    return requests.where(F.when(known, F.lit(True)).otherwise(problem))


def _pages(
    df: DataFrame, asked: DataFrame, limit: int, slice_ms: int, source: DataFrame | None = None, stored: DataFrame | None = None
) -> DataFrame:
    """``asked`` with the rank, id, time and sequence of every row of its page; with ``source``, its payload.

    ``asked`` has ``user_id``, ``direction`` and the strict cursor ``_at``; ``df`` has the
    columns of ``KEY``, and no more rows than ``stored``, by default ``df`` itself, which is
    counted. A request without rows stays, with a null rank.

    Joining requests to rows on the user would pair every request of a busy user with every
    row of that user. Instead the slices of time that any page can touch are found from row
    counts, and their rows are sorted together with the distinct cursors. A running count then
    gives each row its place in the user's feed, and each cursor the number of rows before it.
    A page is up to ``limit`` known places side by side. Rows lie in blocks of a few pages, each
    with the rows after it that a page beginning in it may reach: a request meets the one block
    of its user in which its page begins, and cuts the page out. Each row on any page fetches its
    payload once, before blocks are made.
    """
    newest_first = F.col("direction") == DESC
    cursors = written(asked.select("user_id", "direction", "_at").dropna().distinct(), "cursors")

    # So many cursors that their pages have room for all rows leave hardly a slice out.
    if cursors.count() * limit < (df if stored is None else stored).count():
        df = _near_cursors(df, cursors, slice_ms, limit)
    sequence = df.schema["ingest_seq"].dataType
    known = df.where(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
    rows = known.select(
        "user_id",
        F.col("timestamp").alias("_at"),
        F.lit(1).alias("_side"),
        "notify_id",
        "ingest_seq",
        F.lit(None).cast("string").alias("direction"),
    )
    # A strict cursor stands before the rows of its own instant when going back in time and
    # after them when going forward.
    marks = cursors.select(
        "user_id",
        "_at",
        F.when(newest_first, 0).otherwise(2).alias("_side"),
        F.lit("").alias("notify_id"),
        F.lit(None).cast(sequence).alias("ingest_seq"),
        "direction",
    )
    order = ["_at", "_side", "notify_id", "ingest_seq"]
    sliced = range_slices(rows.unionByName(marks), "user_id", order)
    is_row = F.when(F.col("_side") == 1, 1).otherwise(0).cast("bigint")
    placed = written(running_total(sliced, "user_id", order, is_row, "_place"), "placed")

    spot = F.col("_place")
    marked = placed.where(F.col("_side") != 1).select(
        "user_id", "direction", "_at", spot.alias("_spot"),
        F.when(newest_first, F.greatest(spot - (limit - 1), F.lit(1))).otherwise(spot + 1).alias("_first"),
        F.when(newest_first, spot).otherwise(spot + limit).alias("_last"),
    ).where("_first <= _last")

    wide = BLOCK_PAGES * limit
    first_block, last_block = whole_div(F.col("_first") - 1, wide), whole_div(F.col("_last") - 1, wide)
    # A page reaches into one more block at most. What pages cover of a block is taken as one
    # range, so all rows from the first to the last place of each page are there, side by side.
    touched = marked.select("user_id", "_first", "_last", F.explode(F.sequence(first_block, last_block)).alias("_block"))
    covered = touched.groupBy("user_id", "_block").agg(F.min("_first").alias("_from"), F.max("_last").alias("_to"))
    found = placed.where(F.col("_side") == 1).select(
        "user_id", "_place", "notify_id", F.col("_at").alias("timestamp"), "ingest_seq",
        whole_div(spot - 1, wide).alias("_block"),
    ).join(covered, ["user_id", "_block"]).where(spot.between(F.col("_from"), F.col("_to"))).drop("_from", "_to")
    entry = ["_place", "notify_id", "timestamp", "ingest_seq"]
    if source is not None:
        found = _with_payload(found, source)
        entry.append("data")
    begins_before = (F.col("_block") > 0) & ((spot - 1) % wide < limit - 1)
    in_blocks = F.when(begins_before, F.array(F.col("_block") - 1, F.col("_block"))).otherwise(F.array("_block"))
    blocks = (
        found.select("user_id", F.explode(in_blocks).alias("_block"), F.struct(*entry).alias("_row"))
        .groupBy("user_id", "_block").agg(F.sort_array(F.collect_list("_row")).alias("_rows"))
    )
    met = (
        asked.join(marked, ["user_id", "direction", "_at"], "left").withColumn("_block", first_block)
        .join(blocks, ["user_id", "_block"], "left")
    )
    begin = (F.col("_first") - F.element_at("_rows", 1)["_place"] + 1).cast("int")
    page = F.slice("_rows", begin, (F.col("_last") - F.col("_first") + 1).cast("int"))
    place = F.col("_row._place")
    rank = F.when(newest_first, F.col("_spot") - place + 1).otherwise(place - F.col("_spot")).cast("int")
    return met.select(*asked.columns, "_spot", F.explode_outer(page).alias("_row")).select(
        *asked.columns, rank.alias("rank"), *[F.col(f"_row.{c}") for c in entry[1:]])


def _near_cursors(df: DataFrame, cursors: DataFrame, slice_ms: int, limit: int) -> DataFrame:
    """The rows in slices of time that a page can touch.

    Between two cursors rows may be missing then, but never one that a page needs: the rows
    from a cursor to the end of its page are all there, side by side.
    """
    needed = written(_needed_slices(df, cursors, slice_ms, limit), "needed")
    first, last = needed.agg(F.min("_part"), F.max("_part")).first()
    if first is not None:
        # Keeps the scan to the days between, and to the row groups that reach into them.
        df = time_range(df, first * slice_ms, (last + 1) * slice_ms, upper_inclusive=False)
    few = broadcast_if_few(needed, needed.count())
    return df.withColumn("_part", slice_number("timestamp", slice_ms)).join(few, ["user_id", "_part"], "left_semi")


def _with_payload(rows: DataFrame, source: DataFrame) -> DataFrame:
    """Adds ``data`` to rows that have a user and a time, by all their key columns."""
    keys = written(rows, "keys")
    first, last, count = keys.agg(F.min("timestamp"), F.max("timestamp"), F.count("*")).first()
    inside = source if first is None else time_range(source, first, last)
    # Structs compare nulls as equal, so an id or a sequence may be missing.
    name = F.struct("notify_id", "ingest_seq").alias("_name")
    same = ["user_id", "timestamp", "_name"]
    named = inside.select("user_id", "timestamp", name, "data")
    if count <= BROADCAST_ROWS:
        named = named.join(F.broadcast(keys.select("user_id", "timestamp", name)), same, "left_semi")
    # A row that was written twice is there once.
    payloads = named.groupBy(*same).agg(F.max("data").alias("data"))
    return keys.withColumn("_name", name).join(payloads, same).select(*keys.columns, "data")


def batch_fetch(
    df: DataFrame, requests: DataFrame, limit: int = PAGE_SIZE, slice_ms: int = MS_PER_DAY
) -> DataFrame:
    """The page of every request by strict cursors; a request without rows has a null rank.

    A request without a user or a direction has no rows. An unknown direction fails the query.
    """
    at = F.coalesce(
        F.col("from_time"),
        F.when(F.col("direction") == DESC, F.lit(AFTER_ALL)).otherwise(F.lit(BEFORE_ALL)),
    )
    asked = _checked(requests).select("req_id", "user_id", "direction", "from_time", at.alias("_at"))
    narrow = df.select(*KEY, *[c for c in df.columns if c == "day"])
    return _pages(narrow, asked, limit, slice_ms, df).select(*ANSWER, "data")


def batch_fetch_dialect(
    df: DataFrame,
    requests: DataFrame,
    dialect: str,
    as_of: int,
    ttl_seconds: int = TTL_SECONDS,
    limit: int = PAGE_SIZE,
    slice_ms: int = MS_PER_DAY,
) -> DataFrame:
    """The answers to all requests by a dialect's read rules, from all rows ever written.

    Three dialects answer with a page. ``counted_points`` and ``inclusive_points`` answer with
    every row of a range and have no rank; the first has ``n`` in place of ``data``.
    """
    going_back, first = F.col("direction") == DESC, F.col("from_time").isNull()
    cursor, oldest = F.col("from_time"), as_of - ttl_seconds * MS_PER_SECOND
    asked = _checked(requests).select("req_id", "user_id", "direction", "from_time")
    day = [c for c in df.columns if c == "day"]
    if dialect == "append":
        return batch_fetch(df, requests, limit, slice_ms)
    if dialect == "key_range":
        # As strict cursors: up to as_of, or from the oldest instant that is kept.
        at = F.when(going_back, F.when(first, as_of + 1).otherwise(cursor)).otherwise(
            F.when(first, oldest - 1).otherwise(cursor))
        latest = upsert_latest(df.select(*KEY, *day), [*BY_TIME, *day])
        pages = _pages(latest, asked.withColumn("_at", at), limit, slice_ms, df, df)
        out = going_back & (F.col("timestamp") < 0)
        return _blanked(pages, out).select(*ANSWER, "data")
    if dialect == "retention_range":
        # An id stands at its first time within the retention, whatever the cursor, and shows
        # the last payload before the cursor: its newest one, unless its rows reach the cursor.
        # Only for those ids on a page is the row before the cursor looked up.
        end = F.coalesce(cursor, F.lit(as_of))
        kept = time_range(df, lower=oldest)
        times = written(kept.groupBy("user_id", "notify_id").agg(
            F.min("timestamp").alias("timestamp"), F.max(F.struct("timestamp", "ingest_seq", "data")).alias("data"),
        ).withColumn("ingest_seq", F.lit(0).cast("bigint")), "times")
        at = F.when(going_back, end).otherwise(F.lit(BEFORE_ALL))
        pages = _pages(times.select(*KEY), asked.withColumns({"_at": at, "_end": end}), limit, slice_ms, times)
        pages = written(_blanked(pages, F.col("timestamp") >= F.col("_end")), "pages")
        reaching = F.coalesce(F.col("data.timestamp") >= F.col("_end"), F.lit(False))
        settled = pages.where(~reaching).select(*ANSWER, "data.data")
        name = F.to_json(F.struct("user_id", "notify_id"))
        looked_up = pages.where(reaching).withColumn("_name", name).drop("data")
        lookups = looked_up.select("_name", "_end").distinct().select(
            F.lit(None).cast("bigint").alias("req_id"), F.col("_name").alias("user_id"),
            F.lit(DESC).alias("direction"), F.col("_end").alias("from_time"))
        named = kept.select(name.alias("user_id"), *[c for c in df.columns if c != "user_id"])
        last = batch_fetch(named, lookups, 1, slice_ms).select(
            F.col("user_id").alias("_name"), F.col("from_time").alias("_end"), "data")
        return settled.unionByName(looked_up.join(last, ["_name", "_end"], "left").select(*ANSWER, "data"))
    if dialect == "counted_points":
        low = F.when(going_back, F.lit(0)).otherwise(F.coalesce(cursor, F.lit(0)))
        high = F.when(going_back, F.coalesce(cursor, F.lit(as_of))).otherwise(F.lit(as_of))
        once = df.select(*BY_POINT).distinct().groupBy("user_id", "timestamp").agg(
            F.count("*").alias("n"), F.when(F.count("*") == 1, F.min("notify_id")).alias("notify_id"))
        bounds = asked.withColumns({"_low": low, "_high": high})
        bounds = bounds.withColumns({c: floor_to(c, MS_PER_SECOND) for c in ("_low", "_high")})
        return _within(bounds, df, once, "notify_id", "timestamp", "n", slice_ms=slice_ms)
    if dialect == "inclusive_points":
        low = F.when(going_back, F.lit(0)).otherwise(F.coalesce(cursor, F.lit(0)))
        high = F.when(going_back, F.coalesce(cursor, F.lit(as_of))).otherwise(F.lit(as_of))
        latest = upsert_latest(df.select(*KEY, "data", *day), [*BY_POINT, *day])
        bounds = asked.withColumns({"_low": low, "_high": high})
        return _within(bounds, df, latest, "notify_id", "timestamp", "data", slice_ms=slice_ms)
    raise ValueError(f"unknown dialect: {dialect}")


def _blanked(pages: DataFrame, out: Column) -> DataFrame:
    """Pages without the rows that are ``out``; a request that has none left keeps one blank row.

    Such rows are at the end of a page, so the others keep their ranks.
    """
    gone = F.coalesce(out, F.lit(False))
    columns = [c for c in ("rank", "notify_id", "timestamp", "ingest_seq", "data") if c in pages.columns]
    blank = pages.withColumns({c: F.when(~gone, F.col(c)) for c in columns})
    return blank.where(F.col("rank").isNotNull() | (F.coalesce(pages["rank"], F.lit(1)) == 1))


def _busy_slices(source: DataFrame, slice_ms: int) -> DataFrame:
    """(user, slice of time) of every user with more than ``ROWS_TOGETHER`` rows, with the slice of rows it is in.

    Neighbours in time make up a slice of rows until it has so many; one with more is kept in ``_chunks``
    chunks. There is one row per user and ``slice_ms``, however many rows the user has.
    """
    user = Window.partitionBy("user_id")
    so_far = user.orderBy("_time_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = source.where(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
    parts = known.groupBy("user_id", slice_number("timestamp", slice_ms).alias("_time_slice")).agg(
        F.count("*").alias("_rows"), F.min("timestamp").alias("_first"), F.max("timestamp").alias("_last"))
    counted = parts.select("*", F.sum("_rows").over(user).alias("_all"), F.sum("_rows").over(so_far).alias("_through"))
    sliced = counted.where(F.col("_all") > ROWS_TOGETHER).withColumn(
        "_slice", whole_div(F.col("_through") - F.col("_rows"), ROWS_TOGETHER))
    held = F.sum("_rows").over(Window.partitionBy("user_id", "_slice"))
    return sliced.select("user_id", "_time_slice", "_slice", "_first", "_last", whole_div(held + (ROWS_TOGETHER - 1), ROWS_TOGETHER).alias("_chunks"))


def _within(asked: DataFrame, source: DataFrame, rows: DataFrame, *columns: str, slice_ms: int = MS_PER_DAY) -> DataFrame:
    """Every row of a request's user from ``_low`` to ``_high``; requests without rows stay.

    A user's rows are kept together in one row, those of a busy user in one per slice of time and chunk
    of some hundred rows. Requests meet them by user, slice and chunk and take out what lies inside: a
    busy user's rows spread over tasks, and a request travels once for some hundred rows of its answer,
    not once for each slice of time. ``source`` has the users and times that ``rows`` has, in whatever
    number.

    Dealt requests and kept rows are sorted and merged: their size is not known from the files they come
    from, and a broadcast of them would go through the driver.
    """
    known = ["req_id", "user_id", "direction", "from_time"]
    busy = written(_busy_slices(source, slice_ms), "busy")
    count = busy.count()
    of_user = busy.groupBy("user_id", "_slice", "_chunks").agg(F.min("_first").alias("_first"), F.max("_last").alias("_last")).groupBy(
        F.col("user_id").alias("_busy")).agg(F.collect_list(F.struct("_slice", "_chunks", "_first", "_last")).alias("_slices"))

    zero = F.lit(0).cast("bigint")
    dealt_to = broadcast_if_few(busy.select("user_id", "_time_slice", "_slice", "_chunks"), count)
    chunk = F.pmod(F.xxhash64(*columns), F.coalesce("_chunks", F.lit(1).cast("bigint")))
    kept = (
        rows.where(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
        .withColumn("_time_slice", slice_number("timestamp", slice_ms)).join(dealt_to, ["user_id", "_time_slice"], "left")
        .select("user_id", F.coalesce("_slice", zero).alias("_slice"), chunk.alias("_chunk"), F.struct(*columns).alias("_row"))
        .groupBy("user_id", "_slice", "_chunk").agg(F.collect_list("_row").alias("_rows"))
    )

    def chunks(s: Column) -> Column:
        return F.transform(F.sequence(zero, s["_chunks"] - 1), lambda c: F.struct(s["_slice"].alias("_slice"), c.alias("_chunk")))

    low, high = F.col("_low"), F.col("_high")
    inside = F.filter("_slices", lambda s: (s["_first"] <= high) & (s["_last"] >= low))
    deals = F.when(F.col("_busy").isNull(), F.array(F.struct(zero.alias("_slice"), zero.alias("_chunk")))).otherwise(
        F.flatten(F.transform(inside, chunks)))
    reaches = F.col("direction").isNotNull() & F.col("_user").isNotNull() & (low <= high)
    numbered = asked.select("req_id", F.col("user_id").alias("_user"), "direction", "from_time", "_low", "_high",
                            F.monotonically_increasing_id().alias("_number"))
    dealt = numbered.join(broadcast_if_few(of_user, count), F.col("_user") == F.col("_busy"), "left").withColumn(
        "_deals", F.when(reaches, deals)).select(
        "req_id", F.col("_user").alias("user_id"), "direction", "from_time", "_low", "_high", "_number",
        (F.coalesce(F.size("_deals"), F.lit(0)) > 1).alias("_many"), F.explode_outer("_deals").alias("_deal")).select(
        "*", "_deal._slice", "_deal._chunk").drop("_deal")
    met = dealt.join(kept.hint("merge"), ["user_id", "_slice", "_chunk"], "left").select(
        *known, "_number", "_many", F.filter("_rows", lambda r: r["timestamp"].between(low, high)).alias("_found"))
    some = F.coalesce(F.size("_found") > 0, F.lit(False))
    found = met.where(~F.col("_many") | some).select(*known, F.explode_outer("_found").alias("_row")).select(*known, "_row.*")
    if not count:
        return found
    # A request that reaches one chunk has its blank row from there.
    empty = met.where("_many").groupBy("_number", *known).agg(F.bool_or(some).alias("_some")).where("NOT _some").select(*known)
    return found.unionByName(empty, allowMissingColumns=True)
