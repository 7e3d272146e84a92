"""Jobs that assign time-ordered ids to tables and audit them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.functions.scalar import whole_div
from tidefeed.functions.ulid import (
    HALF,
    WELL_FORMED,
    canonical,
    parts,
    problem,
    random_halves,
    to_bytes,
    ulid,
)
from tidefeed.plans.ordered import positions, previous_value
from tidefeed.plans.pruning import broadcast_if_few
from tidefeed.session import written


def assign_ulids(df: DataFrame, time: str = "timestamp", seed: str = "ingest_seq") -> DataFrame:
    """Adds ``ulid``: the row's time and a random part that depends on the seed column alone."""
    hi, lo = random_halves(F.lit("id"), F.col(seed))
    return df.withColumn("ulid", ulid(time, hi, lo))


def assign_monotonic_ulids(
    df: DataFrame,
    time: str = "timestamp",
    order: str = "ingest_seq",
    start: tuple[Column, Column] | None = None,
) -> DataFrame:
    """Ids that count up within a millisecond, in ``order``.

    The first row of a millisecond gets a random part (``start`` replaces it), each next row
    one more. ``ulid`` wraps to a zero random part past the last value; ``strict_ulid`` is
    null from there on, as no greater id is left in that millisecond, and where the time is
    earlier than that of the row before in ``order``.
    """
    hi, lo = start or random_halves(F.lit("ms"), F.col(time))
    times = df.select(F.lit(0).alias("_all"), F.col(order).alias("_order"), F.col(time).alias("_time"))
    # Only the rows that go back, by their place in the order, which is unique.
    back = previous_value(times, "_all", ["_order"], "_time", "_earlier").where("_time < _earlier")
    back = written(back.select("_order", F.lit(True).alias("_back")), "back")
    marked = df.join(broadcast_if_few(back, back.count()), F.col(order) == F.col("_order"), "left").drop("_order")
    step = positions(marked, time, [order], "_step").withColumns({"_hi": hi, "_lo": lo})
    low = F.col("_lo") + F.col("_step") - 1
    carried = F.col("_hi") + whole_div(low, HALF)
    numbered = step.withColumns(
        {"overflow": carried >= HALF, "hi40": carried % HALF, "lo40": low % HALF}
    ).drop("_step", "_hi", "_lo")
    strict = ~F.col("overflow") & F.col("_back").isNull()
    text = ulid(time, F.col("hi40"), F.col("lo40"))
    return numbered.withColumns(
        {"ulid": text, "strict_ulid": F.when(strict, text)}
    ).drop("_back")


def audit_ulids(df: DataFrame, text: str = "ulid") -> DataFrame:
    """Adds the reason an id is bad ('' if good), its parts, and its 16 bytes in hex."""
    ms, hi, lo = parts(text)
    parsed = df.withColumns({"problem": problem(text), "ms": ms, "hi40": hi, "lo40": lo})
    return parsed.withColumn("bytes_hex", F.hex(to_bytes("ms", "hi40", "lo40")))


def ulid_order_violations(
    df: DataFrame, text: str = "ulid", key: str = "user_id", order: str = "ingest_seq"
) -> DataFrame:
    """Good ids that are not greater than the good id before them in their user's order."""
    good = df.where(F.col(text).rlike(WELL_FORMED)).withColumn("_id", canonical(text))
    paired = previous_value(good, key, [order], "_id", "_before")
    return paired.where(F.col("_id") <= F.col("_before")).select(
        key, order, F.col("_id").alias("ulid"), F.col("_before").alias("previous")
    )
