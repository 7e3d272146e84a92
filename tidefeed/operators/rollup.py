"""Counts per user at doubling widths: any interval is a sum of a few of them.

A roll-up has a row per user, level and slot that holds an event. On level k a slot is ``2 ** k`` units
wide and starts at a multiple of that. An interval of n units is cut into at most two slots a level,
``2 * log2(n)`` in all, whatever it begins or ends with. Counts add up: the roll-up of two tables
together is the sum of their roll-ups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.functions.scalar import slice_number

#: Units are seconds unless said otherwise, and the widest slot of 2 ** 22 of them is 48 days.
UNIT_MS = 1000
LEVELS = 22
#: Slots up to this level are summed among the units of a slot of this level, 4.5 hours, and wider ones from those.
LOWER = 14


def dyadic_rollup(df: DataFrame, unit_ms: int = UNIT_MS, levels: int = LEVELS) -> DataFrame:
    """(user_id, level, slot, events) of all rows with a user and a time.

    Rows are summed per user and unit, and units per user and block of ``2 ** LOWER`` of them, both with
    a map-side combine, so a hot user's events do not travel one by one. A block's units go to one task
    and up the lower levels there; a user's blocks, at most one for each of the time span, go up the
    upper ones. What travels is units and blocks, not a row for each of their levels.
    """
    known = df.where(F.col("user_id").isNotNull() & F.col("timestamp").isNotNull())
    units = known.groupBy("user_id", slice_number("timestamp", unit_ms).alias("_unit")).agg(F.count("*").alias("events"))
    lower = min(levels, LOWER)
    block = F.shiftright("_unit", lower).alias("_block")
    # A number of tasks that is kept, however small their input: each unit grows into a row per level.
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def up(rows: DataFrame, at: str, on: int, first: int, last: int, *key: str) -> DataFrame:
        """Slots of the levels from ``first`` to ``last``, of rows that are slots ``at`` of level ``on``."""
        level = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level")
        return (
            rows.repartition(tasks, *key).select(*key, at, "events", level)
            .groupBy(*key, "level", F.expr(f"shiftright({at}, level - {on})").alias("slot"))
            .agg(F.sum("events").alias("events")).select("user_id", "level", "slot", "events")
        )

    low = up(units.select("user_id", "_unit", block, "events"), "_unit", 0, 0, lower, "user_id", "_block")
    if levels == lower:
        return low
    blocks = units.groupBy("user_id", block).agg(F.sum("events").alias("events"))
    return low.unionByName(up(blocks, "_block", lower, lower + 1, levels, "user_id"))


def add_rollups(*rollups: DataFrame) -> DataFrame:
    """The roll-up of all tables together."""
    whole = rollups[0].select("user_id", "level", "slot", "events")
    for other in rollups[1:]:
        whole = whole.unionByName(other.select(*whole.columns))
    return whole.groupBy("user_id", "level", "slot").agg(F.sum("events").alias("events"))


def interval_slots(low: Column, high: Column, levels: int = LEVELS) -> Column:
    """The slots (level, slot) that make up the units from ``low`` on and before ``high``.

    Going up the levels, a slot that is the right half of its parent goes out at the low end, and one
    that is a left half at the high end; what is left on the last level is taken as it is.
    """
    ends = F.struct(low.cast("bigint").alias("low"), high.cast("bigint").alias("high"))

    def on_level(end: Column, k: Column) -> Column:
        # The ends on level k: rounded up at the low end, down at the high end.
        width = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        first = F.call_function("shiftright", end["low"] + width - 1, k)
        last = F.call_function("shiftright", end["high"], k)
        top = k == levels

        def slot(at: Column) -> Column:
            return F.struct(k.alias("level"), at.alias("slot"))

        none = F.array().cast("array<struct<level: int, slot: bigint>>")
        inner = F.concat(
            F.when(F.pmod(first, F.lit(2)) == 1, F.array(slot(first))).otherwise(none),
            F.when(F.pmod(last, F.lit(2)) == 1, F.array(slot(last - 1))).otherwise(none),
        )
        whole = F.transform(F.sequence(first, last - 1), slot)
        return F.when(first >= last, none).when(top, whole).otherwise(inner)

    levels_up = F.sequence(F.lit(0), F.lit(levels))
    return F.element_at(
        F.transform(F.array(ends), lambda end: F.flatten(F.transform(levels_up, lambda k: on_level(end, k)))), 1)


def interval_counts(rollup: DataFrame, asked: DataFrame, unit_ms: int = UNIT_MS, levels: int = LEVELS) -> DataFrame:
    """``asked`` (user_id, from_ms, to_ms) with ``events``: those from ``from_ms`` on and before ``to_ms``.

    Both ends are cut to the unit. The join is on (user, level, slot), of which the roll-up has one row
    each; nothing of it grows with the interval but by its logarithm. An interval of a user without
    events, without a user, or that ends before it begins, has none. Repeated intervals are asked once.
    """
    low, high = (slice_number(c, unit_ms) for c in ("from_ms", "to_ms"))
    keyed = asked.select("*", low.alias("_low"), high.alias("_high"))
    once = keyed.select("user_id", "_low", "_high").distinct()
    slots = once.select("user_id", "_low", "_high", F.inline(interval_slots(F.col("_low"), F.col("_high"), levels)))
    counted = slots.join(rollup, ["user_id", "level", "slot"]).groupBy("user_id", "_low", "_high").agg(
        F.sum("events").alias("events"))
    zero = F.lit(0).cast("bigint")
    return keyed.join(counted, ["user_id", "_low", "_high"], "left").select(
        *asked.columns, F.coalesce("events", zero).alias("events"))


def trailing_counts(rollup: DataFrame, interval_ms: int, unit_ms: int = UNIT_MS, levels: int = LEVELS) -> DataFrame:
    """Per user and unit with an event, the events of the last ``interval_ms``, both ends included.

    The units with events are the lowest level of the roll-up, so no event is read again.
    """
    if interval_ms <= 0 or interval_ms % unit_ms:
        raise ValueError("the interval must be a positive multiple of the unit")
    at = F.col("slot") * unit_ms
    asked = rollup.where("level = 0").select(
        "user_id", at.alias("timestamp"), F.col("events").alias("n"),
        (at - interval_ms).alias("from_ms"), (at + unit_ms).alias("to_ms"))
    return interval_counts(rollup, asked, unit_ms, levels).select(
        "user_id", "timestamp", "n", F.col("events").alias("trailing_count"))
