"""Exact percentiles of groups of any size, by selection.

The values are counted per (group, value) first, so equal values travel once a task, and a group's
values are spread over all tasks. Then the value of a rank is found from its high bits to its low ones:
a pass counts, per group, the values by their next ``BITS`` bits, picks the count that the rank falls
in, and goes on inside it. A pass keeps at most ``2 ** BITS`` counts of a group together, however many
values the group has, and there are as many passes as the values' range has bits, divided by ``BITS``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.plans.pruning import broadcast_if_few
from tidefeed.session import written

BITS = 12
SIGN = -(1 << 63)


def _prefix(value: Column, shift: int) -> Column:
    """The bits of a bigint from ``shift`` up, in the order of the values."""
    ordered = value.bitwiseXOR(F.lit(SIGN).cast("bigint"))
    return F.shiftrightunsigned(ordered, shift) if shift < 64 else F.lit(0).cast("bigint")


def exact_percentiles(df: DataFrame, by: Sequence[str], value: str, percents: Sequence[int], bits: int = BITS) -> DataFrame:
    """``by`` and ``p<percent>``: the least value that so many percent of the group's values do not exceed.

    Values are whole numbers; nulls do not count, and a group of nulls only has no row. Null keys are
    keys. Percents lie between 0, the least value, and 100, the greatest.
    """
    if any(not 0 <= p <= 100 for p in percents):
        raise ValueError("percents must lie between 0 and 100")
    value_col = F.col(value).cast("bigint")
    keys = [F.col(c).alias(f"_k{i}") for i, c in enumerate(by)] or [F.lit(0).alias("_k0")]
    names = [f"_k{i}" for i in range(max(1, len(by)))]
    counted = written(
        df.select(*keys, value_col.alias("_v")).where("_v IS NOT NULL").groupBy(*names, "_v").agg(F.count("*").alias("_n")), "counted")
    low, high, groups = counted.agg(F.min("_v"), F.max("_v"), F.approx_count_distinct(F.struct(*names))).first()
    share = F.explode(F.array(*[F.lit(p) for p in percents])).alias("_p")
    ranks = counted.groupBy(*names).agg(F.sum("_n").alias("_all")).select("*", share)
    rank = F.call_function("div", F.col("_all") * F.col("_p") + 99, F.lit(100).cast("bigint"))
    # All values share the bits above those in which the least and the greatest differ.
    low, high = (0 if end is None else end - SIGN for end in (low, high))
    top = max(1, -(-(low ^ high).bit_length() // bits)) * bits
    shared = F.lit(low >> top).cast("bigint")
    targets = ranks.select(*names, "_p", F.greatest(F.lit(1).cast("bigint"), rank).alias("_rank"), shared.alias("_at"))
    few = 2 * groups * len(percents)
    so_far = Window.partitionBy(*names, "_p").orderBy("_next").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    for shift in range(top - bits, -1, -bits):
        same = [F.col(f"c.{n}").eqNullSafe(F.col(f"t.{n}")) for n in names]
        inside = _prefix(F.col("c._v"), shift + bits) == F.col("t._at")
        narrowed = broadcast_if_few(targets, few).alias("t")
        counts = (
            counted.alias("c").join(narrowed, [*same, inside])
            .groupBy(*[F.col(f"t.{n}").alias(n) for n in names], "_p", "_rank", _prefix(F.col("c._v"), shift).alias("_next"))
            .agg(F.sum("_n").alias("_n"))
            .withColumn("_through", F.sum("_n").over(so_far))
        )
        targets = counts.where((F.col("_through") >= F.col("_rank")) & (F.col("_through") - F.col("_n") < F.col("_rank"))).select(
            *names, "_p", (F.col("_rank") - F.col("_through") + F.col("_n")).alias("_rank"), F.col("_next").alias("_at"))
        if shift:
            targets = written(targets, "targets")
    found = targets.withColumn("_value", F.col("_at").bitwiseXOR(F.lit(SIGN).cast("bigint")))
    wide = found.groupBy(*names).agg(*[F.max(F.when(F.col("_p") == p, F.col("_value"))).alias(f"p{p}") for p in percents])
    return wide.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(by)], *[f"p{p}" for p in percents])
