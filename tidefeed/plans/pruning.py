"""Day-chunk pruning."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefeed.schema import MS_PER_DAY

FIRST_DAY = dt.date(1970, 1, 1)

# Rows of a few narrow columns that every executor may hold, some tens of megabytes.
BROADCAST_ROWS = 500_000


def day_literal(ms: int) -> dt.date:
    """The UTC day of a time, kept inside what a date can say."""
    days = max(min(ms // MS_PER_DAY, 2_932_896), -719_162)
    return FIRST_DAY + dt.timedelta(days=days)


def time_range(
    df: DataFrame,
    lower: int | None = None,
    upper: int | None = None,
    lower_inclusive: bool = True,
    upper_inclusive: bool = True,
    column: str = "timestamp",
) -> DataFrame:
    """Rows whose time lies in the range; a missing bound leaves that side open.

    A predicate on the time column alone reaches the Parquet row groups but prunes no
    directory. Where the table has a ``day`` partition column the same bounds go on it too.
    """
    time = F.col(column)
    has_day = "day" in df.columns
    if lower is not None:
        df = df.where(time >= lower if lower_inclusive else time > lower)
        if has_day:
            df = df.where(F.col("day") >= F.lit(day_literal(lower)))
    if upper is not None:
        df = df.where(time <= upper if upper_inclusive else time < upper)
        if has_day:
            df = df.where(F.col("day") <= F.lit(day_literal(upper)))
    return df


def broadcast_if_few(df: DataFrame, at_most: int) -> DataFrame:
    """``df`` with a broadcast hint where it is known to have few rows.

    ``at_most`` is a bound the caller has counted. Without the hint Spark would shuffle the
    large side before it learns that the other one is small; beyond the limit it has to.
    """
    return F.broadcast(df) if at_most <= BROADCAST_ROWS else df
