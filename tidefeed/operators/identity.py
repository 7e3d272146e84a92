"""What counts as the same row, and which of two writes stays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# ---- fixed values: row identity per kind of store -----------------------------------
BY_TIME = ("user_id", "timestamp")
BY_POINT = ("user_id", "notify_id", "timestamp")
# -------------------------------------------------------------------------------------


def upsert_latest(
    df: DataFrame, identity: Sequence[str] = BY_TIME, sequence: str = "ingest_seq"
) -> DataFrame:
    """Of the rows with one identity, the one written last.

    An aggregate rather than a window: each map task sends at most one row per identity, so
    a row rewritten a billion times costs no more to shuffle than one written once.
    """
    rest = [c for c in df.columns if c not in identity]
    last = F.max_by(F.struct(*rest), sequence).alias("_last")
    return df.groupBy(*identity).agg(last).select(
        *[c if c in identity else F.col(f"_last.{c}").alias(c) for c in df.columns]
    )


def first_per_id(df: DataFrame) -> DataFrame:
    """One row per user and id: its earliest time and its latest payload."""
    return df.groupBy("user_id", "notify_id").agg(
        F.min("timestamp").alias("timestamp"),
        F.max_by("data", F.struct("timestamp", "ingest_seq")).alias("data"),
    )
