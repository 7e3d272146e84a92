"""What each dialect does to rows on their way in, and how long it keeps them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefeed.operators.identity import BY_POINT, BY_TIME, upsert_latest
from tidefeed.operators.store import retain_chunks, retain_ttl
from tidefeed.operators.validate import validate_split


@dataclass(frozen=True)
class WriteRules:
    """``identity`` None means that every write adds a row."""

    identity: tuple[str, ...] | None
    validates: bool
    keeps_payload: bool = True
    retention: str | None = None     # "ttl" by row, "chunks" by whole day


# ---- fixed values -----------------------------------------------------------------
RULES = {
    "key_range": WriteRules(BY_TIME, validates=True, retention="ttl"),
    "append": WriteRules(None, validates=True, retention="chunks"),
    "retention_range": WriteRules(BY_POINT, validates=False, retention="ttl"),
    "counted_points": WriteRules(BY_POINT, validates=False, keeps_payload=False),
    "inclusive_points": WriteRules(BY_POINT, validates=False),
}
# -----------------------------------------------------------------------------------


def accepted(df: DataFrame, dialect: str) -> DataFrame:
    """The rows that the dialect lets in."""
    return validate_split(df)[0] if RULES[dialect].validates else df


def held(written: DataFrame, dialect: str) -> DataFrame:
    """The rows that are there after these, already let in, have been written."""
    rules = RULES[dialect]
    # The day follows from the time: with it in the key, bounds on it still reach the scan.
    day = [c for c in written.columns if c == "day"]
    kept = written if rules.identity is None else upsert_latest(written, [*rules.identity, *day])
    if not rules.keeps_payload:
        kept = kept.withColumn("data", F.lit(None).cast("string"))
    return kept


def as_stored(df: DataFrame, dialect: str) -> DataFrame:
    """What is left of ``df`` once it has been let in and written."""
    return held(accepted(df, dialect), dialect)


def retained(df: DataFrame, dialect: str, as_of: int) -> DataFrame:
    """The rows that have not aged out."""
    rules = RULES[dialect]
    if rules.retention == "ttl":
        return retain_ttl(df, as_of)
    if rules.retention == "chunks":
        return retain_chunks(df, as_of).select(*df.columns)
    return df
