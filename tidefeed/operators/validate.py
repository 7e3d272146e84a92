"""Row validation: who wrote it, which id, which payload. The time is never checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefeed.functions.scalar import is_json_object


def with_reject_reason(df: DataFrame) -> DataFrame:
    """Adds ``reject_reason``: the first bad column, or '' for a valid row."""
    reason = (
        F.when(F.col("user_id").isNull(), "user_id")
        .when(F.col("notify_id").isNull(), "notify_id")
        .when(~is_json_object("data"), "data")
        .otherwise("")
    )
    return df.withColumn("reject_reason", reason)


def validate_split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their reason)."""
    marked = with_reject_reason(df)
    valid = marked.where("reject_reason = ''").drop("reject_reason")
    return valid, marked.where("reject_reason <> ''")


def validate_strict(df: DataFrame) -> DataFrame:
    """The rows themselves; the first invalid one fails the query, whatever columns it reads."""
    marked = with_reject_reason(df)
    failed = F.raise_error(F.concat(F.lit("invalid row, column "), F.col("reject_reason")))
    good = F.when(F.col("reject_reason") == "", F.lit(True)).otherwise(failed.cast("boolean"))
    return marked.where(good).drop("reject_reason")
