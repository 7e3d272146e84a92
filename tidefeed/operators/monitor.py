"""Operation-log analysis: search, node filter, report, export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefeed.functions.scalar import hours_between, json_integer
from tidefeed.plans.pruning import time_range


def monitor_search(
    log: DataFrame,
    step: str | None = None,
    min_time: int | None = None,
    max_time: int | None = None,
) -> DataFrame:
    """Entries of one step, strictly between two times; every condition may be left out."""
    kept = time_range(log, min_time, max_time, lower_inclusive=False, upper_inclusive=False)
    return kept if step is None else kept.where(F.col("step") == step)


def monitor_node_filter(log: DataFrame, marker: str) -> DataFrame:
    """Entries whose node name contains the marker; a missing name does not."""
    return log.where(F.col("nodeName").contains(marker))


def monitor_report(
    log: DataFrame,
    marker: str,
    step: str | None = None,
    min_time: int | None = None,
    max_time: int | None = None,
) -> DataFrame:
    """Per request its duration, size, and the hours since it was asked for."""
    chosen = monitor_node_filter(monitor_search(log, step, min_time, max_time), marker)
    return chosen.select(
        "step",
        "requestID",
        "duration",
        json_integer("extension", "$.size").alias("size"),
        hours_between("timestamp", json_integer("extension", "$.requestedTimestamp")).alias(
            "distance"
        ),
    )


def export_report(report: DataFrame, path: str) -> None:
    """The report as CSV with a header, one directory per step, distance with two decimals."""
    text = report.withColumn("distance", F.format_string("%.2f", "distance"))
    text.hint("rebalance", "step").write.option("header", True).partitionBy("step").csv(path)
