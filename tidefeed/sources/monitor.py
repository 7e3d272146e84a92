"""Reading operation logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

from tidefeed.schema import MONITOR_LOG


def load_monitor_log(
    spark: SparkSession, path: str, wrapped: bool = False, file_format: str = "json"
) -> DataFrame:
    """Log documents under a path or glob, in the fixed schema.

    The schema is given, so nothing is read to infer it; ``extension`` stays JSON text.
    ``wrapped`` reads search hits, with the document under ``_source``. A folder of one directory
    per day, named whole and not by a glob, adds ``day``, by which a time search skips directories.
    """
    if not wrapped:
        return spark.read.schema(MONITOR_LOG).format(file_format).load(path)
    hit = StructType([StructField("_source", MONITOR_LOG)])
    hits = spark.read.schema(hit).format(file_format).load(path)
    return hits.select("_source.*", *[c for c in hits.columns if c != "_source"])
