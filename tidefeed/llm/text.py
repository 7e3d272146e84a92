"""Small helpers on text columns and on Arrow text arrays."""

from __future__ import annotations

import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Most text bytes that one numpy step works on.
BLOCK_BYTES = 4 << 20
#: Most rows of a table of a few numbers that is sent to every executor.
BROADCAST_ROWS = 500_000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors' Python, once for each application.

    Spark serves the archive from the driver; nothing reads it by its path.
    """
    context = spark.sparkContext
    if getattr(context, "_tidefeed_shipped", None) is None:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        root, name = os.path.split(package)
        base = os.path.join(tempfile.mkdtemp(prefix="tidefeed-code-"), name)
        context.addPyFile(shutil.make_archive(base, "zip", root, name))
        context._tidefeed_shipped = True


def checked_broadcast(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored narrow table if it has few rows; else leave the join to a shuffle."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def boxed(docs: DataFrame, text: str) -> DataFrame:
    """``_row``, the whole row as a struct, and ``_text``: added columns clash with none of a row's."""
    return docs.select(F.struct("*").alias("_row"), F.col(text).alias("_text"))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other letter stays."""
    return F.translate(text, UPPER, LOWER)


def spaced_words(text: Column) -> Column:
    """Runs of characters other than space and \\x09 to \\x0D; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+")
    return F.array_remove(parts, F.lit(""))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; -1 for a null id."""
    crc = F.crc32(F.encode(doc_id.cast("string"), "UTF-8"))
    return F.coalesce(crc % by, F.lit(-1).cast("long"))


def hand_back() -> None:
    """Give memory that the ended task has freed back to the system.

    A Python worker goes on to tasks of other stages, and would keep it beside what those need.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        # Another C library; it keeps what it keeps.
        pass


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """Cut a text array into (first row, slice) of about ``limit`` bytes; a longer text is alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(column):
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield first, column.slice(first, last - first)
        first = last


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text array in a row, and each text's length in bytes (null: 0)."""
    filled = pc.fill_null(column, "") if column.null_count else column
    wide = isinstance(filled, pa.LargeStringArray)
    _, offsets, data = filled.buffers()
    kind = np.int64 if wide else np.int32
    at = np.frombuffer(offsets, dtype=kind)[filled.offset : filled.offset + len(filled) + 1]
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(filled), np.int64)
    return np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]], np.diff(at).astype(np.int64)
