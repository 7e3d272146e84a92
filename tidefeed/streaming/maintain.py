"""Upkeep of a folder that a stream writes: micro-batches into segments, expired days away.

A streamed folder holds ``batch_id=N/day=D`` as the stream writes it, and ``_merged/<first>-<last>/day=D``:
a segment has all rows of the micro-batches from first to last, each row with its ``batch_id``. A
segment counts from the moment its write is complete; until then, and after any failure, its parts
still do. What a segment has replaced is deleted later, in a step of its own.

New segments take in the one before them as long as that is not much larger than all that comes after
it, so their number grows with the logarithm of the folder and a row is written again as seldom.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidefeed.operators.identity import upsert_latest
from tidefeed.operators.store import first_kept_day
from tidefeed.schema import CHUNK_RETENTION_DAYS, STORED

MERGED = "_merged"
#: A segment is merged with what follows it unless it is more than this many times as large.
GROWTH = 4


def _files(spark: SparkSession, path: str):
    """(file system, path) as Spark's own writers see them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _names(spark: SparkSession, path: str) -> list[str]:
    files, folder = _files(spark, path)
    return [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []


def _delete(spark: SparkSession, path: str) -> None:
    files, folder = _files(spark, path)
    files.delete(folder, True)


def _size(spark: SparkSession, path: str) -> int:
    files, folder = _files(spark, path)
    return files.getContentSummary(folder).getLength()


def committed_batch(spark: SparkSession, checkpoint: str) -> int:
    """The last micro-batch that the stream has committed, which it never runs again; -1 if none."""
    return max((int(name) for name in _names(spark, f"{checkpoint}/commits") if name.isdigit()), default=-1)


def _batches(spark: SparkSession, path: str) -> list[int]:
    return sorted(int(n.removeprefix("batch_id=")) for n in _names(spark, path) if n.startswith("batch_id="))


def _segments(spark: SparkSession, path: str) -> list[tuple[int, int]]:
    """(first, last) of all complete segments."""
    out = []
    for name in _names(spark, f"{path}/{MERGED}"):
        files, marker = _files(spark, f"{path}/{MERGED}/{name}/_SUCCESS")
        if files.exists(marker):
            first, last = name.split("-")
            out.append((int(first), int(last)))
    return out


def _current(segments: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The segments that count: of those that hold one another, the widest. They follow one another."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(segments, key=lambda s: (s[0], -s[1])):
        if not out or first > out[-1][1]:
            out.append((first, last))
    return out


def _read(spark: SparkSession, path: str, schema: StructType, segments: Sequence[tuple[int, int]],
          batches: Sequence[int]) -> DataFrame:
    """Rows of segments and micro-batches, with ``batch_id``; chunks are pruned in both."""
    numbered = StructType([f for f in schema.fields if f.name != "batch_id"] + [StructField("batch_id", LongType())])
    read = spark.read.schema(numbered)
    parts = [read.parquet(f"{path}/{MERGED}/{first}-{last}") for first, last in segments]
    if batches:
        parts.append(read.option("basePath", path).parquet(*[f"{path}/batch_id={n}" for n in batches]))
    if not parts:
        return spark.createDataFrame([], numbered)
    return reduce(DataFrame.unionByName, [part.select(*numbered.names) for part in parts])


def read_streamed(spark: SparkSession, path: str, schema: StructType = STORED, chunk: str = "day") -> DataFrame:
    """Every row of a streamed folder, with its ``batch_id``, whatever has been merged.

    ``chunk`` is the column that names the directories of a micro-batch.
    """
    if chunk not in schema.names:
        raise ValueError(f"no column {chunk} to find the chunks by")
    segments = _current(_segments(spark, path))
    after = segments[-1][1] if segments else -1
    return _read(spark, path, schema, segments, [n for n in _batches(spark, path) if n > after])


def merge_batches(spark: SparkSession, path: str, checkpoint: str, schema: StructType = STORED,
                  identity: Sequence[str] | None = None, as_of: int | None = None,
                  keep_days: int = CHUNK_RETENTION_DAYS, chunk: str = "day") -> str | None:
    """Merge the finished micro-batches into a segment in day chunks; the stream may go on meanwhile.

    With ``identity``, only the last write per identity stays; a later one, in another segment or
    micro-batch, still wins when read. With ``as_of``, day chunks that the retention has passed are
    left out. Returns the folder of the new segment, None if there is nothing to merge.
    """
    segments = _current(_segments(spark, path))
    after = segments[-1][1] if segments else -1
    last = committed_batch(spark, checkpoint)
    batches = [n for n in _batches(spark, path) if after < n <= last]
    if not batches:
        return None
    size = sum(_size(spark, f"{path}/batch_id={n}") for n in batches)
    taken: list[tuple[int, int]] = []
    for segment in reversed(segments):
        own = _size(spark, f"{path}/{MERGED}/{segment[0]}-{segment[1]}")
        if own > GROWTH * size:
            break
        taken.insert(0, segment)
        size += own
    rows = _read(spark, path, schema, taken, batches)
    if as_of is not None:
        rows = rows.where(F.col("day") >= F.lit(first_kept_day(as_of, keep_days)))
    if identity is not None:
        order = F.struct("batch_id", "ingest_seq")
        rows = upsert_latest(rows.withColumn("_write", order), [*identity, chunk], "_write").drop("_write")
    target = f"{path}/{MERGED}/{taken[0][0] if taken else after + 1}-{last}"
    # An attempt that did not end is replaced.
    (rows.hint("rebalance", chunk).write.mode("overwrite").option("partitionOverwriteMode", "static")
     .partitionBy(chunk).parquet(target))
    return target


def drop_merged(spark: SparkSession, path: str) -> list[str]:
    """Delete what complete segments hold, when no reader is left on it."""
    every = _segments(spark, path)
    current = _current(every)
    if not current:
        return []
    old = [f"batch_id={n}" for n in _batches(spark, path) if n <= current[-1][1]]
    old += [f"{MERGED}/{first}-{last}" for first, last in every if (first, last) not in current]
    for name in old:
        _delete(spark, f"{path}/{name}")
    return sorted(old)


def drop_streamed_chunks(spark: SparkSession, path: str, checkpoint: str, as_of: int,
                         keep_days: int = CHUNK_RETENTION_DAYS) -> list[str]:
    """Delete the day chunks that the retention has passed, in segments and finished micro-batches.

    Only directory names are read, never rows.
    """
    oldest = f"day={first_kept_day(as_of, keep_days).isoformat()}"
    last = committed_batch(spark, checkpoint)
    folders = [f"batch_id={n}" for n in _batches(spark, path) if n <= last]
    folders += [f"{MERGED}/{first}-{last}" for first, last in _segments(spark, path)]
    dropped = [f"{folder}/{name}" for folder in folders for name in _names(spark, f"{path}/{folder}")
               if name.startswith("day=") and name < oldest]
    for name in dropped:
        _delete(spark, f"{path}/{name}")
    return sorted(dropped)
