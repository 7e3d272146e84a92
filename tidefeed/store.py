"""A feed behind one small interface: create, flush, insert, insert from a stream, fetch."""

from __future__ import annotations

import random
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tidefeed.operators import feed as pages
from tidefeed.operators.dialects import RULES, held, retained
from tidefeed.operators.forms import encode_record_json
from tidefeed.operators.requests import batch_fetch_dialect
from tidefeed.operators.store import append, drop_chunks
from tidefeed.operators.validate import validate_strict
from tidefeed.schema import INGESTED, PAGE_SIZE, TTL_SECONDS, WRITTEN
from tidefeed.streaming.ingest import stream_ingest
from tidefeed.streaming.maintain import drop_merged, drop_streamed_chunks, merge_batches, read_streamed


class FeedStore:
    """One stored feed, read and written by the rules of one dialect.

    Batches and streams write to folders of their own, so that a repeated micro-batch can
    replace exactly what it wrote; reading takes both.
    """

    def __init__(self, spark: SparkSession, path: str, dialect: str = "append") -> None:
        if dialect not in RULES:
            raise ValueError(f"unknown dialect: {dialect}")
        self.spark = spark
        self.dialect = dialect
        self.batches = f"{path}/batches"
        self.streams = f"{path}/streams"
        self.rejected = f"{path}/rejected"
        self.writes = f"{path}/writes"
        self._empty(mode="ignore")

    def _empty(self, mode: str) -> None:
        for folder in (self.batches, self.streams, self.rejected):
            empty = self.spark.createDataFrame([], WRITTEN)
            # All partitions go, whatever the session says of overwriting.
            empty.write.mode(mode).option("partitionOverwriteMode", "static").partitionBy("day").parquet(folder)

    def flush(self) -> None:
        """Remove all rows."""
        self._empty(mode="overwrite")

    def _next_write(self) -> int:
        """A number greater than those of all writes before; two writers never share one.

        A writer puts a file of its own for a number, lists again, and keeps the number only if no
        other file has it or a greater one; of two that ask for one number at a time, the later to
        list sees both. The greatest number that was kept stays until a greater one is kept.
        """
        jvm = self.spark._jvm.org.apache.hadoop.fs
        folder = jvm.Path(self.writes)
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        files.mkdirs(folder)

        def asked() -> dict[str, int]:
            names = [status.getPath().getName() for status in files.listStatus(folder)]
            return {name: int(name.partition("-")[0]) for name in names}

        while True:
            number = max(asked().values(), default=0) + 1
            own = f"{number}-{uuid.uuid4().hex}"
            files.create(jvm.Path(folder, own), True).close()
            others = {name: n for name, n in asked().items() if name != own}
            if all(n < number for n in others.values()):
                break
            files.delete(jvm.Path(folder, own), False)
            time.sleep(random.random() / 20)
        for name in others:
            files.delete(jvm.Path(folder, name), False)
        return number

    def _stamped(self, rows: DataFrame) -> DataFrame:
        return rows.select(*INGESTED.names, F.lit(self._next_write()).cast("bigint").alias("write_no"))

    def insert(self, rows: DataFrame) -> None:
        """Write rows; where the dialect validates, one invalid row fails the insert.

        A later insert or micro-batch counts as written later, whatever its ``ingest_seq``, which
        only orders the rows of one write.
        """
        checked = validate_strict(rows) if RULES[self.dialect].validates else rows
        append(self._stamped(checked), self.batches)

    def insert_stream(
        self, stream: DataFrame, progress: str, trigger: dict | None = None
    ) -> StreamingQuery:
        """Write a stream's valid rows in micro-batches, and the others to ``rejected``."""
        return stream_ingest(
            stream.select(*INGESTED.names), self.streams, self.rejected, progress, trigger,
            self._stamped,
        )

    def maintain(self, progress: str, as_of: int | None = None) -> None:
        """Merge the finished micro-batches of the stream with that progress folder into day chunks.

        Where the dialect drops whole chunks, those that have aged out at ``as_of`` go, in what batches
        wrote too. Rows, as the dialect holds them, stay the same. No reader may be on the folders that
        go, nor on those merged before.
        """
        aged = as_of if RULES[self.dialect].retention == "chunks" else None
        merge_batches(self.spark, self.streams, progress, WRITTEN, as_of=aged)
        drop_merged(self.spark, self.streams)
        if aged is not None:
            drop_streamed_chunks(self.spark, self.streams, progress, aged)
            drop_chunks(self.spark, self.batches, aged)

    def written_rows(self) -> DataFrame:
        """Every write that is still there, with its day.

        ``ingest_seq`` is here the pair of the write's number and the row's own sequence.
        """
        read = self.spark.read.schema(WRITTEN)
        streamed = read_streamed(self.spark, self.streams, WRITTEN).select(*WRITTEN.names)
        every = read.parquet(self.batches).unionByName(streamed)
        return every.withColumn("ingest_seq", F.struct("write_no", "ingest_seq")).drop("write_no")

    def rows(self, as_of: int | None = None) -> DataFrame:
        """The rows as the dialect holds them; with ``as_of``, those not aged out by then."""
        rows = self.written_rows()
        rows = rows if as_of is None else retained(rows, self.dialect, as_of)
        return held(rows, self.dialect).withColumn("ingest_seq", F.col("ingest_seq.ingest_seq"))

    def fetch_desc(
        self, user_id: str | None, from_time: int | None = None, *, as_of: int,
        ttl_seconds: int = TTL_SECONDS, limit: int = PAGE_SIZE,
    ) -> DataFrame:
        """Newest first, from a cursor or from ``as_of``; without a user, for every user."""
        return self._fetch(pages.DESC, user_id, from_time, as_of, ttl_seconds, limit)

    def fetch_asc(
        self, user_id: str | None, from_time: int | None = None, *, as_of: int,
        ttl_seconds: int = TTL_SECONDS, limit: int = PAGE_SIZE,
    ) -> DataFrame:
        """Oldest first, from a cursor or from the start; without a user, for every user."""
        return self._fetch(pages.ASC, user_id, from_time, as_of, ttl_seconds, limit)

    def _fetch(self, direction, user_id, from_time, as_of, ttl_seconds, limit) -> DataFrame:
        table = self.written_rows()
        if self.dialect == "append":
            return pages.feed(table, direction, user_id, from_time, limit)
        if self.dialect == "key_range":
            return pages.feed_keyrange(
                table, direction, as_of, user_id, from_time, ttl_seconds, limit
            )
        if self.dialect == "retention_range":
            return pages.feed_retention_range(
                table, direction, as_of, user_id, from_time, ttl_seconds, limit
            )
        if self.dialect == "counted_points":
            return pages.counted_points(table, direction, as_of, user_id, from_time)
        return pages.inclusive_points(
            encode_record_json(table), direction, as_of, user_id, from_time
        )

    def fetch_all(
        self, requests: DataFrame, *, as_of: int, ttl_seconds: int = TTL_SECONDS,
        limit: int = PAGE_SIZE,
    ) -> DataFrame:
        """Answer a table of ``req_id, user_id, direction, from_time`` at once."""
        return batch_fetch_dialect(
            self.written_rows(), requests, self.dialect, as_of, ttl_seconds, limit
        )
