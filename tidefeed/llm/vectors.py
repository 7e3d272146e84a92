"""Exact search for the vectors with the highest inner products, by statistics of segments.

A vector is cut into equal segments, and each segment is kept as its mean and deviation. For vectors q
and v and a segment of L components, the squared distance is at least
``L * ((mean_q - mean_v) ** 2 + (dev_q - dev_v) ** 2)``. With the vectors' own lengths that is an upper
bound of the inner product, and a pair whose bound is below the query's k-th best product so far
cannot be in its answer. ``LEVELS`` bounds are taken from coarse to fine, each over the pairs that the
one before has left, and only the survivors' products are computed in full.

Queries are packed into blocks; blocks of about ``GROUP_BYTES`` are sent to all tasks at a time, and
each such group is one pass over the rows. A task holds k answers for each query of the group, however
many rows it reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefeed.llm.text import ship
from tidefeed.session import new_folder, written

#: Segments of a vector on each level, coarse to fine; a level as fine as the vector is left out.
LEVELS = (4, 16)
BLOCK_BYTES = 1 << 20
#: Bytes of queries that are sent to the tasks at a time, about.
GROUP_BYTES = 16 << 20
#: Queries of the group that every task scores first, so that it knows a bound before its first row.
SEEDS = 1024
#: Queries and rows of one matrix of bounds, and pairs computed together one by one.
QUERIES, ROWS, PAIRS = 1024, 2048, 1 << 16
#: Products and sums below this are exact in doubles.
EXACT = float(1 << 53)

ANSWER = "query_number long, query_id long, vec_id long, score long"
PACKED = "block long, dim int, ids binary, data binary"


def scaled(vector: str, scale: int) -> Column:
    """``scale * x`` of each component as doubles; null if any component is null or not finite."""
    times = F.transform(vector, lambda x: x.cast("double") * scale)
    return F.when(F.forall(times, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), times)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, floors of the components) of the vectors of each length in a batch of (id, array of doubles)."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    lists = batch.column(1)
    lengths = np.asarray(lists.value_lengths())
    data = np.floor(lists.flatten().to_numpy(zero_copy_only=False))
    ends = np.cumsum(lengths)
    for dim in np.unique(lengths):
        own = np.flatnonzero(lengths == dim)
        at = (ends[own] - dim)[:, None] + np.arange(dim)
        yield ids[own], data[at].reshape(len(own), dim)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, matrix in _matrices(batch):
            step = max(1, BLOCK_BYTES // (8 * max(1, matrix.shape[1])))
            for at in range(0, len(ids), step):
                part = ids[at : at + step]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([int(part[0])], pa.int64()), "dim": pa.array([matrix.shape[1]], pa.int32()),
                    "ids": pa.array([part.astype("<i8").tobytes()], pa.binary()),
                    "data": pa.array([matrix[at : at + step].astype("<f8").tobytes()], pa.binary()),
                })


def features(matrix: np.ndarray, segments: int) -> np.ndarray:
    """Mean and deviation of each segment, both times the root of its length.

    The inner product of two such rows is the bound that the segments give for the vectors' product.
    """
    edges = np.linspace(0, matrix.shape[1], segments + 1).astype(np.int64)
    long = np.diff(edges)
    mean = np.add.reduceat(matrix, edges[:-1], axis=1) / long
    spread = np.add.reduceat((matrix - np.repeat(mean, long, axis=1)) ** 2, edges[:-1], axis=1)
    return np.concatenate([mean * np.sqrt(long), np.sqrt(spread)], axis=1)


class _Side:
    """Vectors of one length with what the bounds need of them."""

    def __init__(self, ids: np.ndarray, matrix: np.ndarray):
        self.ids, self.matrix = ids, matrix
        self.norm = np.sqrt((matrix * matrix).sum(1))
        self.levels = [features(matrix, n) for n in LEVELS if n < matrix.shape[1]]

    def part(self, rows: slice) -> _Side:
        out = object.__new__(_Side)
        out.ids, out.matrix, out.norm = self.ids[rows], self.matrix[rows], self.norm[rows]
        out.levels = [level[rows] for level in self.levels]
        return out


def _products(q: np.ndarray, v: np.ndarray, exact: bool) -> np.ndarray:
    """Inner products of rows with rows, whole numbers as doubles, or as Python's where doubles may round."""
    if exact:
        return np.einsum("ij,ij->i", q, v)
    return np.array([sum(int(a) * int(b) for a, b in zip(x, y, strict=True)) for x, y in zip(q, v, strict=True)], object)


def survivors(q: _Side, v: _Side, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of v, product) of all pairs whose product may be ``least`` of the query or more."""
    exact = bool(q.norm.max(initial=0) * v.norm.max(initial=0) < EXACT)
    # The bounds are rounded, by far less than this.
    slack = 1e-9 * (q.norm[:, None] * v.norm[None, :] + 1)
    left = None
    for mine, theirs in zip(q.levels, v.levels, strict=True):
        if left is None:
            at, of = np.nonzero(~(mine @ theirs.T + slack < least[:, None]))
        else:
            at, of = left
            if len(at) * 8 > len(q.ids) * len(v.ids):
                good = ~(mine @ theirs.T + slack < least[:, None])[at, of]
            else:
                good = np.concatenate([
                    ~(np.einsum("ij,ij->i", mine[at[k : k + PAIRS]], theirs[of[k : k + PAIRS]])
                      + slack[at[k : k + PAIRS], of[k : k + PAIRS]] < least[at[k : k + PAIRS]])
                    for k in range(0, max(1, len(at)), PAIRS)])
            at, of = at[good], of[good]
        left = at, of
    if left is None:
        left = np.divmod(np.arange(len(q.ids) * len(v.ids)), max(1, len(v.ids)))
    at, of = left
    if exact and len(at) * 8 > len(q.ids) * len(v.ids):
        score = (q.matrix @ v.matrix.T)[at, of]
    else:
        score = np.concatenate([
            _products(q.matrix[at[k : k + PAIRS]], v.matrix[of[k : k + PAIRS]], exact) for k in range(0, max(1, len(at)), PAIRS)])
    good = (score >= least[at]) & (q.ids[at] != v.ids[of])
    return at[good], of[good], score[good]


class _Best:
    """The k best rows so far of each query."""

    def __init__(self, queries: _Side, k: int):
        self.queries, self.k = queries, k
        self.at, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.scores = np.zeros(0, object)
        self.least = np.full(len(queries.ids), -np.inf)

    def see(self, rows: _Side) -> None:
        for first in range(0, len(self.queries.ids), QUERIES):
            own = slice(first, first + QUERIES)
            for start in range(0, len(rows.ids), ROWS):
                part = rows.part(slice(start, start + ROWS))
                at, of, score = survivors(self.queries.part(own), part, self.least[own])
                if len(at):
                    self._keep(at + first, part.ids[of], score)

    def _keep(self, at: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        touched = np.isin(self.at, at)
        at = np.concatenate([self.at[touched], at])
        ids = np.concatenate([self.ids[touched], ids])
        score = np.concatenate([self.scores[touched], score])
        # Doubles order the whole numbers that they hold exactly, and Python's own order the others.
        plain = score.astype(np.float64) if all(abs(s) < EXACT for s in (score.min(), score.max())) else None
        order = np.lexsort((ids, -plain, at)) if plain is not None else np.array(
            sorted(range(len(at)), key=lambda i: (at[i], -score[i], ids[i])))
        at, ids, score = at[order], ids[order], score[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        kept = place < self.k
        full = place == self.k - 1
        self.least[at[full]] = np.maximum(self.least[at[full]], np.nextafter(score[full].astype(np.float64), -np.inf)
                                          if plain is None else plain[order][full])
        self.at = np.concatenate([self.at[~touched], at[kept]])
        self.ids = np.concatenate([self.ids[~touched], ids[kept]])
        self.scores = np.concatenate([self.scores[~touched], score[kept].astype(object)])


def _sides(blocks: list[tuple[int, bytes, bytes]]) -> dict[int, tuple[int, _Side]]:
    """By length: the number of the first query of that length in the group, and the queries."""
    out, first = {}, 0
    for dim in sorted({dim for dim, _, _ in blocks}):
        ids = np.concatenate([np.frombuffer(i, "<i8") for d, i, _ in blocks if d == dim])
        data = np.concatenate([np.frombuffer(x, "<f8") for d, _, x in blocks if d == dim]).reshape(len(ids), dim)
        out[dim] = first, _Side(ids, data)
        first += len(ids)
    return out


def _searched(rows: DataFrame, shared: Broadcast, k: int) -> DataFrame:
    """The k best rows of each task for each query of a group."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, tuple[int, _Best]] = {}
        for dim, (first, queries) in _sides(shared.value).items():
            seeded = _Best(queries, k)
            seeded.see(queries.part(slice(0, SEEDS)))
            own = _Best(queries, k)
            own.least = seeded.least
            best[dim] = first, own
        for batch in batches:
            for ids, matrix in _matrices(batch):
                if matrix.shape[1] in best:
                    best[matrix.shape[1]][1].see(_Side(ids, matrix))
        for first, own in best.values():
            for at in range(0, len(own.at), 10_000):
                part = slice(at, at + 10_000)
                scores = [int(s) for s in own.scores[part]]
                if any(abs(s) >= 1 << 63 for s in scores):
                    raise OverflowError("an inner product among the answers passes 64 bits")
                yield pa.RecordBatch.from_pydict({
                    "query_number": pa.array(own.at[part] + first),
                    "query_id": pa.array(own.queries.ids[own.at[part]].astype(np.int64)),
                    "vec_id": pa.array(own.ids[part]), "score": pa.array(scores, pa.int64())})

    return rows.mapInArrow(search, ANSWER)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding",
          scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows with the highest products for each query row.

    Queries are the rows for which ``is_query`` holds, candidates all rows of another id; all, if there
    are fewer than k. Components become ``floor(scale * x)``, products are whole numbers, and equal ones
    go to the smaller id. Rows without an id and vectors that are null or hold a null or a component
    that is not finite, scaled, take no part; vectors of another length are no candidates; vectors without
    components have the product 0. Repeated rows count as often as they stand there, as queries too. A
    product among the answers that passes 64 bits is an error. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    ship(spark)
    plain = vectors.select(F.col(key).cast("long").alias("id"), scaled(vector, scale).alias("v"), is_query.alias("_query"))
    rows = plain.where("id IS NOT NULL AND v IS NOT NULL").select("id", "v", "_query")
    packed = written(rows.where("_query").select("id", "v").mapInArrow(_pack, PACKED), "queries")
    total = packed.agg(F.coalesce(F.sum(F.length("data") + F.length("ids")), F.lit(0)).alias("n")).first().n
    groups, folder, paths = max(1, -(-total // GROUP_BYTES)), new_folder(spark, "answers"), []
    # At most k rows from each task for a query.
    order = Window.partitionBy("query_number").orderBy(F.desc("score"), "vec_id")
    for number in range(groups):
        mine = packed.where(F.pmod(F.xxhash64("block"), F.lit(groups)) == number)
        shared = spark.sparkContext.broadcast(
            [(r.dim, bytes(r.ids), bytes(r.data)) for r in mine.sort("dim", "block", "ids").collect()])
        answers = _searched(rows.select("id", "v"), shared, k)
        paths.append(f"{folder}/{number}")
        (answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
         .select("query_id", "rank", "vec_id", "score").write.parquet(paths[-1]))
        shared.destroy()
    return spark.read.schema("query_id long, rank int, vec_id long, score long").parquet(*paths)
