"""Near-duplicate documents by MinHash with tensored banding.

A document's set holds the hashes of its distinct word shingles. ``COLLECTIONS`` small collections of
``DEPTH`` minhashes each are drawn; every pair of collections forms the key of one table. So 48
minhashes serve 120 tables of 6 minhashes: two sets of similarity 0.8 share a table with
probability 0.9998, and unrelated ones hardly ever.

Equal sets are one class from the start, and only classes are hashed into tables. In a table's
bucket each class is compared with one hub, not with every other class; classes whose bucket then
still falls into several components go on to a second hub, and what is left is searched exactly, by
the rarest shingles that two similar sets must share. Every link is confirmed on the full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.llm.components import components
from tidefeed.llm.text import blocks, checked_broadcast, hand_back, ship
from tidefeed.session import written

COLLECTIONS = 16
DEPTH = 3
#: Two sets are linked if 100 * shared >= PERCENT * all.
PERCENT = 80
REMEMBERED = 500_000
_RANDOM = np.random.default_rng(20240229)
_TIMES = _RANDOM.integers(1, 1 << 63, COLLECTIONS * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, COLLECTIONS * DEPTH, dtype=np.uint64)
_PLACES = _RANDOM.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _Words(dict):
    """Hash of a word; forgets all when it has grown too large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _Words()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct hashes of ``size``-word shingles; of all words as one if there are fewer."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - size + 1)
    total = np.full(n, min(size, len(words)), np.uint64)
    for k in range(min(size, len(words))):
        total = _mix(total * _PLACES[k % 16] + hashes[k : k + n])
    return np.unique(total)


def _sketch(own: np.ndarray) -> np.ndarray:
    """One value for each collection of minhashes."""
    least = np.array([((own ^ plus) * times).min() for plus, times in zip(_PLUS, _TIMES, strict=True)])
    parts = least.reshape(COLLECTIONS, DEPTH)
    out = np.zeros(COLLECTIONS, np.uint64)
    for k in range(DEPTH):
        out = _mix(out * _PLACES[k] + parts[:, k])
    return out


def sketches(docs: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """Stored rows (doc_id, n, d1, d2, halves): the set's size, its 128-bit digest, its collections."""
    ship(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in blocks(batch.column(1), 1 << 20):
                sizes, first, second, halves = [], [], [], []
                for one in texts.cast(pa.binary()).to_pylist():
                    own = shingles(one or b"", size)
                    sizes.append(len(own))
                    first.append(_mix(own).sum(dtype=np.uint64))
                    second.append(_mix(own ^ _PLUS[0]).sum(dtype=np.uint64))
                    halves.append(_sketch(own).view(np.int64) if len(own) else None)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0).slice(at, len(texts)), "n": pa.array(sizes, pa.int64()),
                    "d1": pa.array(np.array(first, np.uint64).view(np.int64)),
                    "d2": pa.array(np.array(second, np.uint64).view(np.int64)),
                    "halves": pa.array(halves, pa.list_(pa.int64())),
                })
        _WORDS.clear()
        hand_back()

    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("_text"))
    return written(rows.mapInArrow(work, "doc_id long, n long, d1 long, d2 long, halves array<long>"), "sketches")


def _texts(docs: DataFrame, ids: DataFrame, key: str, text: str) -> DataFrame:
    """Texts of the documents whose ids are rows of the stored table ``ids``, with its columns."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.join(checked_broadcast(ids), "id")


def confirm(docs: DataFrame, pairs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Stored (a, b) of those ``pairs`` whose full sets are similar enough."""
    ship(docs.sparkSession)
    pairs = written(pairs, "pairs")
    hubs = written(pairs.select(F.col("a").alias("id")).distinct(), "hubs")
    left = _texts(docs, hubs, key, text).select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = _texts(docs, pairs.select(F.col("b").alias("id"), "a"), key, text).select(
        "a", F.col("id").alias("b"), F.col("text").alias("text_b"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, hub_set = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts_a, texts_b = (batch.column(c).cast(pa.binary()) for c in ("text_a", "text_b"))
            good = []
            for i in range(len(batch)):
                one = texts_a[i].as_py() or b""
                if one != hub:
                    hub, hub_set = one, shingles(one, size)
                other = shingles(texts_b[i].as_py() or b"", size)
                shared = len(np.intersect1d(hub_set, other, assume_unique=True))
                if shared and 100 * shared >= percent * (len(hub_set) + len(other) - shared):
                    good.append(i)
            yield pa.RecordBatch.from_pydict({
                "a": pa.array([a[i] for i in good], pa.int64()), "b": pa.array([b[i] for i in good], pa.int64())})
        _WORDS.clear()
        hand_back()

    return written(right.join(left, "a").mapInArrow(compare, "a long, b long").distinct(), "links")


def _parts(links: DataFrame) -> DataFrame:
    """Stored (cid, part): the component of every class that has a link."""
    return written(components(links).select(F.col("id").alias("cid"), F.col("component").alias("part")), "parts")


def _unsettled(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Stored members of buckets that fall into several components, with the component."""
    placed = members.join(checked_broadcast(parts), "cid", "left").withColumn("part", F.coalesce("part", "cid"))
    open_ = written(
        placed.groupBy("table").agg(F.min("part").alias("least"), F.max("part").alias("most"))
        .where("least < most").select("table"), "open")
    return written(placed.join(checked_broadcast(open_), "table"), "unsettled")


def _rest(docs: DataFrame, unsettled: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Pairs of different components that may be similar: those that share one of the rarest shingles.

    Of two sets with the wanted similarity, the rarest (100 - percent) % + 1 shingles of each have
    one in common. One side of a pair is outside its bucket's largest component.
    """
    share = unsettled.groupBy("table", "part").agg(F.count("*").alias("n"))
    largest = share.groupBy("table").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    minor = (
        unsettled.join(written(largest, "largest"), "table").where("part <> largest")
        .select(F.col("cid").alias("id")).distinct().withColumn("minor", F.lit(True))
    )
    every = unsettled.select(F.col("cid").alias("id"), "part").distinct().join(minor, "id", "left")
    every = written(every.withColumn("minor", F.coalesce("minor", F.lit(False))), "rest")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, one in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                own = shingles(one or b"", size).view(np.int64)
                count = len(own)
                yield pa.RecordBatch.from_pydict({
                    "id": pa.array([batch.column("id")[i].as_py()] * count, pa.int64()),
                    "part": pa.array([batch.column("part")[i].as_py()] * count, pa.int64()),
                    "minor": pa.array([batch.column("minor")[i].as_py()] * count, pa.bool_()),
                    "n": pa.array(np.full(count, count)), "shingle": pa.array(own)})
        _WORDS.clear()
        hand_back()

    exploded = written(
        _texts(docs, every, key, text).select("id", "part", "minor", "text")
        .mapInArrow(sets, "id long, part long, minor boolean, n long, shingle long"), "shingles")
    often = written(exploded.groupBy("shingle").agg(F.count("*").alias("often")), "often")
    # One document's shingles.
    order = Window.partitionBy("id").orderBy("often", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = written(
        exploded.join(often, "shingle").withColumn("_at", F.row_number().over(order)).where(F.col("_at") <= first)
        .select("id", "part", "minor", "n", "shingle", (F.col("n") - F.col("_at") + 1).alias("left")), "rare")
    x, y = rare.where("minor").alias("x"), rare.alias("y")
    near = (F.col("x.n") * 100 >= F.col("y.n") * percent) & (F.col("y.n") * 100 >= F.col("x.n") * percent)
    # At the first shingle that two sets share, what is left of both must be enough.
    enough = F.least("x.left", "y.left") * (100 + percent) >= (F.col("x.n") + F.col("y.n")) * percent
    return (
        x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.part") != F.col("y.part")) & near & enough)
        .select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    )


def near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
                percent: int = PERCENT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest id that links lead to, the document's own included; ``kept``
    marks the document that has it. Null, empty and wordless texts have an empty set and no links.
    Rows with one id count as one document in links: each has its own set, and a link of one is a
    link of the id. A null id takes part in nothing: component_id is null and kept is true. Columns
    beside the two are not read.
    """
    drawn = sketches(docs, key, text, size)
    classes = written(
        drawn.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2")
        .agg(F.min("doc_id").alias("cid"), F.first("halves").alias("halves")), "classes")
    last = COLLECTIONS - 1
    tables = F.expr(
        f"explode(flatten(transform(sequence(0, {last - 1}), i -> transform(sequence(i + 1, {last}), "
        "j -> xxhash64(i, j, halves[i], halves[j])))))").alias("table")
    keys = classes.select("cid", tables)
    buckets = written(
        keys.groupBy("table").agg(F.min("cid").alias("low"), F.max("cid").alias("high"), F.count("*").alias("n"))
        .where("low < high"), "buckets")
    large = buckets.where("n > 2").select("table", "low", "high")
    members = written(keys.join(checked_broadcast(large), "table"), "members")
    two = buckets.where("n = 2").select(F.col("low").alias("a"), F.col("high").alias("b"))
    star = members.where("cid > low").select(F.col("low").alias("a"), F.col("cid").alias("b"))
    links = confirm(docs, two.unionByName(star).distinct(), key, text, size, percent)
    parts = _parts(links)
    unsettled = _unsettled(members, parts)
    if not unsettled.isEmpty():
        # A second hub for what the first did not join.
        second = unsettled.where("cid < high").select(F.col("high").alias("a"), F.col("cid").alias("b")).distinct()
        links = links.unionByName(confirm(docs, second, key, text, size, percent))
        parts = _parts(links)
        unsettled = _unsettled(unsettled.drop("part"), parts)
        if not unsettled.isEmpty():
            rest = _rest(docs, unsettled, key, text, size, percent)
            parts = _parts(links.unionByName(confirm(docs, rest, key, text, size, percent)))
    named = written(
        classes.select("n", "d1", "d2", "cid").join(checked_broadcast(parts), "cid", "left")
        .select("n", "d1", "d2", F.coalesce("part", "cid").alias("_least")), "named")
    placed = drawn.select("doc_id", "n", "d1", "d2").join(checked_broadcast(named), ["n", "d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_least", "doc_id"))
    return placed.select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
                percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each group of near copies; all columns as they are.

    The document with the smallest id stays; of several rows with that id, one stays. Rows with a
    null id stay.
    """
    found = near_copies(docs, key, text, size, percent).where("kept and doc_id is not null")
    kept = written(found.groupBy("doc_id").agg(F.count("*").alias("_rows")).withColumnRenamed("doc_id", "_kept"), "kept")
    rows = docs.select(F.struct("*").alias("_row"), F.col(key).cast("long").alias("_kept"))
    joined = rows.join(checked_broadcast(kept), "_kept")
    once = joined.where("_rows = 1").select("_row.*")
    twice = joined.where("_rows > 1").dropDuplicates(["_kept"]).select("_row.*")
    return once.unionByName(twice).unionByName(docs.where(F.col(key).isNull()))
