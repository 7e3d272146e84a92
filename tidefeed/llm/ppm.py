"""Language-model scores: prediction by partial matching over bytes, and a word model to compare.

Training counts every byte after its three bytes before, over all training texts: a trie of depth
four. A byte's probability is taken in the longest context of the trie in which it was seen; each
shorter step costs an escape (method C), and bytes that the longer contexts already ruled out are
excluded from the shorter ones. All of this depends on the context and the byte alone, so it is
worked out once per context, and scoring a text is a few look-ups per byte in numpy.

The byte 0xFF, which no UTF-8 text holds, stands before and after every text.

Sizes: contexts of two bytes are at most 65,536; of three bytes the ``CONTEXTS`` most frequent have
nodes in the broadcast model, and symbols after any other trained context go through a shuffle join
with that context's own probabilities. So what is broadcast is bounded, whatever the corpus, and the
scores are those of the whole trie. Words go the same two ways: the ``FREQUENT`` most frequent from a
broadcast table and all others by a shuffle join, so every word is scored by its count.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import blocks, ship, utf8
from tidefeed.session import written

EDGE = 0xFF
CONTEXTS = 1 << 16
FREQUENT = 150_000
#: The columns of a score.
RESULT = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
#: Distinct words and grams that a counting task holds before it hands them on.
HELD_WORDS, HELD_GRAMS = 200_000, 1 << 20


def _stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts with three edges before and one after each; the row of each symbol, -1 before."""
    data, lengths = utf8(texts)
    total = len(data) + 4 * len(lengths)
    symbols = np.full(total, EDGE, np.uint8)
    ends = np.cumsum(lengths + 4)
    inside = np.ones(total, bool)
    inside[ends - 1] = False
    for k in range(3):
        inside[ends - lengths - 4 + k] = False
    symbols[inside] = data
    row = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 4)
    inside[ends - 1] = True
    row[~inside] = -1
    return symbols, row


def _words(texts: pa.Array) -> list[list[bytes]]:
    """Lower-case words; ASCII white space separates, as ``bytes.split`` knows it."""
    return [(text or b"").lower().split() for text in texts.cast(pa.binary()).to_pylist()]


def count(docs: DataFrame, training: Column, text: str = "text") -> DataFrame:
    """Stored counts: rows of (word, n, trained) and rows of (gram, trained).

    ``n`` counts a word in all texts, ``trained`` in the training ones. The empty word counts the
    ends of texts. A gram is four symbols as one integer, the first one highest.
    """
    ship(docs.sparkSession)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every: Counter = Counter()
        trained: Counter = Counter()
        grams, times = np.zeros(0, np.uint32), np.zeros(0, np.int64)

        def words() -> Iterator[pa.RecordBatch]:
            names = list(every)
            yield pa.RecordBatch.from_pydict({
                "word": pa.array(names, pa.binary()), "gram": pa.nulls(len(names), pa.int64()),
                "n": pa.array([every[w] for w in names], pa.int64()),
                "trained": pa.array([trained[w] for w in names], pa.int64())})

        def codes() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({
                "word": pa.nulls(len(grams), pa.binary()), "gram": pa.array(grams.astype(np.int64)),
                "n": pa.array(times), "trained": pa.array(times)})

        for batch in batches:
            for at, texts in blocks(batch.column(0)):
                learn = np.array(batch.column(1).slice(at, len(texts)).to_pylist(), bool)
                for own, used in zip(_words(texts), learn.tolist(), strict=True):
                    own.append(b"")
                    every.update(own)
                    if used:
                        trained.update(own)
                if len(every) > HELD_WORDS:
                    yield from words()
                    every.clear()
                    trained.clear()
                symbols, row = _stream(texts)
                wide = symbols.astype(np.uint32)
                made = (wide[:-3] << np.uint32(24)) | (wide[1:-2] << np.uint32(16)) | (wide[2:-1] << np.uint32(8)) | wide[3:]
                made, got = np.unique(made[(row[3:] >= 0) & learn[row[3:]]], return_counts=True)
                both, place = np.unique(np.concatenate([grams, made]), return_inverse=True)
                times = np.bincount(place, np.concatenate([times, got]), len(both)).astype(np.int64)
                grams = both
                if len(grams) > HELD_GRAMS:
                    yield codes()
                    grams, times = grams[:0], times[:0]
        yield from words()
        yield codes()

    rows = docs.select(F.col(text).alias("_text"), F.coalesce(training, F.lit(False)).alias("_training"))
    counted = rows.mapInArrow(tally, "word binary, gram long, n long, trained long")
    return written(counted.groupBy("word", "gram").agg(F.sum("n").alias("n"), F.sum("trained").alias("trained")), "counts")


def most_frequent(rows: DataFrame, n: str, most: int) -> DataFrame:
    """Rows with the largest ``n``: all those down to the level (an eighth of a doubling) that fits."""
    level = F.floor(F.log2(F.col(n)) * 8).alias("level")
    levels = rows.groupBy(level).agg(F.count("*").alias("rows")).collect()
    least, total = None, 0
    for one in sorted(levels, key=lambda r: -r.level):
        total += one.rows
        if total > most:
            break
        least = one.level
    return rows.where(F.floor(F.log2(F.col(n)) * 8) >= least) if least is not None else rows.where(F.lit(False))


def _probabilities(levels: list[np.ndarray]) -> np.ndarray:
    """Of each symbol for each row; ``levels``: counts in the contexts from the longest to none.

    The last column is each byte that training never saw.
    """
    rows, width = levels[0].shape
    out = np.zeros((rows, width + 1))
    gone = np.zeros((rows, width), bool)
    escape = np.ones(rows)
    for counts in levels:
        left = np.where(gone, 0, counts)
        total, kinds = left.sum(1), (left > 0).sum(1)
        whole = np.maximum(total + kinds, 1)
        out[:, :width] += (escape / whole)[:, None] * left
        escape *= np.where(kinds > 0, kinds / whole, 1)
        gone |= left > 0
    each = escape / np.maximum(256 - gone.sum(1), 1)
    out[:, :width] += np.where(gone, 0, each[:, None])
    out[:, width] = each
    return out


@dataclass
class Shorter:
    """Counts in the contexts of two symbols (rows as in ``two``), of one and of none."""

    two: np.ndarray
    counts2: np.ndarray
    counts1: np.ndarray
    counts0: np.ndarray

    def logs(self, first: np.ndarray, suffix2: np.ndarray | None, suffix1: np.ndarray | None) -> Iterator[np.ndarray]:
        """Log10 probabilities after contexts with the counts ``first`` and these shorter ones."""
        for at in range(0, len(first), 4096):
            part = slice(at, min(at + 4096, len(first)))
            levels = [first[part]]
            if suffix2 is not None:
                levels.append(self.counts2[suffix2[part]])
            if suffix1 is not None:
                levels.append(self.counts1[suffix1[part]])
            levels.append(np.repeat(self.counts0, len(levels[0]), 0))
            yield np.log10(_probabilities(levels)).astype(np.float32)


@dataclass
class ByteModel:
    """Log10 probabilities: ``logs[node[context], symbol]`` over the classes of seen bytes.

    ``shorter`` is there if trained contexts were left out; the nodes that stand for them are those
    of two symbols, ``nodes2``.
    """

    classes: np.ndarray
    node: np.ndarray
    logs: np.ndarray
    nodes2: range = range(0)
    shorter: Shorter | None = None

    def score(self, texts: pa.Array) -> np.ndarray:
        """Log10 probability of each text with its end, by the nodes here."""
        return self.scored(texts)[0]

    def scored(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """``score``; each text's symbols after contexts that may have been left out, and how often.

        Such a symbol is one integer: ``context << 9 | symbol``, in classes.
        """
        symbols, row = _stream(texts)
        seen = self.classes[symbols].astype(np.int64)
        base = self.logs.shape[1]
        real = row[3:] >= 0
        context = ((seen[:-3] * base + seen[1:-2]) * base + seen[2:-1])[real]
        at, own, symbol = self.node[context], row[3:][real], seen[3:][real]
        total = np.bincount(own, self.logs[at, symbol], len(texts))
        if self.shorter is None:
            return total, pa.nulls(len(texts), pa.list_(pa.int64())), pa.nulls(len(texts), pa.list_(pa.int32()))
        open_ = (at >= self.nodes2.start) & (at < self.nodes2.stop) & (context // base**2 < base - 1)
        coded = own[open_].astype(np.int64) << 34 | context[open_] << 9 | symbol[open_]
        codes, times = np.unique(coded, return_counts=True)
        ends = pa.array(np.searchsorted(codes, np.arange(len(texts) + 1) << 34), pa.int32())
        return (total, pa.ListArray.from_arrays(ends, pa.array(codes & (1 << 34) - 1)),
                pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())))

    def gains(self, grams: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Contexts (in classes) of left-out grams, and what each symbol's log gains over ``score``."""
        base, width = self.logs.shape[1], self.logs.shape[1] - 1
        codes, place = np.unique(grams >> 8, return_inverse=True)
        counts3 = np.zeros((len(codes), width), np.float32)
        counts3[place, self.classes[grams & 255]] = times
        p, q, r = (self.classes[codes >> shift & 255].astype(np.int64) for shift in (16, 8, 0))
        suffix2 = np.searchsorted(self.shorter.two, q * width + r)
        exact = np.concatenate(list(self.shorter.logs(counts3, suffix2, r)))
        context = (p * base + q) * base + r
        return context, exact.astype(np.float64) - self.logs[self.node[context]]


def _contexts(counts: DataFrame, contexts: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Trained grams with their context; all contexts with their counts, and those with nodes."""
    whole = counts.where("gram is not null and trained > 0").select(
        "gram", "trained", F.shiftright("gram", 8).alias("context"))
    every = whole.groupBy("context").agg(F.sum("trained").alias("n"))
    return whole, every, most_frequent(every, "n", contexts)


def build(counts: DataFrame, contexts: int = CONTEXTS) -> ByteModel:
    """The model from the grams of ``count``."""
    whole, every, kept = _contexts(counts, contexts)
    grams = whole.select("gram", "trained")
    long = whole.join(F.broadcast(kept.select("context")), "context").select("gram", "trained").toArrow()
    short = grams.groupBy(F.col("gram").bitwiseAND(0xFFFFFF).alias("gram")).agg(F.sum("trained").alias("n")).toArrow()
    g4, n4 = long.column(0).to_numpy(), long.column(1).to_numpy()
    g3, n3 = short.column(0).to_numpy(), short.column(1).to_numpy()
    symbols = np.unique(np.concatenate([g3 & 255, g3 >> 8 & 255, g3 >> 16])).astype(np.int64)
    width = len(symbols)
    classes = np.full(256, width, np.int32)
    classes[symbols] = np.arange(width)
    a, b, c = (classes[g3 >> shift & 255] for shift in (16, 8, 0))
    two = np.unique(a * width + b)
    counts2 = np.zeros((len(two), width), np.float32)
    counts2[np.searchsorted(two, a * width + b), c] = n3
    counts1 = np.zeros((width, width))
    np.add.at(counts1, (b, c), n3)
    counts0 = counts1.sum(0, keepdims=True)
    base = width + 1
    long_codes, place = np.unique(g4 >> 8, return_inverse=True)
    counts3 = np.zeros((len(long_codes), width), np.float32)
    counts3[place, classes[g4 & 255]] = n4
    p, q, r = (classes[long_codes >> shift & 255].astype(np.int64) for shift in (16, 8, 0))

    if not width:
        return ByteModel(classes, np.zeros(1, np.int32), np.full((1, 1), math.log10(1 / 256), np.float32))
    suffix2 = np.searchsorted(two, q * width + r) if len(p) else np.zeros(0, np.int64)
    parts = [np.log10(_probabilities([counts0])).astype(np.float32)]
    shorter = Shorter(two, counts2, counts1, counts0)
    parts += shorter.logs(counts1, None, None)
    parts += shorter.logs(counts2, None, two % width)
    parts += shorter.logs(counts3, suffix2, r)
    # Where each context of three symbols is met: by all of it, its last two, its last one or none.
    node = np.zeros((base, base, base), np.int32)
    used = np.flatnonzero(counts1.sum(1) > 0)
    node[:, :, used] = 1 + used
    node[:, two // width, two % width] = 1 + width + np.arange(len(two))
    node[p, q, r] = 1 + width + len(two) + np.arange(len(p))
    nodes2 = range(1 + width, 1 + width + len(two))
    cut = every.count() > len(long_codes)
    return ByteModel(classes, node.reshape(-1), np.concatenate(parts), nodes2, shorter if cut else None)


def _left_out(counts: DataFrame, contexts: int, shared: Broadcast) -> DataFrame:
    """(context, gains) of each trained context without a node; ``shared`` starts with the model."""
    whole, _, kept = _contexts(counts, contexts)
    grouped = (whole.join(F.broadcast(kept.select("context")), "context", "left_anti")
               .groupBy("context").agg(F.collect_list(F.struct("gram", "trained")).alias("_grams")).select("_grams"))

    def gains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value[0]
        for batch in batches:
            for at in range(0, len(batch), 1024):
                grams = batch.column(0).slice(at, 1024).flatten()
                context, more = model.gains(grams.field(0).to_numpy(), grams.field(1).to_numpy())
                ends = pa.array(np.arange(len(context) + 1) * more.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(context), pa.ListArray.from_arrays(ends, pa.array(more.reshape(-1)))], names=["context", "gains"])

    return grouped.mapInArrow(gains, "context long, gains array<double>")


def score(docs: DataFrame, counts: DataFrame, text: str = "text", columns: tuple[str, ...] = (),
          frequent: int = FREQUENT, contexts: int = CONTEXTS) -> DataFrame:
    """Score every whole text (null: empty): n_tokens, n_known, train_tokens, base_score, score.

    ``score`` is the byte model's log10 probability of the text and its end; ``base_score`` that of
    the word model with one added to every count. ``columns`` of ``docs`` are kept, but for those whose
    names the result has already. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    given = [c for c in columns if c.lower() not in RESULT]
    docs = docs.select(*[F.col(c).alias(f"_kept{i}") for i, c in enumerate(given)], F.col(text).alias("_text"))
    text, columns = "_text", tuple(f"_kept{i}" for i in range(len(given)))
    ship(spark)
    words = counts.where("word is not null").select("word", "n", "trained")
    totals = words.agg(F.sum("trained").alias("tokens"), F.sum((F.col("trained") > 0).cast("long")).alias("kinds")).first()
    tokens, kinds = totals["tokens"] or 0, totals["kinds"] or 0
    common = most_frequent(words, "n", frequent)
    top = common.select("word", "trained").toArrow()
    shared = spark.sparkContext.broadcast(
        (build(counts, contexts), top.column(0).to_pylist(), top.column(1).to_numpy()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, names, trained = shared.value
        known = {name: i for i, name in enumerate(names)}
        logs, hit = np.append(np.log10(trained + 1.0), 0.0), np.append(trained > 0, False)
        rid = TaskContext.get().partitionId() << 40
        for batch in batches:
            kept = [batch.column(i) for i in range(len(columns))]
            for at, texts in blocks(batch.column(len(columns)), 2 << 20):
                lists = _words(texts)
                for own in lists:
                    own.append(b"")
                every = [word for own in lists for word in own]
                sizes = np.array([len(own) for own in lists])
                where = np.array([known.get(word, -1) for word in every], np.int64)
                owner = np.repeat(np.arange(len(lists)), sizes)
                others: list[Counter] = [Counter() for _ in lists]
                rare = np.flatnonzero(where < 0)
                for i, row in zip(rare.tolist(), owner[rare].tolist(), strict=True):
                    others[row][every[i]] += 1
                total, symbols, seen = model.scored(texts)
                yield pa.RecordBatch.from_arrays([
                    *[column.slice(at, len(texts)) for column in kept],
                    pa.array(np.arange(rid, rid + len(lists))), pa.array(sizes.astype(np.int64)),
                    pa.array(np.bincount(owner, hit[where], len(lists)).astype(np.int64)),
                    pa.array(np.bincount(owner, logs[where], len(lists))), pa.array(total),
                    pa.array([list(c) for c in others], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in others], pa.list_(pa.int32())), symbols, seen,
                ], names=[*columns, "_rid", "n_tokens", "_known", "_logs", "score", "_rare", "_times", "_symbols", "_seen"])
                rid += len(lists)

    kinds_of = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*columns).schema) if columns else ""
    measured = written(docs.select(*columns, F.col(text).alias("_text")).mapInArrow(
        measure, kinds_of + "_rid long, n_tokens long, _known long, _logs double, score double, "
        "_rare array<binary>, _times array<int>, _symbols array<long>, _seen array<int>"), "scores")
    rare = (
        measured.select("_rid", F.explode(F.arrays_zip("_rare", "_times")).alias("_w"))
        .select("_rid", F.col("_w._rare").alias("word"), F.col("_w._times").alias("_times"))
        .join(words.where("trained > 0").select("word", "trained"), "word")
        .select("_rid", F.col("_times").cast("long").alias("_more_known"),
                (F.col("_times") * F.log10(F.col("trained") + 1)).alias("_more_logs"), F.lit(0.0).alias("_gain"))
    )
    if shared.value[0].shorter is not None:
        gain = F.element_at("gains", (F.col("_w._symbols").bitwiseAND(511) + 1).cast("int"))
        rare = rare.unionByName(
            measured.select("_rid", F.explode(F.arrays_zip("_symbols", "_seen")).alias("_w"))
            .withColumn("context", F.shiftright("_w._symbols", 9))
            .join(_left_out(counts, contexts, shared), "context")
            .select("_rid", F.lit(0).cast("long").alias("_more_known"), F.lit(0.0).alias("_more_logs"),
                    (F.col("_w._seen") * gain).alias("_gain")))
    rare = rare.groupBy("_rid").agg(*[F.sum(c).alias(c) for c in ("_more_known", "_more_logs", "_gain")])
    scale = math.log10(tokens + kinds + 1)
    known = F.col("_known") + F.coalesce("_more_known", F.lit(0))
    return measured.drop("_rare", "_times", "_symbols", "_seen").join(rare, "_rid", "left").select(
        *[F.col(name).alias(c) for name, c in zip(columns, given, strict=True)], "n_tokens", known.cast("long").alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("_logs") + F.coalesce("_more_logs", F.lit(0.0)) - F.col("n_tokens") * F.lit(scale)).alias("base_score"),
        (F.col("score") + F.coalesce("_gain", F.lit(0.0))).alias("score"))
