"""Phrases whose words stand together more often than apart, from a weighted de Bruijn graph.

Texts are cut into pieces, and every word of a piece begins one longest gram: three words, or what the
piece has left. Three-word grams are the edges of a graph per language, each from the node of its first
two words to that of its last two; a gram that its piece ends is an edge to the end. Only these edges
are counted. A node's count is what flows out of it, edges to the end included, and a word's count is
the same one level down. So shorter phrases are never counted in the texts.

Edges that lead in and out of a node with all its count form a path that nothing leaves or joins. Such
paths are compacted into one row, whatever their length; their inner nodes have the path's count.

Edges travel as numbers. The words that are most frequent have short ones, and an edge of three such
words is one integer; any other word is a hash of 63 bits, checked to differ for all words. Edges are
dealt by their first node; nodes of two very frequent words are dealt by the third word too, as no
other node can hold a large share of all edges.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidefeed.llm.text import blocks, ship
from tidefeed.session import written

UNKNOWN = "und"
#: Most words with short numbers, which every task holds; 0 is the end of a piece.
BITS = 18
SHORT_WORDS = (1 << BITS) - 1
#: Words, the most frequent of all languages, of whose pairs the nodes are dealt in ``SPREAD`` parts.
FREQUENT, SPREAD = 1024, 32
#: Text bytes whose equal grams are counted together in a task.
BLOCK = 4 << 20
#: Words that a task counts before it passes the counts on.
HELD_WORDS = 200_000
#: Rows of an Arrow batch made here.
BATCH = 100_000
#: Paths double in each step; no text has a piece of more words than this.
STEPS = 40

END = b"\xff"
#: Bytes to what they are here: A-Z in lower case, a tab as space, what ends a piece as ``END``.
_FOLDED = bytes(
    0xFF if b in b".,;:!?\n\x0b\x0c\r" else 0x20 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


class _Numbers(dict):
    """Words to numbers in the order of their first use; the end of a piece is 0."""

    def __init__(self):
        super().__init__({END: 0})

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def pieces(texts: list[str | None]) -> list[bytes]:
    """The words of all texts in a row, with ``END`` between pieces."""
    joined = b"\n".join([(t or "").encode() for t in texts])
    return joined.translate(_FOLDED).replace(END, b" \xff ").split()


def hashed(lang: bytes, word: bytes, seed: int) -> int:
    """A negative number for a word of a language."""
    return -(xxhash.xxh64_intdigest(word, xxhash.xxh64_intdigest(lang, seed)) >> 1) - 1


def _by_language(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[str | None]]]:
    """(language, texts) of bounded size."""
    for batch in batches:
        for at, texts in blocks(batch.column(1), BLOCK):
            own: dict[str, list[str | None]] = {}
            for lang, text in zip(batch.column(0).slice(at, len(texts)).to_pylist(), texts.to_pylist(), strict=True):
                own.setdefault(lang, []).append(text)
            yield from own.items()


def count_words(texts: DataFrame, seed: int = 0) -> DataFrame:
    """Stored (lang, word, id, n) of ``texts`` (lang, text), where ``id`` is the word's hash."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[bytes, int]] = {}

        def passed_on() -> Iterator[pa.RecordBatch]:
            for lang, counts in held.items():
                name, words = lang.encode(), list(counts)
                for first in range(0, len(words), BATCH):
                    part = words[first : first + BATCH]
                    yield pa.RecordBatch.from_pydict({
                        "lang": pa.array([lang] * len(part), pa.string()),
                        "word": pa.array([w.decode() for w in part], pa.string()),
                        "id": pa.array([hashed(name, w, seed) for w in part], pa.int64()),
                        "n": pa.array([counts[w] for w in part], pa.int64())})
            held.clear()

        for lang, own in _by_language(batches):
            numbers = _Numbers()
            words = pieces(own)
            ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            counts = held.setdefault(lang, {})
            times = np.bincount(ids, minlength=len(numbers)).tolist()
            for word, n in zip(numbers, times, strict=True):
                if word != END:
                    counts[word] = counts.get(word, 0) + n
            if sum(map(len, held.values())) > HELD_WORDS:
                yield from passed_on()
        yield from passed_on()

    counted = texts.mapInArrow(count, "lang string, word string, id long, n long")
    return written(counted.groupBy("lang", "word", "id").agg(F.sum("n").alias("n")), "words")


def _short(words: DataFrame) -> pa.Table:
    """(lang, word) of at most ``SHORT_WORDS`` words, most frequent first.

    Words go by the power of two of their count; a power is taken whole or not at all.
    """
    power = F.floor(F.log2("n")).cast("int")
    room, least = SHORT_WORDS, None
    for row in words.groupBy(power.alias("p")).count().sort(F.desc("p")).collect():
        room -= row["count"]
        if room < 0:
            break
        least = row.p
    taken = words.where(power >= least) if least is not None else words.limit(0)
    # Some megabytes as Arrow columns.
    ordered = taken.select("lang", "word", "n").toArrow().sort_by([("n", "descending"), ("lang", "ascending"), ("word", "ascending")])
    return ordered.select(["lang", "word"]).combine_chunks()


@dataclass
class Graph:
    """What ``build`` has counted; all tables are stored.

    ``words`` (id, lang, word, f), ``nodes`` (a, b, f) and ``edges`` (a, b, c, f) hold what stands
    ``least`` times or more; ``sizes`` (lang, n) has the words of each language.
    """

    words: DataFrame
    nodes: DataFrame
    edges: DataFrame
    sizes: DataFrame


GRAM = "key long, a long, b long, c long, n long"


def _grams(texts: DataFrame, short: pa.Table, seed: int) -> DataFrame:
    """Longest grams and their counts: ``key`` if all words have short numbers, else ``a``, ``b``, ``c``."""
    shared = texts.sparkSession.sparkContext.broadcast(short)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict[bytes, int]] = {}
        for part in shared.value.append_column("number", pa.array(np.arange(1, len(shared.value) + 1))).to_batches(BATCH):
            for lang, word, number in zip(*[column.to_pylist() for column in part.columns], strict=True):
                known.setdefault(lang, {})[word.encode()] = number
        for lang, own in _by_language(batches):
            numbers, name, mine = _Numbers(), lang.encode(), known.get(lang, {})
            words = pieces(own)
            x = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
            x = np.concatenate([x, [0, 0]])
            a, b = x[:-2], x[1:-1]
            c = np.where(b == 0, 0, x[2:])
            a, b, c = a[a > 0], b[a > 0], c[a > 0]
            if len(numbers) < 1 << 21:
                packed, n = np.unique(a << 42 | b << 21 | c, return_counts=True)
                a, b, c = packed >> 42, packed >> 21 & (1 << 21) - 1, packed & (1 << 21) - 1
            else:
                (a, b, c), n = np.unique(np.stack([a, b, c]), axis=1, return_counts=True)
            get = mine.get
            ids = np.fromiter((get(w) or hashed(name, w, seed) for w in numbers), np.int64, len(numbers))
            ids[0] = 0
            a, b, c = ids[a], ids[b], ids[c]
            narrow = (a >= 0) & (b >= 0) & (c >= 0)
            key = a << 2 * BITS | b << BITS | c
            for at in range(0, len(n), BATCH):
                part = slice(at, at + BATCH)
                wide = narrow[part]
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array(key[part], mask=~wide), "a": pa.array(a[part], mask=wide),
                    "b": pa.array(b[part], mask=wide), "c": pa.array(c[part], mask=wide), "n": pa.array(n[part])})

    return texts.mapInArrow(count, GRAM)


class _Level:
    """Sums over equal neighbouring keys that may go on in the next batch."""

    def __init__(self, width: int):
        self.width, self.keys, self.total = width, None, 0

    def add(self, columns: list[np.ndarray], n: np.ndarray, last: bool = False) -> tuple[list[np.ndarray], np.ndarray]:
        """The keys that have ended, and their sums."""
        own = columns[: self.width]
        if self.keys is not None:
            own = [np.concatenate([[k], c]) for k, c in zip(self.keys, own, strict=True)]
            n = np.concatenate([[self.total], n])
        if not len(n):
            return own, n
        begins = np.ones(len(n), bool)
        begins[1:] = np.any([c[1:] != c[:-1] for c in own], axis=0)
        at = np.flatnonzero(begins)
        sums, own = np.add.reduceat(n, at), [c[at] for c in own]
        if last:
            self.keys = None
            return own, sums
        self.keys, self.total = [c[-1] for c in own], sums[-1]
        return [c[:-1] for c in own], sums[:-1]


PART = "a long, b long, c long, n long"


def _flows(least: int):
    def flows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges, nodes (c null) and words (b and c null) of grams sorted by a, b and c.

        Edges and nodes below ``least`` are left out, but for nodes of which other tasks have a part.
        """
        levels = [_Level(3), _Level(2), _Level(1)]

        def out(columns: list[np.ndarray], n: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            for level in levels:
                own, sums = level.add(columns, n, last)
                if level.width == 3:
                    # An edge to the end is part of its node only.
                    good = (sums >= least) & (own[2] != 0)
                elif level.width == 2:
                    good = (own[1] != 0) & ((sums >= least) | _is_spread(own[0], own[1]))
                else:
                    good = np.ones(len(sums), bool)
                nothing = pa.nulls(int(good.sum()), pa.int64())
                arrays = [pa.array(c[good], pa.int64()) for c in own] + [nothing] * (3 - level.width)
                if len(nothing):
                    yield pa.RecordBatch.from_arrays([*arrays, pa.array(sums[good], pa.int64())], names=["a", "b", "c", "n"])

        empty = np.zeros(0, np.int64)
        for batch in batches:
            a, b, c, n = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            yield from out([a, b, c], n, False)
        yield from out([empty, empty, empty], empty, True)

    return flows


def _is_spread(a, b):
    return (a > 0) & (a <= FREQUENT) & (b > 0) & (b <= FREQUENT)


def build(docs: DataFrame, least: int = 10, text: str = "text", lang: str = "lang", seed: int = 0) -> Graph:
    """Count the grams of all texts (null: empty) of each language (null: ``und``)."""
    ship(docs.sparkSession)
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))
    words = count_words(texts, seed)
    while words.groupBy("id").count().where("count > 1").limit(1).count():
        seed += 1
        words = count_words(texts, seed)
    short = _short(words)
    grams = _grams(texts, short, seed)
    mask = (1 << BITS) - 1
    grams = grams.select(
        F.coalesce("a", F.shiftright("key", 2 * BITS)).alias("a"),
        F.coalesce("b", F.shiftright("key", BITS).bitwiseAND(mask)).alias("b"),
        F.coalesce("c", F.col("key").bitwiseAND(mask)).alias("c"), "n")
    part = F.when(_is_spread(F.col("a"), F.col("b")), F.pmod(F.xxhash64("c"), F.lit(SPREAD))).otherwise(0)
    parts = written(
        grams.repartition("a", "b", part).sortWithinPartitions("a", "b", "c").mapInArrow(_flows(least), PART), "flows")
    edges = parts.where("c IS NOT NULL").select("a", "b", "c", F.col("n").alias("f"))
    nodes = parts.where("c IS NULL AND b IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    flow = parts.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    spark = docs.sparkSession
    numbers = spark.createDataFrame(short.append_column("id", pa.array(np.arange(1, len(short) + 1, dtype=np.int64))))
    named = words.where(F.col("n") >= least).select("lang", "word", F.col("id").alias("hash")).join(numbers, ["lang", "word"], "left")
    named = named.select(F.coalesce("id", "hash").alias("id"), "lang", "word")
    return Graph(
        written(flow.join(named, "id").select("id", "lang", "word", "f"), "word-flows"),
        written(nodes, "node-flows"), edges, words.groupBy("lang").agg(F.sum("n").alias("n")))


def compact(graph: Graph) -> DataFrame:
    """Stored (words array<long>, n): every edge lies on one path; inner nodes have the count ``n``.

    An edge goes on into the next if each has the whole count of the node between. Paths have no
    cycles, as a text comes in and goes out. The steps to a path's first edge double in each round.
    """
    tails = graph.nodes.select("a", "b", F.col("f").alias("_tail"))
    heads = graph.nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("_head"))
    whole = graph.edges.join(tails, ["a", "b"]).join(heads, ["b", "c"])
    # Of the edges into a node, and of those out of it, at most one has its whole count.
    into = whole.where("f = _head").select("a", "b", "c", F.col("c").alias("d"))
    out = whole.where("f = _tail").select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("c").alias("d"))
    links = into.drop("d").join(out, ["b", "c"]).select(
        F.struct("a", "b", "c").alias("up"), F.struct(F.col("b").alias("a"), F.col("c").alias("b"), F.col("d").alias("c")).alias("at"))
    way = written(links.select("at", "up", F.lit(1).cast("long").alias("steps")), "links")
    for _ in range(STEPS):
        above = way.select(F.col("at").alias("up"), F.col("up").alias("_up"), F.col("steps").alias("_steps"))
        longer = written(way.join(above, "up", "left"), "ways")
        if not longer.where("_up IS NOT NULL").limit(1).count():
            break
        way = longer.select("at", F.coalesce("_up", "up").alias("up"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
    else:
        raise ValueError(f"a path of more than 2 ** {STEPS} edges")
    edges = graph.edges.select(F.struct("a", "b", "c").alias("at"), "f")
    placed = edges.join(way, "at", "left").select(
        F.coalesce("up", "at").alias("first"), F.coalesce("steps", F.lit(0)).alias("steps"), F.col("at.c").alias("c"), "f")
    # A path is no longer than the longest piece of a text.
    paths = placed.groupBy("first").agg(F.sort_array(F.collect_list(F.struct("steps", "c"))).alias("_on"), F.max("f").alias("n"))
    return written(paths.select(F.concat(F.array("first.a", "first.b"), F.col("_on.c")).alias("words"), "n"), "paths")


def _score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers of 38 digits."""
    whole = [c.cast("decimal(19,0)") for c in (a, left, right)]
    return F.call_function("div", whole[0] * whole[0] * F.lit(1_000_000).cast("decimal(7,0)"), whole[1] * whole[2])


def candidates(graph: Graph) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that stand ``least`` times and in no longer one half as often.

    l and r are the counts of the parts at the cut with the lowest score, the first of equal ones.
    """
    paths = compact(graph)
    # Inner nodes of a path have the count of an edge that holds them; ends of paths remain.
    ends = paths.select(F.explode(F.array(
        F.struct(F.col("words")[0].alias("a"), F.col("words")[1].alias("b"), "n"),
        F.struct(F.expr("words[size(words) - 2]").alias("a"), F.expr("words[size(words) - 1]").alias("b"), "n"))).alias("_e"))
    longest = ends.groupBy("_e.a", "_e.b").agg(F.max("_e.n").alias("_longer"))
    inner = paths.where("size(words) > 3").select(F.explode(F.expr(
        "transform(sequence(1, size(words) - 3), i -> named_struct('a', words[i], 'b', words[i + 1]))")).alias("_i")).select("_i.*")
    pairs = (
        graph.nodes.join(inner, ["a", "b"], "left_anti").join(longest, ["a", "b"], "left")
        .where(F.coalesce(100 * F.col("_longer") < 50 * F.col("f"), F.lit(True)))
    )

    def word(name: str) -> DataFrame:
        return graph.words.select(F.col("id").alias(name), F.col("word").alias(f"_{name}"), F.col("f").alias(f"f{name}"))

    first = graph.words.select(F.col("id").alias("a"), "lang", F.col("word").alias("_a"), F.col("f").alias("fa"))
    two = pairs.join(first, "a").join(word("b"), "b").select(
        "lang", F.concat_ws(" ", "_a", "_b").alias("phrase"), F.col("f").alias("a"), F.col("fa").alias("l"), F.col("fb").alias("r"),
        _score(F.col("f"), F.col("fa"), F.col("fb")).alias("score"))
    edges = paths.select("n", F.explode(F.expr(
        "transform(sequence(0, size(words) - 3), i -> named_struct('a', words[i], 'b', words[i + 1], 'c', words[i + 2]))")).alias("_e"))
    edges = edges.select("_e.*", F.col("n").alias("f"))
    tails = graph.nodes.select("a", "b", F.col("f").alias("fab"))
    heads = graph.nodes.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("f").alias("fbc"))
    parts = edges.join(tails, ["a", "b"]).join(heads, ["b", "c"]).join(first, "a").join(word("b"), "b").join(word("c"), "c")
    cuts = F.array_sort(F.array(
        F.struct(_score(F.col("f"), F.col("fa"), F.col("fbc")).alias("score"), F.lit(1).alias("k"), F.col("fa").alias("l"), F.col("fbc").alias("r")),
        F.struct(_score(F.col("f"), F.col("fab"), F.col("fc")).alias("score"), F.lit(2).alias("k"), F.col("fab").alias("l"), F.col("fc").alias("r"))))
    three = parts.withColumn("_cut", cuts[0]).select(
        "lang", F.concat_ws(" ", "_a", "_b", "_c").alias("phrase"), F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score")
    return two.unionByName(three)


def collocations(docs: DataFrame, least: int = 10, most: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``most`` phrases of two or three words.

    By score, then a, both descending, then phrase in the order of its bytes. Null texts count as empty,
    a null language as ``und``. Repeated rows count as often as they stand there. An empty table, and
    one in which no phrase stands ``least`` times, have no rows. Other columns are not read. Memory
    grows with the longest text.
    """
    graph = build(docs, least, text, lang)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = candidates(graph).withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(16)))
    # First the best of sixteen parts of each language, so that the last choice is among few.
    near = found.withColumn("_near", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_near") <= most)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    return ranked.join(graph.sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
