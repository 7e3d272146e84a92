"""Token ids on disk with keyed access.

A store is one Parquet folder, ``shards``, so any file system that Spark reaches can hold it. A row is
a segment: documents in ascending key order, up to the one that fills it.

* ``payload`` holds the raw ids as little-endian unsigned 32-bit integers, one document after another;
  ``doc_ids`` and ``lengths`` are the keys and lengths of its documents.
* ``low`` and ``high`` bound its keys, and a minimal perfect hash gives every key its own slot, which
  stores a 32-bit fingerprint, the offset in the payload and the length. As keys ascend, the bounds
  lead a key to its segment, and one slot there to its ids, whatever the store's size; a key that is
  not in the store is refused by its fingerprint but for one in four billion.

The columns are read apart: a look-up never reads a payload.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefeed.llm.text import blocks, checked_broadcast, hand_back, ship
from tidefeed.session import written

END_ID = 2
#: Ids in a segment, about; one long document may exceed it.
SEGMENT_IDS = 1 << 18
ROW_GROUP_BYTES = 16 << 20
#: Asked keys of one segment that are looked up or cut together.
ASKED_KEYS = 4096
#: Slots of a level for each key that is still without one.
SPREAD = 1.5
#: Bytes of the pieces and runs, with their ids, that a worker remembers.
REMEMBERED_BYTES = 96 << 20
#: Bytes of a remembered entry besides its text and ids.
ENTRY_BYTES = 160
INDEX = {"sizes": "array<int>", "bits": "binary", "prints": "binary", "offsets": "binary", "counts": "binary"}
SEGMENTS = ("shard int, segment int, first long, payload binary, doc_ids array<long>, lengths array<long>, "
            "low long, high long, " + ", ".join(f"{name} {kind}" for name, kind in INDEX.items()))

#: The pre-tokenizer, as the library prints it, whose cuts ``SIMPLE`` knows.
BYTE_LEVEL = "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"
#: Latin letters; every character of the ranges is one.
LATIN = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Signs that are neither white space, letters, digits nor the apostrophe of contractions.
SIGNS = r"!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~"
#: Runs of Latin letters, of digits, of signs, and single line ends: a token never spans two of
#: these, and a space before the first run belongs to it.
#: Possessive: runs of one class cannot be cut otherwise, and a long run before a character of no class
#: must not be tried at every length.
SIMPLE = re.compile(f" ?(?:[{LATIN}]++|[0-9]++|[{SIGNS}]++)(?:[{LATIN}]++|[0-9]++|[{SIGNS}]++|\n(?![\\s]|$))*+")
WORD = re.compile(f" ?[{LATIN}]+")
PART = re.compile(f" ?[{LATIN}]+| ?[0-9]+| ?[{SIGNS}]+|\n")
#: How the byte-level alphabet writes the bytes of UTF-8: printable Latin-1 as itself, others moved up.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_MOVED = [byte for byte in range(256) if byte not in _PRINTED]
BYTE_LETTERS = {byte: chr(byte) for byte in _PRINTED} | {byte: chr(256 + i) for i, byte in enumerate(_MOVED)}


class PieceEncoder:
    """Ids of whole texts, by the tokenizers library, which sees each frequent piece once.

    A text is cut before every space that stands between two characters that are not white space;
    byte-level pre-tokenizers of this family always begin a token there. A text with any other white
    space around a space is given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        model = type(self.tokenizer.model).__name__
        steps = [str(step) for step in (self.tokenizer.pre_tokenizer, self.tokenizer.normalizer)]
        self.cuts_words = model == "BPE" and steps == [BYTE_LEVEL, "None"]
        added = [re.escape(token.content) for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        # A word alone is given to the model unseen.
        self.cuts_words = self.cuts_words and not any(WORD.fullmatch(token) for token in added)
        self.young: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.bytes = 0

    def _whole(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", one.ids).tobytes() for one in found]

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces: word by word where the pre-tokenizer surely cuts so, else whole."""
        other = []
        young, word, added = self.young, self._word, self.added
        self.bytes += sum(map(len, pieces)) * 5 + len(pieces) * ENTRY_BYTES
        for piece in pieces:
            if not self.cuts_words:
                other.append(piece)
            elif WORD.fullmatch(piece):
                young[piece] = word(piece, False)
            elif SIMPLE.fullmatch(piece) and not (added and added.search(piece)):
                young[piece] = b"".join(map(word, PART.findall(piece)))
            else:
                other.append(piece)
        for first in range(0, len(other), 10_000):
            part = other[first : first + 10_000]
            self.young.update(zip(part, self._whole(part), strict=True))

    def _ids(self, run: str) -> bytes:
        if run.isascii():
            # No other character of a run is written otherwise.
            plain = run.replace(" ", BYTE_LETTERS[32]).replace("\n", BYTE_LETTERS[10])
        else:
            plain = run.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [token.id for token in self.tokenizer.model.tokenize(plain)]).tobytes()

    def _word(self, run: str, keep: bool = True) -> bytes:
        """Ids of one run of a piece, maybe after a space."""
        ids = self.young.get(run) or self.words.get(run) or self.old.get(run)
        if ids is None:
            ids = self._ids(run)
            if keep:
                self.words[run] = ids
                self.bytes += len(run) * 5 + ENTRY_BYTES
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, four bytes each."""
        if self.bytes > REMEMBERED_BYTES // 2:
            self.old, self.young, self.words, self.bytes = self.young, {}, {}, 0
        get = self.young.get
        out: list[bytes] = []
        late, whole, missing = [], [], set()
        for i, text in enumerate(texts):
            pieces = text.replace(" ", "\0 ").split("\0")
            ids = list(map(get, pieces))
            if "\0" in text:
                whole.append(i)
            elif None in ids:
                gaps = [k for k, known in enumerate(ids) if known is None]
                missing.update([pieces[k] for k in gaps])
                late.append((i, pieces, ids, gaps))
            out.append(b"" if None in ids else b"".join(ids))
        odd, new = set(), []
        for piece in missing:
            if piece in self.old:
                self.young[piece] = self.old[piece]
            else:
                inner = piece.removeprefix(" ")
                if not inner or inner[0].isspace() or inner[-1].isspace():
                    odd.add(piece)
                else:
                    new.append(piece)
        self._learn(new)
        for i, pieces, ids, gaps in late:
            if odd and not odd.isdisjoint([pieces[k] for k in gaps]):
                whole.append(i)
            else:
                for k in gaps:
                    ids[k] = self.young[pieces[k]]
                out[i] = b"".join(ids)
        for i, ids in zip(whole, self._whole([texts[i] for i in whole]), strict=True):
            out[i] = ids
        return out


def default_tokenizer() -> str:
    """Path of the public byte-level BPE vocabulary with 50 thousand entries."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)


def write_shards(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text",
                 end_id: int = END_ID) -> None:
    """Encode every whole text (null: empty), append ``end_id``, and write the shards.

    Equal keys are ordered by a hash of their text, null keys come first. Other columns are not read.
    """
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = _encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        segment, first, held, shard = 0, 0, 0, None
        parts: list[bytes] = []
        keys: list[int | None] = []
        lengths: list[int] = []

        def done() -> pa.RecordBatch:
            row = {
                "shard": pa.array([shard], pa.int32()), "segment": pa.array([segment], pa.int32()),
                "first": pa.array([first], pa.int64()), "payload": pa.array([b"".join(parts)], pa.binary()),
                "doc_ids": pa.array([keys], pa.list_(pa.int64())),
                "lengths": pa.array([lengths], pa.list_(pa.int64())),
            }
            known = [key for key in keys if key is not None]
            row |= {name: pa.array([bound(known, default=None)], pa.int64()) for name, bound in (("low", min), ("high", max))}
            sizes, *rest = index_of(keys, lengths)
            row["sizes"] = pa.array([sizes], pa.list_(pa.int32()))
            row |= {name: pa.array([data], pa.binary()) for name, data in zip(list(INDEX)[1:], rest, strict=True)}
            return pa.RecordBatch.from_pydict(row)

        for batch in batches:
            shard = batch.column("_shard")[0].as_py() if len(batch) else shard
            for at, texts in blocks(batch.column("_text"), 1 << 20):
                own = batch.column("_key").slice(at, len(texts)).to_pylist()
                for doc, ids in zip(own, encoder.encode([t or "" for t in texts.to_pylist()]), strict=True):
                    parts.append(ids + end)
                    keys.append(doc)
                    lengths.append(len(ids) // 4 + 1)
                    held += lengths[-1]
                    if held >= SEGMENT_IDS:
                        yield done()
                        segment, first, held = segment + 1, first + held, 0
                        parts, keys, lengths = [], [], []
        if keys:
            yield done()
        hand_back()

    ordered = (
        docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
        .withColumn("_tie", F.xxhash64("_text"))
        .repartitionByRange("_key", "_tie")
        .sortWithinPartitions("_key", "_tie")
        .select("_key", "_text", F.spark_partition_id().alias("_shard"))
    )
    (ordered.mapInArrow(encode, SEGMENTS).write.option("compression", "zstd")
     .option("parquet.block.size", ROW_GROUP_BYTES).parquet(f"{path}/shards"))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hashes of integer keys, other ones for each seed."""
    x = keys.astype(np.uint64) + np.uint64((seed * 2 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _print(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def perfect_hash(keys: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(sizes of the levels, bits of all levels) of a minimal perfect hash of distinct keys.

    On each level a key that alone hashes to a bit takes it; the others go on to the next level.
    A key's slot is the number of set bits before its own.
    """
    sizes, levels = [], []
    while len(keys):
        size = int(np.ceil(len(keys) * SPREAD)) + 1
        at = (_mixed(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        levels.append(alone)
        keys = keys[~alone[at]]
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(keys: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each key, -1 for a key that finds no bit (it is not in the index)."""
    rank = np.cumsum(bits) - 1
    out = np.full(len(keys), -1, np.int64)
    open_, base = np.arange(len(keys)), 0
    for level, size in enumerate(sizes):
        at = base + (_mixed(keys[open_], level) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        out[open_[hit]] = rank[at[hit]]
        open_, base = open_[~hit], base + size
    return out


def index_of(keys: list[int | None], lengths: list[int]) -> tuple[list[int], bytes, bytes, bytes, bytes]:
    """(sizes, bits, prints, offsets, counts) of a segment; of equal keys the first has the slot."""
    n = np.array(lengths, np.int64)
    at = np.cumsum(n) - n
    known = np.array([i for i, key in enumerate(keys) if key is not None], np.int64)
    distinct, first = np.unique(np.array([keys[i] for i in known], np.int64), return_index=True)
    sizes, bits = perfect_hash(distinct)
    order = np.empty(len(distinct), np.int64)
    order[slots(distinct, sizes, bits)] = np.arange(len(distinct))
    place = known[first[order]]
    return (sizes, np.packbits(bits).tobytes(), _print(distinct[order]).tobytes(),
            at[place].astype("<i8").tobytes(), n[place].astype("<i8").tobytes())


def _places(row: dict, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether it is there, offset, length) of each key, by one slot of the segment's index."""
    sizes = [int(size) for size in row["sizes"]]
    bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
    prints, offsets, counts = (np.frombuffer(row[name], kind) for name, kind in (
        ("prints", "<u4"), ("offsets", "<i8"), ("counts", "<i8")))
    if not len(prints):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    slot = slots(keys, sizes, bits)
    there = (slot >= 0) & (prints[slot] == _print(keys))
    return there, offsets[slot], counts[slot]


def _in_parts(rows: DataFrame, value: Column) -> DataFrame:
    """(shard, segment, _asked): lists of at most about ``ASKED_KEYS`` values, however many a segment has."""
    sized = rows.groupBy("shard", "segment").agg(F.count("*").alias("_n"))
    part = F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("_n") / ASKED_KEYS)).alias("_part")
    return (rows.join(sized, ["shard", "segment"]).select("shard", "segment", part, value.alias("_value"))
            .groupBy("shard", "segment", "_part").agg(F.collect_list("_value").alias("_asked")).drop("_part"))


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, shard, segment, offset, n) of each distinct key that is in the store.

    A key goes to the first segment whose highest key is not below it: first by the bounds of the
    shards, one number for each task that wrote, then by those of the shard's segments.
    """
    ship(spark)
    stored = spark.read.parquet(f"{path}/shards")
    bounds = stored.where("high is not null").select("shard", "segment", "low", "high")
    shards = sorted((row.high, row.shard) for row in bounds.groupBy("shard").agg(F.max("high").alias("high")).collect())
    highs = spark.sparkContext.broadcast((np.array([h for h, _ in shards], np.int64), np.array([s for _, s in shards], np.int32)))

    @F.arrow_udf("int")
    def shard_of(column: pa.Array) -> pa.Array:
        high, shard = highs.value
        at = np.searchsorted(high, column.to_numpy(zero_copy_only=False))
        inside = at < len(high)
        return pa.array(np.append(shard, -1)[np.where(inside, at, -1)], pa.int32(), mask=~inside)

    asked = keys.select(F.col(key).cast("long").alias("doc_id")).dropna().distinct()
    asked = asked.withColumn("shard", shard_of("doc_id")).dropna()
    lists = bounds.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("high", "low", "segment"))).alias("_bounds"))
    at = F.expr("element_at(_bounds, 1 + size(filter(_bounds, b -> b.high < doc_id)))").alias("_at")
    led = asked.join(lists, "shard").select("doc_id", "shard", at).where("_at.low <= doc_id").select(
        "doc_id", "shard", "_at.segment")
    found = _in_parts(led, F.col("doc_id")).join(stored.select("shard", "segment", *INDEX), ["shard", "segment"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = np.array(row["_asked"], np.int64)
                there, offset, n = _places(row, own)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(own[there]),
                    "shard": pa.array(np.full(there.sum(), row["shard"], np.int32)),
                    "segment": pa.array(np.full(there.sum(), row["segment"], np.int32)),
                    "offset": pa.array(offset[there]), "n": pa.array(n[there]),
                })

    return found.mapInArrow(find, "doc_id long, shard int, segment int, offset long, n long")


def fetch(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of each distinct key in the store: the end id is the last of ids.

    A segment's payload is read once for some thousands of its keys, and no payload without a key.
    """
    ship(spark)
    asked = _in_parts(lookup(spark, path, keys, key), F.struct("doc_id", "offset", "n"))
    payloads = spark.read.parquet(f"{path}/shards").select("shard", "segment", "payload")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                payload = batch.column("payload")[i].as_buffer()
                for place in batch.column("_asked")[i].as_py():
                    ids = np.frombuffer(payload, "<u4", count=place["n"], offset=4 * place["offset"])
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array([place["doc_id"]], pa.int64()),
                        "ids": pa.array([ids.astype(np.int64)], pa.list_(pa.int64()))})

    return asked.join(payloads, ["shard", "segment"]).mapInArrow(cut, "doc_id long, ids array<long>")


READ = "doc_id long, shard int, segment int, offset long, n long, _at long, crc32 long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each segment, each key's at the place that the index names."""
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            where = f"in {row['shard']}, {row['segment']}"
            payload = memoryview(row["payload"].as_buffer())
            listed = row["doc_ids"].values
            n = row["lengths"].values.to_numpy(zero_copy_only=False).copy()
            at = np.cumsum(n) - n
            known = np.flatnonzero(listed.is_valid().to_numpy(zero_copy_only=False))
            distinct, first = np.unique(listed.drop_null().to_numpy(zero_copy_only=False), return_index=True)
            place = known[first]
            there, offset, long = _places({name: row[name].as_py() for name in INDEX}, distinct)
            if not there.all():
                raise ValueError(f"the index does not find a stored key: {distinct[~there][0]}, {where}")
            if not np.all((at[place] == offset) & (n[place] == long)):
                raise ValueError(f"the index leads keys to other places than theirs, {where}")
            # Null keys and later ones of equal keys have no slot: they are read by the lengths.
            at[place], n[place] = offset, long
            crc = [zlib.crc32(payload[4 * a : 4 * (a + k)]) for a, k in zip(at.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": listed,
                "shard": pa.array(np.full(len(n), row["shard"].as_py(), np.int32)),
                "segment": pa.array(np.full(len(n), row["segment"].as_py(), np.int32)),
                "offset": pa.array(at), "n": pa.array(n),
                "_at": pa.array(at + row["first"].as_py()),
                "crc32": pa.array(crc, pa.int64()),
            })
    hand_back()


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document from the payload: doc_id, shard, segment, offset, n, start, crc32.

    One scan: each key is looked up in its segment's index and its ids are cut where the slot says; a
    stored key that the index does not find, or finds at a place that is not the key's, is an error.
    Only null keys and later ones of equal keys, which have no slot, are read by the lengths beside
    the payload. ``start`` counts the ids of all documents before it, ``crc32`` is over its ids' bytes.
    """
    ship(spark)
    stored = spark.read.parquet(f"{path}/shards")
    lengths = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, n: a + n)
    total = stored.select("shard", lengths.alias("_n")).groupBy("shard").agg(F.sum("_n").alias("_n"))
    # One row per shard.
    before = Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(total.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    slices = stored.drop("low", "high").mapInArrow(_cut, READ)
    return slices.join(checked_broadcast(bases), "shard").withColumn("start", F.col("_base") + F.col("_at")).drop(
        "_base", "_at")
