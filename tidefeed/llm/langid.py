"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counting is one pass in which each task sums its n-grams per language, and Spark adds the sums up;
the model is a matrix of ``BUCKETS`` rows and one column per language, which bounds what is
collected and broadcast. Scoring is one pass of sparse look-ups in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import blocks, hand_back, ship, utf8

BITS = 16
BUCKETS = 1 << BITS
UNKNOWN = "und"
SPACE = 32
#: Text bytes counted or scored at once: the n-grams of a block take about 50 times as much.
BLOCK = 1 << 20


@dataclass
class LanguageModel:
    """``log_prob[bucket, language]`` and the log of each language's share of documents."""

    languages: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray


def any_language() -> LanguageModel:
    """A model with one language for every text that has a letter."""
    return LanguageModel(["any"], np.zeros((BUCKETS, 1), np.float32), np.zeros(1))


@cache
def _folded() -> np.ndarray:
    """Code point to its lower case; everything that is no letter to a space."""
    out = np.full(0x110000, SPACE, np.uint32)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all bigrams and trigrams, the row of each, and whether each row has a letter.

    Every text is taken between two spaces; an n-gram that starts with two spaces or consists of a
    space alone says nothing and is left out.
    """
    data, _ = utf8(column)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    lengths = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column), dtype=np.int32), lengths + 2)
    chars = np.full(len(rows), SPACE, np.uint32)
    inside = np.ones(len(rows), bool)
    ends = np.cumsum(lengths + 2)
    inside[ends - 1] = inside[ends - lengths - 2] = False
    chars[inside] = _folded()[points]
    letter = chars != SPACE
    lettered = np.bincount(rows[letter], minlength=len(column)) > 0
    a, b, c = chars[:-2], chars[1:-1], chars[2:]
    pair = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)
    triple = pair + c * np.uint32(0xC2B2AE3D)
    same = rows[:-2] == rows[2:]
    two = same & (letter[:-2] | letter[1:-1])
    three = same & letter[1:-1]
    shift, mix = np.uint32(32 - BITS), np.uint32(0x27D4EB2F)
    h2 = ((pair[two] ^ (pair[two] >> np.uint32(15))) * mix) >> shift
    h3 = ((triple[three] ^ (triple[three] >> np.uint32(13))) * mix) >> shift
    return np.concatenate([h2, h3]), np.concatenate([rows[:-2][two], rows[:-2][three]]), lettered


def fit(docs: DataFrame, text: str = "text", label: str = "lang", smoothing: float = 0.5) -> LanguageModel:
    """Learn from every row whose text and label are not null."""
    ship(docs.sparkSession)
    labelled = docs.select(F.col(text).alias("text"), F.col(label).alias("label")).dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: dict[str, int] = {}
        sums: list[np.ndarray] = []
        documents: list[int] = []
        for batch in batches:
            labels = batch.column(1)
            for first, texts in blocks(batch.column(0), BLOCK):
                names = labels.slice(first, len(texts)).to_pylist()
                for name in names:
                    if name not in place:
                        place[name] = len(sums)
                        sums.append(np.zeros(BUCKETS, np.int64))
                        documents.append(0)
                    documents[place[name]] += 1
                own = np.array([place[name] for name in names], np.int32)
                grams, rows, _ = _grams(texts)
                of = own[rows]
                for k in np.unique(own):
                    sums[k] += np.bincount(grams[of == k], minlength=BUCKETS)
        for name, k in place.items():
            used = np.flatnonzero(sums[k])
            yield pa.RecordBatch.from_pydict({
                "label": pa.array([name] * (len(used) + 1), pa.string()),
                "bucket": pa.array(np.append(used, -1), pa.int32()),
                "n": pa.array(np.append(sums[k][used], documents[k]), pa.int64()),
            })
        hand_back()

    counted = (
        labelled.mapInArrow(count, "label string, bucket int, n long")
        .groupBy("label", "bucket").agg(F.sum("n").alias("n"))
    )
    found = counted.toPandas()
    languages = sorted(found["label"].unique().tolist())
    column = {name: k for k, name in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    documents = np.zeros(len(languages))
    where = found["label"].map(column).to_numpy(np.int64)
    bucket, n = found["bucket"].to_numpy(np.int64), found["n"].to_numpy(np.float64)
    gram = bucket >= 0
    counts[bucket[gram], where[gram]] = n[gram]
    documents[where[~gram]] = n[~gram]
    if not languages:
        return LanguageModel([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * BUCKETS)
    return LanguageModel(languages, log_prob.astype(np.float32), np.log(documents / documents.sum()))


def language(docs: DataFrame, model: LanguageModel, text: str = "text") -> Column:
    """A column (lang string, score double): the likeliest language and its posterior share.

    ``und`` with score 0 for null, for texts without a letter, and if nothing was learned; equal
    languages go to the first by name. The column depends on the text alone.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = shared.value
        names = np.array([*m.languages, UNKNOWN], object)
        for column in columns:
            langs, scores = [], []
            for _, texts in blocks(column, BLOCK):
                grams, rows, lettered = _grams(texts)
                logs = np.column_stack([
                    prior + np.bincount(rows, weights=m.log_prob[:, k][grams], minlength=len(texts))
                    for k, prior in enumerate(m.log_prior)
                ]) if m.languages else np.zeros((len(texts), 1))
                best = logs.argmax(1)
                share = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                known = lettered & bool(m.languages)
                langs.extend(names[np.where(known, best, len(m.languages))])
                scores.extend(np.where(known, share, 0.0))
            yield pa.StructArray.from_arrays(
                [pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"]
            )
        hand_back()

    return predicted.asNondeterministic()(F.col(text))
