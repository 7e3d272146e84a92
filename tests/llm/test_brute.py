"""Learned operators and their parts against plain Python, and benchmarks of many windows."""

import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from conftest import SF_DIR
from pyspark.sql import functions as F

from tidefeed.llm import crf, decontaminate, langid, mixture, personal, ppm, rulequality, secretscan
from tidefeed.llm.queries import QUERIES
from tidefeed.llm.text import table

MASK = 0xFFFFFFFF


def buckets(text):
    """Buckets of a text's bigrams and trigrams, one by one."""
    line = [32] + [ord(c.lower()) if len(c.lower()) == 1 else ord(c) if c.isalpha() else 32 for c in text] + [32]
    line = [point if chr(point).isalpha() else 32 for point in line]
    for a, b, c in zip(line, line[1:], line[2:], strict=False):
        pair = (a * 0x9E3779B1 + b * 0x85EBCA77) & MASK
        if a != 32 or b != 32:
            yield ((pair ^ (pair >> 15)) * 0x27D4EB2F & MASK) >> 16
        if b != 32:
            triple = (pair + c * 0xC2B2AE3D) & MASK
            yield ((triple ^ (triple >> 13)) * 0x27D4EB2F & MASK) >> 16


def test_language_id_is_naive_bayes(spark):
    documents = table(spark, SF_DIR, "documents").collect()
    counts, number = defaultdict(lambda: defaultdict(int)), defaultdict(int)
    for doc in documents:
        if zlib.crc32(str(doc.doc_id).encode()) % 3 != 1 and doc.lang is not None and doc.text is not None:
            number[doc.lang] += 1
            for bucket in buckets(doc.text):
                counts[doc.lang][bucket] += 1
    total = {lang: sum(counts[lang].values()) + 0.5 * (1 << 16) for lang in number}
    got = {r.doc_id: r for r in QUERIES["op7_language_id"](spark, SF_DIR).collect()}
    assert len(got) == len(documents)
    for doc in documents:
        row = got[doc.doc_id]
        if not any(c.isalpha() for c in doc.text or ""):
            assert (row.lang_pred, row.score) == ("und", 0)
            continue
        own = list(buckets(doc.text))
        logs = {lang: math.log(n / sum(number.values())) + sum(
            math.log((counts[lang][bucket] + 0.5) / total[lang]) for bucket in own) for lang, n in number.items()}
        best = max(logs.values())
        share = 1 / sum(math.exp(v - best) for v in logs.values())
        # The model keeps 32-bit logarithms.
        assert row.score == pytest.approx(share, abs=0.01)
        assert logs[row.lang_pred] >= best - 0.02


def measures(text):
    words = [w for w in re.split(r"[ \x09-\x0d]+", text) if w]
    lines = [line for line in text.split("\n") if line.strip(" ")]
    chars = len(text)

    def share(part, whole):
        return part / whole if whole else 0.0

    def count(pattern):
        return share(len(re.findall(pattern, text)), chars)

    return [
        chars, len(words), share(sum(map(len, words)), len(words)), count(r"[#*$%&|<>{}\[\]\\^~_=+@]"), count(r"[!?;:\"'()]"),
        share(sum(c.isupper() for c in text), chars), count("[0-9]"), share(sum(c.isalpha() for c in text), chars),
        share(len(set(words)), len(words)), share(len(lines) - len(set(lines)), len(lines)), share(len(words), len(lines)),
        share(max(map(len, lines), default=0), chars)]


def _holds(tests, values):
    return all((values[rulequality.STATISTICS.index(name)] > bound) == above for name, above, bound in tests)


def test_quality_column_is_its_rules(spark):
    """Statistics and scores of the Spark column, document by document."""
    docs, labels = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "labels")
    model = rulequality.fit(docs, labels)
    assert model.rules
    values = {d.doc_id: measures(d.text or "") for d in docs.collect()}
    names = [f"_stat_{name}" for name in rulequality.STATISTICS]
    for row in rulequality.statistics(docs).select("doc_id", *names).collect():
        assert list(row[1:]) == pytest.approx(values[row.doc_id])
    for row in rulequality.score(docs, model).select("doc_id", "score").collect():
        odds = model.intercept + sum(weight for tests, weight in model.rules if _holds(tests, values[row.doc_id]))
        assert row.score == pytest.approx(1 / (1 + math.exp(-odds)))


def test_quality_weights_solve_the_lasso():
    """Where the steps end, every kept rule pulls by exactly the penalty; the usual number of steps comes near."""
    rng = np.random.default_rng(3)
    values = rng.normal(size=(1500, len(rulequality.STATISTICS)))
    chance = 1 / (1 + np.exp(-(2.0 * (values[:, 0] > 0.3) - 1.5 * (values[:, 3] > 0) * (values[:, 5] < 0.5))))
    labels = (rng.random(1500) < chance).astype(float)

    def solved(rounds):
        model = rulequality.learn(values, labels, rounds=rounds)
        holds = np.array([[_holds(tests, row) for tests, _ in model.rules] for row in values], float)
        weights, size = np.array([weight for _, weight in model.rules]), holds.std(0)
        odds = model.intercept + holds @ weights
        loss = np.logaddexp(0, odds) - labels * odds
        off = 1 / (1 + np.exp(-odds)) - labels
        pull = ((holds - holds.mean(0)) / size * off[:, None]).mean(0)
        return loss.mean() + rulequality.PENALTY * np.abs(weights * size).sum(), pull, weights, off.mean()

    loss, pull, weights, off = solved(5000)
    assert 0 < len(weights) < rulequality.TREES * (2 << rulequality.DEPTH)
    assert abs(off) < 1e-5 and np.abs(pull + rulequality.PENALTY * np.sign(weights)).max() < 0.02 * rulequality.PENALTY
    assert solved(rulequality.ROUNDS)[0] <= loss * 1.001


def plain_tags(field, words):
    """Tags of one text by Viterbi over all its words, from the field's weights by name."""
    zero = np.zeros(3)
    forms = [crf._named(crf.short_form(word, field.context)) for word in words]
    signs = np.array([crf._signs(word) for word in words], float).mean(0)
    whole = sum(field.texts[i][np.searchsorted(crf.EDGES, share)] for i, share in enumerate(signs))
    best, back = None, []
    for i in range(len(words)):
        own = whole.copy()
        for place in crf.SEEN:
            names = forms[i + place] if 0 <= i + place < len(words) else ["edge"]
            own = own + sum((field.words.get(f"{place}{name}", zero) for name in names), zero)
        if best is None:
            best = own + field.first
        else:
            options = best[:, None] + field.change
            back.append(options.argmax(0))
            best = options.max(0) + own
    path = [int(best.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return path[::-1]


@pytest.mark.parametrize("scan", [secretscan, personal])
def test_tags_are_the_best_paths(scan):
    """Whole batches, with hits at the ends of texts beside those of the next text."""
    field, pick = scan.default_field(), random.Random(9)
    rows = [words for words, _ in scan.labelled_rows(120, seed=99)]
    texts = [row[pick.randrange(3) : len(row) - pick.randrange(6)] for row in rows] + [["word"], [rows[0][-1]]]
    texts.insert(5, [])
    texts.insert(6, rows[4] + rows[9] + rows[5])
    got = {i: dict(zip(places.tolist(), tags.tolist(), strict=True)) for i, places, tags in crf.Tagger(field).tags(texts)}
    for i, words in enumerate(texts):
        want = plain_tags(field, words) if words else []
        assert [got.get(i, {}).get(k, 0) for k in range(len(words))] == want


def test_kept_columns_may_clash(spark):
    docs = spark.createDataFrame([(1, "one two", "s", 7, 8, 9)],
                                 "doc_id long, text string, source string, size int, _rid int, score int")
    mixed = mixture.mix(docs, columns=("size", "_rid", "doc_id", "source", "score"))
    assert mixed.columns.count("size") == mixed.columns.count("doc_id") == 1
    assert mixed.select("size", "_rid", "source", "score").collect() == [(2, 8, "s", 9)]
    scored = ppm.score(docs, ppm.count(docs, F.lit(True)), columns=("score", "_rid", "text"))
    assert scored.columns.count("score") == 1
    row = scored.first()
    assert (row["_rid"], row["text"], row["n_tokens"]) == (8, "one two", 3) and row["score"] < 0


def test_hashed_windows_equal_listed_ones(spark):
    """Broadcast and shuffled hashes against the set in the plan, on the given tables."""
    docs, benchmark = table(spark, SF_DIR, "documents"), table(spark, SF_DIR, "benchmark")
    docs = docs.unionByName(docs.limit(0)).unionByName(
        spark.createDataFrame([(-1, None), (-2, ""), (-3, "short")], "doc_id long, text string"), allowMissingColumns=True)
    want = sorted(map(str, decontaminate.report(docs, benchmark).collect()))
    for hash_limit in (10**6, 0):
        assert sorted(map(str, decontaminate.report(docs, benchmark, set_limit=0, hash_limit=hash_limit).collect())) == want


def test_a_million_windows(spark):
    items = spark.range(20).select(
        F.col("id").alias("item_id"),
        F.expr("array_join(transform(sequence(0, 50011), i -> concat('w', id, 'x', i * 7919 % 50021)), ' ')").alias("text"))
    texts = [" ".join(f"w{k}x{i * 7919 % 50021}" for i in range(k, k + 12 + k)) for k in range(20)]
    # The same words in another order, and thirteen of them among many others.
    texts += [" ".join(reversed(texts[15].split())), "a " * 400 + texts[1] + " b" * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.report(docs, items).collect()}
    assert decontaminate.windows(items).count() == 1_000_000
    assert [got[k].n_hit for k in range(22)] == [0, *range(13, 32), 0, 13]
    assert [got[k].items for k in (0, 1, 19, 20, 21)] == [[], ["1"], ["19"], [], ["1"]]
    assert got[1].contaminated and not got[21].contaminated
