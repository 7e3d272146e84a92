"""Periodic runs against all periods at all places, and edge rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefeed.llm import runs


def brute(words, least=12):
    """(start, length, period) of every stretch that cannot go on, for every period; the smallest period counts."""
    n, out = len(words), {}
    for period in range(1, n // 2 + 1):
        i = 0
        while i + period < n:
            j = i
            while j + period < n and words[j] == words[j + period]:
                j += 1
            if j > i and j + period - i >= max(least, 2 * period):
                out.setdefault((i, j + period - i), period)
            i = max(j, i + 1)
    return sorted((start, length, period) for (start, length), period in out.items())


def shortened(words, found):
    gone = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def made(pick):
    out = []
    for _ in range(pick.randint(0, 8)):
        root = [pick.randint(1, 3) for _ in range(pick.randint(1, 9))]
        out += root * pick.randint(1, 6)
        del out[len(out) - pick.randint(0, 2):]
    return out


@pytest.mark.parametrize("least", [2, 4, 12])
def test_runs_equal_brute_force(least):
    pick = random.Random(least)
    for _ in range(300):
        texts = [made(pick) for _ in range(pick.randint(0, 6))]
        if least < 12:
            got = [sorted(map(tuple, runs.runs(t, least).tolist())) for t in texts]
        else:
            got = [[tuple(r) for r in rows.tolist()] for rows in runs.block_runs(texts, least)]
        assert got == [brute(t, least) for t in texts]


def test_fibonacci_words():
    """Words with as many runs as can be, whose suffixes share long prefixes."""
    a, b = [1], [1, 2]
    while len(b) < 1500:
        a, b = b, b + a
    assert [tuple(r) for r in runs.block_runs([b, b[::-1], b])[1].tolist()] == brute(b[::-1])


def test_extensions_are_common_prefixes():
    pick = np.random.default_rng(1)
    s = pick.integers(1, 4, 400).tolist()
    tree = runs.Extensions([*s, 0])
    assert tree.order == sorted(range(401), key=lambda i: [*s, 0][i:])
    turned = [4 - x for x in s]
    assert tree.turned() == sorted(range(401), key=lambda i: [*turned, 0][i:])
    x, y = pick.integers(0, 401, 3000), pick.integers(0, 401, 3000)
    x, y = x[x != y], y[x != y]

    def common(i, j):
        k = 0
        while i + k < 400 and j + k < 400 and s[i + k] == s[j + k]:
            k += 1
        return k

    assert tree.common(x, y).tolist() == [common(i, j) for i, j in zip(x.tolist(), y.tolist(), strict=True)]


def test_texts(spark):
    line = "one two three four five six seven"
    texts = [None, "", " \n\t ", "word", "word " * 11, "word " * 12, "Word word " * 9, f"{line}\n{line}", f"{line} {line} {line}",
             f"{line} x {line} y {line}", "a b " * 20 + "c d e " * 20, "é漢 \x1c " * 30, "| " * 30_000, " ".join(f"w{i}" for i in range(30_000)),
             (line + " ") * 3000, "a\x0bb\x0cc\rd\te " * 5, "a b " * 20, "a b " * 20]
    rows = [(i, t, "r", "c", 3) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, start int")
    got = docs.select("doc_id", runs.find(docs).alias("got")).collect()
    assert len(got) == len(texts)
    for row in got:
        words = (texts[row.doc_id] or "").encode().split()
        found = [(r.start, r.length, r.period) for r in row.got.runs]
        if len(words) < 1000:
            assert found == brute(words)
        assert row.got.collapsed == shortened([w.decode() for w in words], found)
    by_id = {r.doc_id: [tuple(x) for x in r.got.runs] for r in got}
    assert by_id[12] == [(0, 30_000, 1)] and by_id[13] == [] and by_id[14] == [(0, 21_000, 7)]
    assert by_id[4] == [] and by_id[5] == [(0, 12, 1)] and by_id[7] == [(0, 14, 7)]
    assert docs.limit(0).select(runs.find(docs).alias("got")).count() == 0
    assert docs.select("*", runs.find(docs).alias("got")).where(F.size("got.runs") > 0).count() == sum(map(bool, by_id.values()))
