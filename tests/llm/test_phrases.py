"""Collocations against counts in plain Python, compact paths, and edge rows."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefeed.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, phrase string, a string, _a string, id long, n string"


def counted(rows):
    """Counts of all phrases of one to three words by language."""
    f = Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = [w for w in re.split(r"[\x20\x09]+", piece) if w]
            for k in (1, 2, 3):
                f.update((lang or "und", tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f


def expected(rows, least, most):
    f = counted(rows)
    long = {g: n for g, n in f.items() if len(g[1]) > 1 and n >= least}
    by_lang = {}
    for (lang, words), a in long.items():
        inside = [n for (other, w), n in long.items() if other == lang and len(w) > len(words) and words in (w[:2], w[1:])]
        if any(100 * n >= 50 * a for n in inside):
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000000 * a * a // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        by_lang.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    out = []
    for lang, found in by_lang.items():
        n = sum(v for (other, w), v in f.items() if other == lang and len(w) == 1)
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", "z", 7, "n") for i, (t, lang) in enumerate(rows)], SCHEMA)


def invented(seed, n=300):
    pick = np.random.default_rng(seed)
    words = ["the", "of", "new", "york", "City", "ñandú", "漢字", "|", "in", "a-b", "\x1c", "x" * 300, "a", "b"]
    weights = np.array([9, 6, 3, 3, 3, 2, 1, 1, 4, 1, 1, 1, 2, 2], float)
    passage = "we hold these truths to be self evident that all men are created equal"
    rows = []
    for i in range(n):
        made = [words[k] for k in pick.choice(len(words), pick.integers(0, 40), p=weights / weights.sum())]
        text = "".join(w + pick.choice([" ", "  ", "\t", ". ", ", ", "\n", " ", " "]) for w in made)
        rows.append((text + (passage if i % 3 == 0 else ""), [None, "en", "fr", "und"][i % 4]))
    return rows + [(None, "en"), ("", None), (" \t\n", "en"), ("alone", "de"), (passage * 200, "en"), ("a " * 5000, "fr")] + rows[:40]


@pytest.mark.parametrize("short,frequent", [(phrases.SHORT_WORDS, phrases.FREQUENT), (6, 3), (0, 0)])
def test_collocations_equal_plain_counts(spark, monkeypatch, short, frequent):
    """With all words numbered, some of them, and none; with nodes dealt in parts and not."""
    monkeypatch.setattr(phrases, "SHORT_WORDS", short)
    monkeypatch.setattr(phrases, "FREQUENT", frequent)
    rows = invented(3)
    for least, most in ((10, 2000), (3, 5)):
        got = phrases.collocations(frame(spark, rows), least, most)
        assert sorted(map(tuple, got.collect())) == expected(rows, least, most)


def test_hash_collisions_are_seen(spark, monkeypatch):
    """Words whose first hashes are equal get others."""
    right = phrases.hashed
    monkeypatch.setattr(phrases, "hashed", lambda lang, word, seed: -1 if seed < 2 and word in (b"new", b"york") else right(lang, word, seed))
    monkeypatch.setattr(phrases, "SHORT_WORDS", 0)
    rows = [("new york", "en")] * 12
    assert [tuple(r) for r in phrases.collocations(frame(spark, rows)).collect()] == expected(rows, 10, 2000)


def test_large_counts_are_exact(spark):
    big = 9_876_543_210_123
    row = spark.range(1).select(F.lit(big).alias("a"), F.lit(big + 7).alias("l"), F.lit(big + 11).alias("r"))
    got = row.select(phrases._score(F.col("a"), F.col("l"), F.col("r"))).first()[0]
    assert got == 1_000_000 * big * big // ((big + 7) * (big + 11))


def test_paths_hold_every_edge_once(spark):
    """Compact paths are as long as the passage, and their edges are those that were counted."""
    rows = invented(5)
    graph = phrases.build(frame(spark, rows))
    paths = [(list(r.words), r.n) for r in phrases.compact(graph).collect()]
    edges = Counter()
    for words, n in paths:
        for i in range(len(words) - 2):
            edges[tuple(words[i : i + 3])] += n
    assert edges == {(r.a, r.b, r.c): r.f for r in graph.edges.collect()}
    assert max(len(words) for words, _ in paths) >= 12
    names = {r.id: r.word for r in graph.words.collect()}
    assert any("these truths to be self evident" in " ".join(names[w] for w in words) for words, _ in paths)
    nodes = {(r.a, r.b): r.f for r in graph.nodes.collect()}
    for words, n in paths:
        assert all(nodes[tuple(words[i : i + 2])] == n for i in range(1, len(words) - 2))


def test_nothing_to_find(spark):
    assert phrases.collocations(frame(spark, [("a b c", "en")] * 9)).count() == 0
    empty = frame(spark, [("a", "b")]).limit(0)
    got = phrases.collocations(empty)
    assert got.count() == 0 and got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_one_passage_in_every_row(spark):
    """A third of all words in one pair of words, and one text in all rows."""
    rows = [("hot pair " * 5 + f"w{i % 400} hot pair", "en") for i in range(3000)] + [("same text in every row", "en")] * 1000
    got = phrases.collocations(frame(spark, rows).repartition(20))
    assert sorted(map(tuple, got.collect())) == expected(rows, 10, 2000)
