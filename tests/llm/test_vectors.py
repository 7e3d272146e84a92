"""Exact search against all products in whole numbers, the bounds, and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidefeed.llm import vectors

SCHEMA = "vec_id long, embedding array<double>, id long, v string, score string, query_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "v", "s", "q") for i, v in rows], SCHEMA)


def expected(rows, is_query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows
              if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in usable:
        if is_query(i):
            scored = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j) for j, v in usable if j != i and len(v) == len(q))
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(spark, rows, k=5):
    got = vectors.top_k(frame(spark, rows), F.col("vec_id") % 5 == 0, k)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted(map(tuple, got.collect()))


def invented(seed, n, dim, kinds=7):
    pick = np.random.default_rng(seed)
    centres = pick.normal(size=(kinds, dim))
    return [(i, (centres[i % kinds] + pick.normal(size=dim) * 0.3).tolist()) for i in range(n)]


@pytest.mark.parametrize("dim", [1, 3, 5, 64, 100])
def test_equals_all_products(spark, dim):
    rows = invented(dim, 600, dim)
    assert found(spark, rows) == expected(rows, lambda i: i % 5 == 0, 5)


def test_blocks_and_groups(spark, monkeypatch):
    """Many groups of queries, many blocks, few seeds: the same rows."""
    for name, value in (("BLOCK_BYTES", 2000), ("GROUP_BYTES", 8000), ("SEEDS", 3), ("QUERIES", 7), ("ROWS", 11), ("PAIRS", 13)):
        monkeypatch.setattr(vectors, name, value)
    rows = invented(2, 300, 20)
    assert found(spark, rows, 3) == expected(rows, lambda i: i % 5 == 0, 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [0.0, 0.0]), (6, [1.0, 2.0]),
            (7, [1.0, 2.0]), (8, [1.0, 2.0, 3.0]), (10, [3.0, 1.0, 2.0]), (None, [9.0, 9.0]), (15, []), (16, []), (17, []), (20, [-1.0, -0.001])]
    assert found(spark, rows) == expected(rows, lambda i: i % 5 == 0, 5)
    assert found(spark, [(5, [1.0])]) == []
    assert found(spark, [(1, [1.0]), (2, [2.0])]) == []
    assert vectors.top_k(frame(spark, rows).limit(0), F.col("vec_id") % 5 == 0).count() == 0


def test_repeated_rows_and_ties(spark):
    """Thousands of equal vectors: the smallest ids win, and repeated rows are counted each."""
    rows = [(i, [0.5, 0.25, -0.125]) for i in range(2000)] + [(5, [0.5, 0.25, -0.125]), (3, [0.5, 0.25, -0.125])]
    got = found(spark, rows)
    assert got == expected(rows, lambda i: i % 5 == 0, 5)


def test_whole_numbers_beyond_doubles(spark):
    """Products over 2 ** 53 keep their last digits; beyond 64 bits they are an error."""
    rows = [(i, [2.0 ** 21 + i / 256, 2.0 ** 19 + 3 * i / 256, 1 / 256]) for i in range(40)]
    assert found(spark, rows) == expected(rows, lambda i: i % 5 == 0, 5)
    with pytest.raises(Exception, match="64 bits"):
        found(spark, [(0, [1e30, 1.0]), (1, [1e30, 2.0])])


def test_bounds_hold_and_prune():
    pick = np.random.default_rng(4)
    base = np.repeat(pick.normal(size=(50, 8)), 8, axis=1) * 200
    q, v = (np.floor(base[pick.integers(0, 50, n)] + pick.normal(size=(n, 64)) * 20) for n in (40, 3000))
    exact = q @ v.T
    for n in vectors.LEVELS:
        bound = vectors.features(q, n) @ vectors.features(v, n).T
        distance = (q * q).sum(1)[:, None] + (v * v).sum(1) - 2 * bound
        assert (bound >= exact - 1e-6).all()
        assert (distance <= ((q[:, None] - v[None]) ** 2).sum(2) + 1e-6).all()
    least = np.sort(exact, axis=1)[:, -5]
    sides = vectors._Side(np.arange(40) + 10_000, q), vectors._Side(np.arange(3000), v)
    at, of, score = vectors.survivors(*sides, least)
    assert sorted(zip(at.tolist(), of.tolist(), strict=True)) == [tuple(x) for x in np.argwhere(exact >= least[:, None]).tolist()]
    assert (score == exact[at, of]).all()
    # The finest bound leaves few pairs to be computed.
    assert (vectors.features(q, 16) @ vectors.features(v, 16).T >= least[:, None]).mean() < 0.3
