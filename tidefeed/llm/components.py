"""Connected components of a stored graph by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidefeed.llm.text import checked_broadcast
from tidefeed.session import written

EDGES_IN_FILE = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _with_least(edges: DataFrame, both: bool, parts: int) -> DataFrame:
    """Edges (u, v) with the least neighbour of u; ``both`` adds every edge turned round."""
    pairs = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if both:
        pairs = pairs.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = written(pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(parts), "least")
    return pairs.join(checked_broadcast(least), "u")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) of every node of an edge: component is the least id that can be reached.

    Each step writes a graph with no more edges than the one before, so a hub costs what its edges
    cost. Edges may repeat, point either way or be loops; loops alone make no node.
    """
    graph = written(
        edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct(), "graph")
    state = _state(graph)
    # No step makes more edges than there are now, so files of about this many rows stay that small.
    parts = 1 + state[0] // EDGES_IN_FILE
    while state[0]:
        near = _with_least(graph, True, parts).withColumn("m", F.least("u", "m"))
        graph = written(
            near.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct().coalesce(parts), "large")
        down = _with_least(graph, False, parts)
        graph = written(
            down.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b"))
            .unionByName(down.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct().coalesce(parts), "small")
        before, state = state, _state(graph)
        if state == before:
            break
    nodes = graph.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.unionByName(graph.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
