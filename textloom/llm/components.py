"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import dropped, written


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star. ``edges``: (a, b) with a > b, distinct."""
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    lows = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    # large star: each larger neighbour of a node moves to the least of the node's neighbourhood
    large = (
        both.where(F.col("b") > F.col("a"))
        .join(lows, "a")
        .select(F.col("b").alias("a"), F.col("low").alias("b"))
        .distinct()
    )
    # small star: each smaller neighbour and the node itself move to the least one
    lows = large.groupBy("a").agg(F.min("b").alias("low"))
    return (
        large.join(lows, "a")
        .select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        .distinct()
    )


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node with an edge; root is the smallest node reachable.

    Edges are undirected; loops, repeats and null ends are ignored. Every round is a
    written table, and only two sums of it reach the driver. Nodes without an edge
    to another node are not in the result. An empty edge table gives an empty one.
    """
    a, b = F.col(left), F.col(right)
    now = written(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b))
        .select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
        .distinct(),
        "edges",
    )
    seen = None
    for _ in range(max_rounds):
        # a sum of hashes is the same for equal sets of edges, whatever their order
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        then = written(_star(now), "edges")
        dropped(now)
        now = then
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots)
