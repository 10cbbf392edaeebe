"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.session import checkpoint, release


def _met(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least of u's neighbourhood. ``least`` is a written table, so that both sides of the join
    are plain exchanges and adaptive execution can split the edges of a hub."""
    return edges.join(least, F.col("u") == F.col("w"))


def _largest(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Every neighbour above a node points to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), 2 * n)
    joined = _met(both.filter("v > u"), least)
    return joined.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), least


def _smallest(edges: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """A node and its neighbours below it point to the least of them. Every edge here leads downwards."""
    least = checkpoint(edges.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m")), n)
    below = _met(edges, least).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return below.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), least


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, component) of every node of edges (u, v): component is the least id that the node reaches. ``rows`` is a bound of
    the edges, where one is known.

    Both steps are a grouped minimum, combined before the shuffle, and a join whose hot keys adaptive execution can
    split. The loop ends when a round changes nothing, after a few rounds for stars and log-many for chains; each round
    deletes the tables of the one before.
    """
    down = edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    state, seen = checkpoint(down, rows), None
    while True:
        mark = state.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if seen == mark or not mark.n:
            break
        seen = mark
        # Neither step makes more edges than there are nodes and edges before it.
        large, by_large = _largest(state, mark.n)
        large = checkpoint(large, 2 * mark.n)
        small, by_small = _smallest(large, mark.n)
        after = checkpoint(small, 2 * mark.n)
        release(state, by_large, large, by_small)
        state = after
    nodes = state.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return nodes.union(nodes.select(F.col("component").alias("id"), "component").distinct())
