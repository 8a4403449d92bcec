"""Connected components of an undirected graph, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialise


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): component is the smallest node reachable. Only nodes with an edge appear; null ends and
    self-loops are ignored, repeated edges count once, an empty table gives an empty table.

    Alternating large and small stars: each round links every node's neighbours to the smallest of them, so the number
    of rounds grows with the logarithm of the longest path. Only minima are aggregated, no neighbour list is collected,
    and each round is written to the shared folder. The minima are written too: both sides of their join then are plain
    shuffles, and adaptive execution can split the rows of a node with very many neighbours."""
    pairs = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    links = materialise(pairs, "links")
    state = _state(links)
    while state[0]:
        links = materialise(_small_star(_large_star(links)), "links")
        last, state = state, _state(links)
        if state == last:
            break
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _state(links: DataFrame) -> tuple:
    """Rows and an order-free digest: equal to the last round's when the stars are stable."""
    row = links.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("x")).first()
    return row.n, row.x


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = materialise(links.groupBy("u").agg(F.min("v").alias("m")), "minima")
    moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()
