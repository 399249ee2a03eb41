"""Connected components by alternating stars, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) -> (node, component): component is the smallest node reachable; nodes without an edge to another are absent.

    Each round points all larger neighbours of a node to its smallest one (large star), then all smaller ones
    (small star), until each node points to its component; rounds grow with the logarithm of the longest path. Minima are pre-aggregated
    before the shuffle and joined back, and each half round is written, so a node with very many edges can be split.
    Null ends are ignored, repeated and reversed edges count once. Raises if ``max_rounds`` (enough for paths of 2 ** 30 nodes) don't suffice.
    """
    a, b = F.col("a"), F.col("b")
    e = staged(edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(b.alias("a"), a.alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), a).alias("m"))
        large = both.where(b > a).join(least, "a").select(b.alias("a"), F.col("m").alias("b")).where(a != b).distinct()
        large = staged(large, "cc-edges")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where(b != F.col("m")).select(F.greatest(b, F.col("m")).alias("a"), F.least(b, F.col("m")).alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        e = staged(small, "cc-edges")
        now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.count_distinct("a")).first())
        if now == before or now[0] == now[2] and not e.join(e.select(a.alias("b")).distinct(), "b", "left_semi").limit(1).count():
            break
        before = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    return e.select(a.alias("node"), b.alias("component")).unionByName(e.select(b.alias("node"), b.alias("component")).distinct())
