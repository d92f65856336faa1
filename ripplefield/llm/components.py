"""Connected components by alternating large-star and small-star rounds, after the published algorithm.

Each round is two partial/final minima and two joins over the edges; edges never leave the executors.
The number of rounds grows with the logarithm of the longest path, and every round is cut off its
lineage by a checkpoint in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplefield.llm.common import cut


def _least(edges: DataFrame) -> DataFrame:
    """Least neighbour of every left end."""
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the least of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("m", "a").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Link every node and its smaller neighbours to the least of these."""
    least = _least(edges)
    linked = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return linked.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of an edge: the root is the least node reachable.

    Edges may repeat, run both ways or be loops.  Raises ``RuntimeError`` if the rounds don't settle.
    """
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x != y")
    stars = cut(ends.select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct())
    digest = None
    for _ in range(most_rounds):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == digest or now[0] == 0:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
        digest, stars = now, cut(_small_star(_large_star(stars)))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
