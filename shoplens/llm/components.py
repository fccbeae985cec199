"""Connected components of an edge list too large for one machine: alternating large and small stars.

In a large star, the greater neighbours of a vertex are tied to the smallest vertex of its neighbourhood; in
a small star, its smaller neighbours and itself are. Repeated in turn, every component becomes one star around
its smallest vertex. The minimum of a neighbourhood is a combined aggregate and comes back by a counted broadcast or, with
many vertices, by a salted join; no neighbourhood is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoplens.llm.shared import attach, checkpointed


def _tied(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the smallest vertex of a's neighbourhood, a included, as low."""
    low = checkpointed(edges.groupBy(F.col("a").alias("of")).agg(F.min(F.least("a", "b")).alias("low")))
    return attach(edges, low, "a", "of", "b")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _tied(both).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    tied = _tied(down)
    return (tied.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(tied.select("a", F.col("low").alias("b"))))


def components(edges: DataFrame) -> DataFrame:
    """vertex, component (its smallest vertex) of every vertex that has an edge to another vertex.

    edges: two columns a, b of integers without nulls; repeated edges and loops change nothing.
    """
    state, edges = None, checkpointed(edges.select("a", "b").where("a <> b").distinct())
    while True:
        edges = checkpointed(_small_star(checkpointed(_large_star(edges).distinct())).where("a <> b").distinct())
        found = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if found == state:
            break
        state = found
    roots = edges.select(F.col("b").alias("vertex"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("vertex"), F.col("b").alias("component")).unionByName(roots)
