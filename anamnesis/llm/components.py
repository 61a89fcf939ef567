"""Connected components of an edge table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.common import durable


#: A node with over this part of all edges is hot; there are at most so many.
HOT = 1000


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` with ``m``, by ``a``, from ``least`` (``a, m, n``). The few hot nodes' numbers go to all tasks, so
    that a hot node's edges stay where they are."""
    is_hot = F.col("n") * HOT > total
    marked = edges.join(F.broadcast(least.where(is_hot).select("a", F.col("m").alias("_m"))), "a", "left")
    cold = marked.where("_m IS NULL").drop("_m").join(least.where(~is_hot).select("a", "m"), "a")
    return cold.unionByName(marked.where("_m IS NOT NULL").withColumnRenamed("_m", "m"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a long, b long``); the root is the
    component's smallest node.

    Rounds of large-star and small-star steps: each joins a node's neighbours to the
    smallest of them. A step's aggregates combine before they shuffle, and hot nodes are
    joined by a broadcast. Every round is checkpointed; rounds grow with the logarithm of
    the longest path.
    """
    now = durable(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, total = None, now.count()
    while True:
        # large star: every larger neighbour goes to the smallest of a node and its neighbours
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("n"))
        large = _with_least(both, least, total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a != b").distinct()
        # small star: every smaller neighbour, and the node, go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        joined = _with_least(large, least, total)
        small = joined.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = durable(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before, total = state, state[0]
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
