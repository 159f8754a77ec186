"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from proseplane.llm.common import cut


def _starred(edges: DataFrame, small: bool) -> DataFrame:
    """One step; edges (a, b) are distinct and a > b."""
    both = edges if small else edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    joined = both.join(least, "a")
    if small:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    else:
        moved = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.where("a != b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """For edges (u, v): (node, root) of every node of an edge; the root is the least node of its component.

    Each step is checkpointed, so a lost executor costs one step. Loops and repeated edges are allowed.
    """
    now = cut(edges.where("u != v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    seen = None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen or state[0] == 0:
            break
        seen = state
        now = cut(_starred(_starred(now, small=False), small=True))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
