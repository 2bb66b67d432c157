"""Connected components by alternating large and small stars, on executors only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumiveil.llm.common import join_by_count, settle, sweep


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """node and root (the least node it reaches) of every node that has an edge to another.

    Self-links, repeated and reversed edges and nulls do no harm; no edges give no rows.  A star's
    minimum is aggregated map-side and joined back to the edges; a node with very many neighbours
    leaves that join's shuffle, so that they are never gathered in a task.  Each round is settled in
    the shared folder, and what the rounds before have shuffled is let go.
    """
    x, y = F.col(a), F.col(b)
    star = settle(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct())
    for _ in range(max_rounds):
        both = star.union(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = settle(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"))
        large = settle(join_by_count(both.where("v > u"), least, "u", "n").select(F.col("v").alias("u"), F.col("m").alias("v")))
        parent = settle(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_by_count(large, parent, "u", "n").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(parent.select("u", F.col("m").alias("v")))
        star = settle(small.distinct())
        del both, least, large, parent, small
        sweep(edges.sparkSession)
        child = star.groupBy("u").count()
        wrong = child.where("count > 1").select("u").union(star.select(F.col("v").alias("u")).join(child.select("u"), "u", "left_semi"))
        if wrong.isEmpty():
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).union(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
