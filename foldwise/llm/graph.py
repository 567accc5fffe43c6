"""Connected components of a link table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldwise.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest node it knows to its larger neighbours."""
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node points its smaller neighbours and itself to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(id, root)`` for every node of ``links(u, v)``; root is the smallest id reachable.

    Both star steps aggregate before they join, so a node with very many
    neighbours is one partial minimum per task; the joins are plain equi-joins
    whose large partitions adaptive execution splits.
    """
    edges = stored(links.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while True:
        # A star forest: every node has one parent and no parent has a parent.
        state = edges.groupBy("u").agg(F.count("*").alias("n"))
        several = state.where("n > 1").limit(1).count()
        chained = several or edges.join(edges.select(F.col("u").alias("v")), "v", "left_semi").limit(1).count()
        if not chained:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionAll(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        edges = stored(_small_star(_large_star(edges)), "edges")
