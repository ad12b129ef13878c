"""Connected components by distributed union-find on an edge table.

Rounds of two steps, each a grouped minimum and a join: every node's larger
neighbours are tied to its least neighbour, then its smaller ones are. Edges never
outgrow the table, a hub is a minimum rather than a list, and the end are stars, one
around the least member of each component. Each round is written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftspan.plans.storage import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (u, v); root is the least member.

    Nodes may be of any type that orders. Loops and repeated links do no harm; a
    table without links gives no rows.
    """
    lower = F.least("u", "v")
    edges = links.select(F.greatest("u", "v").alias("u"), lower.alias("v")).filter(F.col("u") != F.col("v")).distinct()
    edges = materialise(edges, "edges")
    for _ in range(rounds):
        if _are_stars(edges):
            break
        edges = materialise(_small_star(_large_star(edges)), "edges")
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node is tied to one other, which is itself tied to none."""
    ties = edges.select(F.col("u").alias("n"), F.lit(1).alias("up")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("up")))
    mixed = ties.groupBy("n").agg(F.sum("up").alias("ups"), F.min("up").alias("least")).filter("ups > 1 or (ups = 1 and least = 0)")
    return mixed.limit(1).count() == 0


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.withColumnRenamed("m", "v")).distinct()
