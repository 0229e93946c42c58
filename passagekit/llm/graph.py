"""Connected components over an edge table, by alternating star contraction.

Every round is two partial aggregations and two joins; no adjacency list is ever gathered, so a
hub that touches a third of all nodes costs partial sums on its key and a join that adaptive
execution may split. Nothing but one number a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from passagekit.runtime import cut


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step. edges: u > v."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = edges.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
    large = large.filter("u > v")
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return small.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node but the roots hangs on one root: no node has two parents, or a parent and a child."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 or up = 1 and down = 1")
    return seen.agg(F.count("*").alias("n")).first().n == 0


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges (a long, b long) -> (node long, root long): every node that has an edge, with the
    smallest node it reaches. Self-loops and nulls are ignored; repeated edges count once; an empty
    table gives an empty table. Raises if max_rounds does not suffice (rounds grow with the
    logarithm of the longest chain)."""
    e = edges.filter("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    e = cut(e.filter("u > v").distinct())
    for _ in range(max_rounds):
        if _settled(e):
            break
        e = cut(_stars(e))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
