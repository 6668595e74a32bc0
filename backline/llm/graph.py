"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _to_minimum(pairs: DataFrame) -> DataFrame:
    """(u, v) with the least of u and all its v's as ``m``; a hot u is joined, not gathered."""
    least = pairs.groupBy("u").agg(F.min("v").alias("_m"))
    return pairs.join(least, "u").select("u", "v", F.least("u", "_m").alias("m"))


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(a, b) edges of bigint nodes to (node, root): every node of an edge and the least node of its component.

    Each round contracts the graph; rounds grow with the logarithm of the number of nodes. Round
    results are written to the shared store, which cuts the lineage.
    """
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    stars, mark = materialise(stars), None
    for _ in range(most_rounds):
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_minimum(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        near = _to_minimum(large)
        small = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
        stars = materialise(small.where("u <> v").distinct())
        now = tuple(stars.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
