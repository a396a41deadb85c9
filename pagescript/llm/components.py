"""Connected components of a graph of ids by alternating stars; the graph never leaves Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of an edge reaches. Edges have no direction; loops and repeats do no harm.

    Each round hangs every vertex's larger neighbours, then its smaller ones, on the smallest. The least neighbour is a
    pre-aggregated minimum that is joined back, so a vertex of very many edges is split like any skewed join. Rounds grow with the
    logarithm of the longest path. Each round's edges are written to the shared folder.
    """
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u AND v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        at = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(at) == state:
            break
        state = tuple(at)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    own = now.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own).distinct()
