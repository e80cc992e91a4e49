"""Connected components by alternating large-star and small-star rounds (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import BROADCAST_ROWS, Kept


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a vertex is tied to the smallest of its neighbourhood."""
    both = edges.union(edges.select("v", "u").toDF("u", "v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A vertex and its smaller neighbours are tied to the smallest of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Edges (u, v) of different vertices to rows (u, root): the smallest vertex reachable, for each that has an edge.

    Roots have no row of their own. Each round's edges are written to the shared folder and the previous ones removed.
    Where edges are few (BROADCAST_ROWS at most) a round runs as one task, for there is nothing to gain from a shuffle.
    """
    mark = F.xxhash64("u", "v")
    held = Kept(edges.select("u", "v").distinct(), "component-edges", marked=mark)
    for _ in range(rounds):
        now = held.df.coalesce(1) if held.rows <= BROADCAST_ROWS else held.df
        fresh = Kept(_small(_large(now)), "component-edges", marked=mark)
        held.drop()
        if (fresh.rows, fresh.mark) == (held.rows, held.mark):
            return fresh.df.select("u", F.col("v").alias("root"))
        held = fresh
    raise RuntimeError(f"components did not settle in {rounds} rounds")
