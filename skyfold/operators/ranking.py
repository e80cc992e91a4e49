"""Exact global ranks without a task that sees all rows, and what rests on them: quantiles and the Benjamini-Hochberg rule.

Rows are range-partitioned by value and sorted inside their partitions; one count a partition gives each partition's
offset, so a row's rank is that offset and its place in its own partition. Nothing but the counts meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.session import stored

#: Bits of monotonically_increasing_id that count inside a partition.
INSIDE = 33


def ranked(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """rows with their rank from 1 in ascending order, nulls first; equal rows stand in any order. The sorted rows are stored,
    for places are of one run alone."""
    at = F.monotonically_increasing_id()
    placed = stored(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.shiftright(at, INSIDE).cast("int")).withColumn("_at", at.bitwiseAND(F.lit((1 << INSIDE) - 1))), "ranked")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    return placed.join(counts.select("_part", before.alias("_before")), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each name the interpolated quantile of the values that are not null; null where there are none."""
    own = ranked(rows.select(F.col(value).cast("double").alias("v")).filter("v is not null"), "v")
    place = own.crossJoin(F.broadcast(own.agg(F.count("*").alias("n"))))
    picks = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("n") - 1)
        low, high = (F.max(F.when(F.col("rank") - 1 == f(at), F.col("v"))) for f in (F.floor, F.ceil))
        picks.append((low + (high - low) * F.max(at - F.floor(at))).alias(name))
    return place.agg(*picks)


def benjamini_hochberg(rows: DataFrame, p: str, share: float) -> DataFrame:
    """The rows that are found at a false discovery rate of ``share``: p up to the largest p(k) with p(k) <= k share / m."""
    own = ranked(rows.filter(F.col(p).isNotNull()), p, name="_rank")
    m = own.agg(F.count("*").alias("_m"))
    cut = own.crossJoin(F.broadcast(m)).filter(F.col(p) <= F.col("_rank") * share / F.col("_m")).agg(F.max(p).alias("_cut"))
    return own.crossJoin(F.broadcast(cut)).filter(F.col(p) <= F.col("_cut")).drop("_rank", "_cut")
