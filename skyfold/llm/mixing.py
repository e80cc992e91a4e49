"""Mixing sources to target weights by a time-varying curriculum, with DataFrame operations only.

1. Each source's share of all words follows its weight; a target stops at ``most`` times what the source has, and the
   excess is shared again by weight (water-filling in one pass: sources reach their limit in the order of limit / weight).
2. A source's weight changes over training time u in [0, 1] as 1 + slope * (1 - 2u), which integrates to one: its
   cumulative demand is target * (u + slope * (u - u^2)). Sources with an even rank start heavy, the others end heavy.
3. A source's documents stand in a fixed shuffled order (md5 of the id) and are read again from the start when used up.
   A document's occurrence begins after so many of its source's words; inverting the cumulative demand there gives
   its training position, and documents are range-sorted by it.

Running totals are two-level: totals of (source, bucket of the md5) come first, then running totals inside a bucket.
So a source with a third of all rows is spread over all buckets, and only small sums meet in one task.

Defined results: null text has size 0; size 0 takes nothing; a null source is one source, ordered last; null ids are
documents of their own; rows that repeat id and text are separate copies; an empty table gives no rows; further columns
are kept by ``schedule`` and ignored by ``plan``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import WORD

#: Hex digits of the md5 that make a bucket: 4096 buckets a source.
BUCKET_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, most: int = 3, cycle: tuple[int, ...] = (1, 2, 3), slope: float = 0.5) -> DataFrame:
    """Sizes (source, source_size) with rank, weight, target and slope of each source; null is a source.

    Three running sums over the sources; a row for each source is all that they see.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    limit = F.lit(most).cast("long") * F.col("source_size")
    by_limit = Window.orderBy("_at", "_rank")
    before = by_limit.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_limit.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy("_at", "_rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = F.array(*[F.lit(int(w)) for w in cycle])
    ranked = sizes.withColumn("_rank", F.row_number().over(by_name) - 1)
    ranked = ranked.withColumn("weight", F.element_at(weights, (F.col("_rank") % len(cycle) + 1).cast("int")).cast("long"))
    ranked = ranked.withColumn("_limit", limit).withColumn("_at", F.col("_limit").cast("double") / F.col("weight"))
    ranked = ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_used", F.coalesce(F.sum("_limit").over(before), F.lit(0))).withColumn("_weights", F.sum("weight").over(onward))
    level = (F.col("_total") - F.col("_used")).cast("double") / F.col("_weights")
    ranked = ranked.withColumn("_full", F.col("_at") <= level)
    open_ = F.min(F.when(~F.col("_full"), F.struct("_at", "_rank", "_used", "_weights"))).over(everything)
    ranked = ranked.withColumn("_open", open_)
    shared = F.col("weight") * ((F.col("_total") - F.col("_open._used")).cast("double") / F.col("_open._weights"))
    target = F.when(F.col("_full"), F.col("_limit").cast("double")).otherwise(shared)
    return ranked.select("source", "source_size", F.col("_rank").alias("source_rank"), "weight", target.alias("target"), F.when(F.col("_rank") % 2 == 0, F.lit(slope)).otherwise(F.lit(-slope)).alias("slope"))


def plan(docs: DataFrame, most: int = 3, cycle: tuple[int, ...] = (1, 2, 3), slope: float = 0.5, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """A row for each document: size, source_size, target, taken (words), uses, first_position, and ``begins`` of its source.

    ``carry`` names further columns to keep. Documents of a source that fit into the target's last round are taken
    once more, the one at its end in part, so a source's taken words are its target rounded to whole words.
    """
    from skyfold.llm.common import keep

    rows = docs.select(
        F.col(id_column).cast("long").alias("doc_id"), F.col(source_column).cast("string").alias("source"), word_count(F.col(text_column)).alias("size"),
        F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit(""))).alias("_key"), F.xxhash64(text_column).alias("_tie"), *[F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)],
    ).withColumn("_bucket", F.substring("_key", 1, BUCKET_DIGITS))
    sums = keep(rows.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum")), "mix-sums")
    wanted = targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), most, cycle, slope)
    earlier = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(earlier), F.lit(0))).drop("_sum")
    offsets = offsets.join(wanted, offsets["source"].eqNullSafe(wanted["source"])).drop(wanted["source"]).withColumnRenamed("source", "_s").withColumnRenamed("_bucket", "_b")
    inside = Window.partitionBy("source", "_bucket").orderBy("_key", F.col("doc_id").asc_nulls_last(), "size", "_tie").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_begin", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(offsets, rows["source"].eqNullSafe(offsets["_s"]) & (rows["_bucket"] == offsets["_b"])).withColumn("_begin", F.col("_begin") + F.col("_offset"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor(F.col("target") + 0.5) / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.floor(F.col("target") + 0.5).cast("long") - F.col("_whole") * F.col("source_size")
    part = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("_rest") - F.col("_begin")))
    rows = rows.withColumn("_whole", whole).withColumn("_rest", rest).withColumn("_part", part).withColumn("taken", F.col("_whole") * F.col("size") + F.col("_part"))
    uses = F.when(F.col("size") > 0, F.col("_whole") + (F.col("_part") > 0).cast("long")).otherwise(0)
    rows = rows.withColumn("uses", uses).withColumn("first_position", F.when(F.col("uses") > 0, position(F.col("_begin"), F.col("target"), F.col("slope"))))
    return rows.select("doc_id", "source", "size", "source_size", "target", "taken", "uses", "weight", "slope", F.col("_begin").alias("begins"), F.col("_part").alias("last_words"), F.col("_whole").alias("full_rounds"), "first_position", *[F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)])


def position(begin: Column, target: Column, slope: Column) -> Column:
    """Training time at which a source's cumulative demand reaches ``begin``: the root in [0, 1] of u + s(u - u^2) = begin / target."""
    y = F.least(F.lit(1.0), begin / target)
    b = F.lit(1.0) + slope
    return F.lit(2.0) * y / (b + F.sqrt(F.greatest(F.lit(0.0), b * b - F.lit(4.0) * slope * y)))


def in_order(planned: DataFrame) -> DataFrame:
    """The plan range-sorted by training position; documents that are not taken come last."""
    return planned.orderBy(F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())


def schedule(docs: DataFrame, most: int = 3, cycle: tuple[int, ...] = (1, 2, 3), slope: float = 0.5, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", position_column: str = "_mix_position", words_column: str = "_mix_words") -> DataFrame:
    """The training order: the documents' own columns, a row for each use, range-sorted by position (then id).

    ``words_column`` has the words that this use takes: the size, or less for the last document of a source.
    """
    columns = docs.columns
    packed = docs.select(F.col(id_column).alias("doc_id"), F.col(source_column).alias("source"), F.col(text_column).alias("text"), F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)]).alias("row"))
    planned = plan(packed, most, cycle, slope, carry=("row",)).filter("uses > 0")
    each = planned.withColumn("_round", F.explode(F.sequence(F.lit(0).cast("long"), F.col("uses") - 1)))
    at = position(F.col("begins") + F.col("_round") * F.col("source_size"), F.col("target"), F.col("slope"))
    words = F.when(F.col("_round") < F.col("full_rounds"), F.col("size")).otherwise(F.col("last_words"))
    each = each.select(at.alias("_p"), words.alias("_w"), "doc_id", "row").orderBy("_p", "doc_id", "_w")
    return each.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(columns)], F.col("_p").alias(position_column), F.col("_w").alias(words_column))
