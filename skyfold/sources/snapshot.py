"""Raw snapshots, read as files that any store of Spark may hold.

A snapshot is a JSON file (one a minute of data) with the fields of the raw format: config (a JSON string), timestamp,
baselines, vis as [re, im] pairs, gains, phases. Each file is a partition; a row is one baseline of one time. Baselines
that touch an antenna of zero gain are flagged, and their weight is 0.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SCHEMA = "file string, timestamp array<string>, config string, baselines array<array<int>>, vis array<array<array<double>>>, gains array<double>, phases array<double>"
CONFIG = "name string, frequency double, lat double, lon double, alt double, num_antenna int"


def read_snapshots(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """A row for each file. Spark reads the files, so any store it knows will do; an empty folder is an error."""
    files = spark.read.option("pathGlobFilter", pattern).option("wholetext", True).text(folder).select(F.input_file_name().alias("file"), F.from_json("value", StructType.fromDDL(SCHEMA.replace("file string, ", ""))).alias("s"))
    if files.isEmpty():
        raise FileNotFoundError(f"no snapshot matches {pattern} in {folder}")
    return files.select("file", "s.*")


def visibilities(snapshots: DataFrame) -> DataFrame:
    """file, t (unix seconds, UTC), a1, a2, re, im, flag, w, chan frequency and polarisation label of every visibility."""
    times = snapshots.select("file", "baselines", "gains", F.from_json("config", CONFIG).alias("c"), F.posexplode("timestamp").alias("k", "stamp"), "vis")
    each = times.select("file", "gains", "c", "stamp", F.posexplode("baselines").alias("b", "pair"), F.get("vis", F.col("k")).alias("row"))
    z = F.get("row", F.col("b"))
    dead = (F.get("gains", F.get("pair", F.lit(0))) == 0) | (F.get("gains", F.get("pair", F.lit(1))) == 0)
    t = F.unix_micros(F.to_timestamp("stamp")) / 1e6
    return each.select("file", t.alias("t"), F.get("pair", F.lit(0)).alias("a1"), F.get("pair", F.lit(1)).alias("a2"), F.get(z, F.lit(0)).alias("re"), F.get(z, F.lit(1)).alias("im"), dead.alias("flag"), F.when(dead, 0.0).otherwise(1.0).alias("w"), F.col("c.frequency").alias("freq"), F.lit("RR").alias("pol"))


def gains(snapshots: DataFrame) -> DataFrame:
    """file, antenna, amplitude, phase, complex gain, and whether the antenna is dead."""
    rows = snapshots.select("file", F.posexplode(F.arrays_zip("gains", "phases")).alias("a", "g"))
    return rows.select("file", "a", F.format_string("ant%02d", "a").alias("name"), F.col("g.gains").alias("amp"), F.col("g.phases").alias("ph"), (F.col("g.gains") * F.cos("g.phases")).alias("re"), (F.col("g.gains") * F.sin("g.phases")).alias("im"), (F.col("g.gains") == 0).alias("dead"))


def frames(vis: DataFrame, nframes: int | None = None) -> DataFrame:
    """file, t and frame number in file order, then time order; at most nframes of them, wherever files end."""
    from pyspark.sql import Window

    times = vis.select("file", "t").distinct()
    numbered = times.withColumn("frame", F.row_number().over(Window.orderBy("file", "t")) - 1)  # a row for each time
    return numbered if nframes is None else numbered.filter(F.col("frame") < nframes)


def write_snapshot(path: str, stamps: list[str], baselines: list[tuple[int, int]], vis: list[list[complex]], gain: list[float], phase: list[float], config: dict) -> None:
    """One snapshot file, for tests and small exports."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"config": json.dumps(config), "timestamp": stamps, "baselines": baselines, "vis": [[[z.real, z.imag] for z in row] for row in vis], "gains": gain, "phases": phase}, f)


def rows_of(snapshot: dict) -> Iterator[tuple]:
    """The plain version of ``visibilities`` for one parsed file."""
    from datetime import UTC, datetime

    for stamp, row in zip(snapshot["timestamp"], snapshot["vis"], strict=True):
        t = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
        t = t if t.tzinfo else t.replace(tzinfo=UTC)
        for (a, b), z in zip(snapshot["baselines"], row, strict=True):
            dead = snapshot["gains"][a] == 0 or snapshot["gains"][b] == 0
            yield t.timestamp(), a, b, z[0], z[1], dead
