"""Source catalogues: fetched with retries, cached as a table keyed by site and elevation, joined to frames."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "datestr string, name string, el double, az double, jy double, r double"
CACHE = SCHEMA + ", lat double, lon double, elevation double"


def fetch_with_retry(fetch: Callable[[str], list[dict]], datestr: str, tries: int = 5, pause: float = 0.1) -> list[dict]:
    for n in range(tries):
        try:
            return fetch(datestr)
        except OSError:
            time.sleep(pause * 2**n)
    raise RuntimeError(f"no catalogue for {datestr} after {tries} tries")


def lookup(spark: SparkSession, cache: DataFrame, datestrs: Iterable[str], lat: float, lon: float, elevation: float, fetch: Callable[[str], list[dict]], tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(entries, fetched rows to append to the cache). Only dates that the cache lacks for this site are fetched."""
    wanted = spark.createDataFrame([(d,) for d in datestrs], "datestr string").distinct()
    same = (F.abs(F.col("lat") - lat) <= tolerance) & (F.abs(F.col("lon") - lon) <= tolerance) & (F.abs(F.col("elevation") - elevation) <= tolerance)
    held = cache.filter(same)
    missing = [r.datestr for r in wanted.join(held.select("datestr").distinct(), "datestr", "left_anti").collect()]  # dates of one run
    rows = [(d, s["name"], float(s["el"]), float(s["az"]), float(s["jy"]), float(s["r"]), lat, lon, elevation) for d in missing for s in fetch_with_retry(fetch, d) if s["el"] >= elevation]
    fresh = spark.createDataFrame(rows, CACHE)
    names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
    return held.join(wanted, "datestr", "left_semi").select(*names).unionByName(fresh.select(*names)), fresh
