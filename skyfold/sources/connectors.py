"""Connectors on the Python Data Source API: snapshot files, and source catalogues fetched by the tasks.

    spark.dataSource.register(Snapshots)
    spark.read.format("snapshot").option("pushdown", True).load(folder).filter("t >= 1.7e9 and file = 'a.json'")

With the option pushdown, and ``spark.sql.python.filterPushdown.enabled`` in the session, filters reach the reader: those on ``file`` and ``datestr`` leave partitions
out before any task starts, those on ``t`` leave a file's times out before their rows are made, and the elevation goes into the
request. Spark applies the filters again where the reader only narrows.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from skyfold.sources.files import listed, read_bytes, store

VISIBILITIES = "file string, t double, a1 int, a2 int, re double, im double, flag boolean, w double, freq double, pol string"
ENTRIES = "datestr string, name string, el double, az double, jy double, r double"


class Part(InputPartition):
    """One file, or one date."""

    def __init__(self, value: str) -> None:
        self.value = value


def _only(filters: list[Filter], column: str) -> tuple[set | None, list[Filter]]:
    """The values that filters leave of a column, None for all; and the filters that are not on it."""
    left, rest = None, []
    for f in filters:
        values = ({f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None) if f.attribute == (column,) else None
        if values is None:
            rest.append(f)
        else:
            left = values if left is None else left & values
    return left, rest


class Snapshots(DataSource):
    """A row for each baseline of each time, as sources.snapshot.visibilities gives it; a partition for each file, in the order of names.

    Options: path; suffix (.json). A folder without a snapshot is an error, and so is a file that cannot be read.
    """

    @classmethod
    def name(cls) -> str:
        return "snapshot"

    def schema(self) -> str:
        return VISIBILITIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedSnapshots if self.options.get("pushdown", "").lower() == "true" else SnapshotReader)(self.options)


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.suffix = options["path"], options.get("suffix", ".json")
        self.files: set | None = None
        self.low, self.high = float("-inf"), float("inf")

    def partitions(self) -> list[Part]:
        names = listed(self.path, self.suffix)
        if not names:
            raise FileNotFoundError(f"no snapshot *{self.suffix} in {self.path}")
        return [Part(n) for n in names if self.files is None or self._short(n) in self.files] or [Part("")]

    def _short(self, name: str) -> str:
        return name[len(store(self.path)[1].rstrip("/")) + 1 :]

    def read(self, partition: Part) -> Iterator:
        from datetime import UTC, datetime

        import numpy as np
        import pyarrow as pa

        if not partition.value:
            return
        snap = json.loads(read_bytes(self.path, partition.value))
        pairs, gains = np.array(snap["baselines"], np.int32).reshape(-1, 2), np.array(snap["gains"], float)
        dead, n = (gains[pairs] == 0).any(1), len(pairs)
        freq = json.loads(snap["config"]).get("frequency")
        for stamp, row in zip(snap["timestamp"], snap["vis"], strict=True):
            at = datetime.fromisoformat(stamp.replace("Z", "+00:00"))
            t = (at if at.tzinfo else at.replace(tzinfo=UTC)).timestamp()
            if self.low <= t <= self.high and n:
                vis = np.array(row, float).reshape(-1, 2)
                columns = [[self._short(partition.value)] * n, np.full(n, t), pairs[:, 0], pairs[:, 1], vis[:, 0], vis[:, 1], dead, np.where(dead, 0.0, 1.0), pa.array([freq] * n, pa.float64()), ["RR"] * n]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in VISIBILITIES.split(", ")])


class PushedSnapshots(SnapshotReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        self.files, rest = _only(filters, "file")
        for f in rest:
            if f.attribute == ("t",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value)
            if f.attribute == ("t",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value)
            yield f


class Catalogues(DataSource):
    """Sources above an elevation at the dates of a run; a partition, one request with retries, for each date.

    Options: url with {datestr}, {lat}, {lon}, {elevation}; dates (JSON list); lat, lon, elevation; tries, pause.
    """

    @classmethod
    def name(cls) -> str:
        return "catalogue"

    def schema(self) -> str:
        return ENTRIES

    def reader(self, schema: StructType) -> DataSourceReader:
        return (PushedCatalogues if self.options.get("pushdown", "").lower() == "true" else CatalogueReader)(self.options)


class CatalogueReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options, self.dates = options, None
        self.elevation = float(options.get("elevation", "0"))

    def partitions(self) -> list[Part]:
        dates = sorted(set(json.loads(self.options["dates"])))
        return [Part(d) for d in dates if self.dates is None or d in self.dates] or [Part("")]

    def read(self, partition: Part) -> Iterator[tuple]:
        from urllib.parse import quote
        from urllib.request import urlopen

        if not partition.value:
            return
        o, tries = self.options, int(self.options.get("tries", "5"))
        url = o["url"].format(datestr=quote(partition.value), lat=o.get("lat", ""), lon=o.get("lon", ""), elevation=self.elevation)
        for n in range(tries):
            try:
                with urlopen(url, timeout=60) as answer:  # noqa: S310
                    found = json.load(answer)
                break
            except OSError:
                if n == tries - 1:
                    raise RuntimeError(f"no catalogue for {partition.value} after {tries} tries") from None
                time.sleep(float(o.get("pause", "0.1")) * 2**n)
        for s in found:
            if s["el"] >= self.elevation:
                yield (partition.value, s["name"], float(s["el"]), float(s["az"]), float(s["jy"]), float(s["r"]))


class PushedCatalogues(CatalogueReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        self.dates, rest = _only(filters, "datestr")
        for f in rest:
            if f.attribute == ("el",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.elevation = max(self.elevation, f.value)
            yield f
