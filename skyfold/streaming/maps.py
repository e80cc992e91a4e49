"""Regularised maps of a stream of frames: each solve starts from the map of the frame before."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyfold.operators.solve import PHASE_BYTES, frame_columns, frame_of, grid_of, regularised
from skyfold.session import fresh_folder, with_conf

MAPS = "run long, frame int, pix int, regularised double, dirty double, steps int, late boolean"


class WarmMaps(StatefulProcessor):
    """The last map of a run and the number of its last frame, across micro-batches and restarts.

    Frames are solved in order. One without weight gives zeros and leaves the state as it is, and so does a state that is
    not finite. A frame that is not after the last one has come too late: one row says so, and nothing is solved.
    """

    def __init__(self, pix: np.ndarray, s: np.ndarray, freq: float, eta: float, diameter: float | None, tol: float, budget: int, warm: bool) -> None:
        self.pix, self.s, self.freq, self.eta, self.diameter, self.tol, self.budget, self.warm = pix, s, freq, eta, diameter, tol, budget, warm

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("map", "x binary, frame int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        table = pd.concat(list(rows))
        before, last = None, None
        if self.state.exists():
            raw, last = self.state.get()
            before = np.frombuffer(raw, float)
        for number, own in table.groupby("frame"):
            number = int(number)
            if last is not None and number <= last:
                yield pd.DataFrame({"run": [key[0]], "frame": [number], "pix": [None], "regularised": [None], "dirty": [None], "steps": [None], "late": [True]})
                continue
            own, steps, last = own.sort_values(list(own.columns)), [], number
            frame, seen = frame_of(own, self.s, self.freq, self.diameter, self.budget)
            sound = before is not None and len(before) == len(self.pix) and np.isfinite(before).all()
            x, dirty = regularised(frame, seen, self.eta, before if sound and self.warm else None, self.tol, steps=steps)
            if frame.w.sum():
                before = x
            yield pd.DataFrame({"run": key[0], "frame": number, "pix": self.pix, "regularised": x, "dirty": dirty, "steps": steps[0] if steps else 0, "late": False})
        if last is not None:
            self.state.update(((before if before is not None else np.zeros(0)).tobytes(), last))

    def close(self) -> None:
        pass


def warm_maps(stream: DataFrame, pixels: DataFrame, freq: float = 1575420000.0, eta: float = 1e-2, diameter: float | None = None, tol: float = 1e-5, budget: int = PHASE_BYTES, warm: bool = True) -> DataFrame:
    """stream(run, frame, re, im, w, bx, by_, bz[, freq][, zx, zy, zz]) to MAPS rows; a micro-batch holds whole frames.

    A run is one key, for each map starts from the one before; runs (sites, nights, bands) are solved side by side. A
    task holds one frame's phases in tiles of ``budget`` bytes and one map.
    """
    pix, s = grid_of(pixels)
    rows = stream.select("run", *frame_columns(stream, diameter)).filter("frame is not null")
    return rows.groupBy("run").transformWithStateInPandas(statefulProcessor=WarmMaps(pix, s, freq, eta, diameter, tol, budget, warm), outputStructType=MAPS, outputMode="append", timeMode="none")


def solve_parts(parts: list[DataFrame], pixels: DataFrame, **how) -> tuple[DataFrame, DataFrame]:
    """Parts in the order in which they arrive, each by a query that goes on from the checkpoint of the last: maps, and
    the (run, frame) that came too late."""
    spark = pixels.sparkSession
    source, sink = fresh_folder(spark, "frames"), fresh_folder(spark, "maps")
    with with_conf(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        for part in parts:
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema(part.schema).parquet(source)
            query = warm_maps(stream, pixels, **how).writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-log").outputMode("append").trigger(availableNow=True).start()
            query.awaitTermination()
    out = spark.read.schema(MAPS).parquet(sink)
    return out.filter("not late").drop("late"), out.filter("late").select("run", "frame").distinct()


def quarters(rows: DataFrame, column: str = "frame") -> list[DataFrame]:
    """Rows in four parts by the order of a number."""
    lo, hi = rows.agg(F.min(column), F.max(column)).first()
    if lo is None:
        return [rows]
    part = F.floor((F.col(column) - lo) * 4 / (hi - lo + 1))
    return [rows.filter(part == i) for i in range(4)]
