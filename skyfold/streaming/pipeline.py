"""Structured Streaming: prepared frames from files, keyed filter state, and two sinks of one micro-batch."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from skyfold.operators.filter import BLOCK, START, Block, blocked
from skyfold.session import fresh_folder, with_conf


def read_frames(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files, oldest first; a file holds whole frames."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", "false").parquet(folder)


def replay(rows: DataFrame, key: str, schema: str) -> DataFrame:
    """Writes rows as a frame store, streams it to the end into another store, and gives what arrived."""
    spark = rows.sparkSession
    source, sink = fresh_folder(spark, "frames"), fresh_folder(spark, "streamed")
    rows.selectExpr(*[c.strip().split(" ")[0] for c in schema.split(",")]).repartition(4, key).write.parquet(source)
    query = read_frames(spark, source, schema).writeStream.format("parquet").option("path", sink).option("checkpointLocation", sink + "-log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(sink)


#: Rows that wait until the watermark has passed them.
_WAITING = np.dtype([("slot", "i8"), ("pix", "i8"), ("numbered", "?"), ("t", "f8"), ("y", "f8"), ("seen", "?")])
FILTERED = "pix long, k long, t double, filtered double, znorm double"
#: With the rows that were too late: k is 0 there, y is the row's own.
ARRIVED = FILTERED + ", y double, late boolean"


class BlockFilter(StatefulProcessor):
    """Filter states of a block of pixels, and the rows that wait.

    The block's watermark is its newest event time less ``delay``. Rows wait until the watermark reaches them, are then
    sorted by time and step their pixels; a row not after its pixel's last step is late (so is one without a time, and
    the second of two rows of a pixel at one time) and comes out marked. A row at infinite time (end_marks) ends the
    series: what waits steps.
    """

    def __init__(self, sigma2: float, noise: float, delay: float = 0.0) -> None:
        self.sigma2, self.noise, self.delay = sigma2, noise, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("filter", "state binary, k binary, newest double, waiting binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held, newest, waiting = Block(), -np.inf, np.zeros(0, _WAITING)
        if self.state.exists():
            state, k, newest, raw = self.state.get()
            held = Block(np.frombuffer(state, float).reshape(len(START), BLOCK).copy(), np.frombuffer(k, np.int64).copy())
            waiting = np.frombuffer(raw, _WAITING)
        parts = [waiting]
        for frame in rows:
            own = np.zeros(len(frame), _WAITING)
            own["slot"], own["t"], own["y"] = frame["slot"], frame["t"].astype(float), frame["y"].astype(float)
            own["numbered"], own["pix"] = frame["pix"].notna(), frame["pix"].fillna(0)
            own["seen"] = frame["ok"].fillna(False).to_numpy(bool) & frame["y"].notna().to_numpy()
            parts.append(own)
        table = np.concatenate(parts)
        newest = max(newest, float(np.nanmax(table["t"], initial=-np.inf)))
        table = table[table["t"] != np.inf]
        waits = table["t"] > newest - self.delay if newest < np.inf else np.zeros(len(table), bool)
        due = table[~waits]
        due = due[np.argsort(due["t"], kind="stable")]
        k, filtered, znorm = held.walk(due["slot"], due["t"], np.nan_to_num(due["y"]), due["seen"], self.sigma2, self.noise, skip_late=True)
        self.state.update((held.state.tobytes(), held.k.tobytes(), newest, table[waits].tobytes()))
        late = k == 0
        out = pd.DataFrame({"pix": pd.array(due["pix"], "Int64"), "k": k, "t": due["t"], "filtered": filtered, "znorm": znorm, "y": due["y"], "late": late})
        out.loc[~due["numbered"], "pix"] = None
        out.loc[late, ["filtered", "znorm"]] = None
        yield out

    def close(self) -> None:
        pass


def filtered_stream(stream: DataFrame, sigma2: float, noise: float, delay: float = 0.0) -> DataFrame:
    """stream(pix, t, y, ok) to ARRIVED rows, with the states of each block in the session's state store. No row is lost:
    each one steps its pixel, is marked late, or waits for a row ``delay`` newer."""
    return blocked(stream).groupBy("block").transformWithStateInPandas(statefulProcessor=BlockFilter(sigma2, noise, delay), outputStructType=ARRIVED, outputMode="append", timeMode="none")


def end_marks(series: DataFrame) -> DataFrame:
    """A row at infinite time for each block of the series: the end of the stream."""
    blocks = blocked(series).groupBy("block").agg(F.min("pix").alias("pix"))
    return blocks.select("pix", F.lit(float("inf")).alias("t"), F.lit(None).cast("double").alias("y"), F.lit(False).alias("ok"))


def two_sinks(stream: DataFrame, kept: str, late: str, log: str):
    """One micro-batch to two tables: filtered rows, and the rows that were too late. A batch that is tried again replaces what it wrote."""

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.filter("not late").drop("late", "y").write.mode("overwrite").parquet(f"{kept}/batch={n}")
        batch.filter("late").select("pix", "t", "y").write.mode("overwrite").parquet(f"{late}/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", log).outputMode("append").trigger(availableNow=True).start()


def filter_parts(parts: list[DataFrame], sigma2: float, noise: float, delay: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Parts(pix, t, y, ok) in the order in which they arrive, each one micro-batch of a query of its own that goes on from
    the checkpoint of the last; then the end marks. Filtered rows, and late rows (pix, t, y)."""
    spark = parts[0].sparkSession
    source, sink, late = (fresh_folder(spark, n) for n in ("series", "filtered", "late"))
    rows = [p.select(F.col("pix").cast("long").alias("pix"), F.col("t").cast("double").alias("t"), F.col("y").cast("double").alias("y"), "ok") for p in parts]
    marks = [end_marks(reduce(DataFrame.union, rows))] if delay else []
    with with_conf(spark, spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        for part in rows + marks:
            part.write.mode("append").parquet(source)
            stream = spark.readStream.schema("pix long, t double, y double, ok boolean").parquet(source)
            two_sinks(filtered_stream(stream, sigma2, noise, delay), sink, late, sink + "-log").awaitTermination()
    return spark.read.schema(FILTERED).parquet(sink), spark.read.schema("pix long, t double, y double").parquet(late)


def filter_stream(series: DataFrame, sigma2: float, noise: float) -> DataFrame:
    """The whole series through the stream, a quarter of the time at a time."""
    lo, hi = series.agg(F.min("t"), F.max("t")).first()
    if lo is None:
        return series.sparkSession.createDataFrame([], FILTERED)
    part = F.least(F.floor((F.col("t") - lo) / ((hi - lo) / 4 or 1.0)), F.lit(3))
    return filter_parts([series.filter(part == i) for i in range(4)], sigma2, noise)[0]


def fan_out(stream: DataFrame, maps: str, latest: str, log: str):
    """One micro-batch to two tables: all maps, and for each name the newest frame of the batch.

    Both write to the batch's own folder, so a batch that is tried again replaces what it wrote before.
    """

    def write(batch: DataFrame, n: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{maps}/batch={n}")
        newest = batch.groupBy("name").agg(F.max_by(F.struct(*batch.columns), "seq").alias("row"))
        newest.select("row.*").write.mode("overwrite").parquet(f"{latest}/batch={n}")
        batch.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", log).trigger(availableNow=True).start()


def latest_frames(spark: SparkSession, latest: str) -> DataFrame:
    """The newest frame of every name, over all batches: a row for each name and batch is read."""
    rows = spark.read.parquet(latest).drop("batch")
    return rows.groupBy("name").agg(F.max_by(F.struct(*rows.columns), "seq").alias("row")).select("row.*")
