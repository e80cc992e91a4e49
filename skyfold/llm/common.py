"""Helpers that several operators share: tables in the shared folder, row helpers and Arrow output."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII white space, as the contracts write it.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a side that is broadcast at most, and their bytes; beyond either, the join shuffles.
BROADCAST_ROWS = 250_000
BROADCAST_BYTES = 32 << 20

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one in the warehouse, if all
    run on one machine or the warehouse is no machine's own folder."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and (named.startswith("file:") or "://" not in named):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return named.rstrip("/")


def fresh_name(df: DataFrame, base: str) -> str:
    """A column name that df does not have."""
    while base.lower() in {c.lower() for c in df.columns}:
        base += "_"
    return base


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is removed when the session's process ends, or by drop_path."""
    if not _written:
        atexit.register(_clean)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _written:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone
            pass


@contextmanager
def tidy_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, Spark removes a query's shuffle files when the query ends; the session's own setting holds again after."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _bytes(df: DataFrame) -> Column:
    """Bytes that a row takes: 8 a column, and the length of strings and of arrays of plain values."""
    total = F.lit(8 * len(df.columns)).cast("long")
    for c in df.schema.fields:
        column, kind = F.col(f"`{c.name}`"), c.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(kind, T.ArrayType):
            inner = F.coalesce(F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + 8 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0)) if isinstance(kind.elementType, T.StringType) else 8 * F.greatest(F.size(column), F.lit(0))
            total = total + inner
    return total


class Kept:
    """A DataFrame written as Parquet in the shared folder and read back: it cuts the lineage and outlives executors.

    ``counted`` takes the number of rows and the bytes of their values along while writing, for choices between plans, and
    ``marked`` a checksum of a column; ``hashes`` says that a dictionary of values would not pay.
    """

    def __init__(self, df: DataFrame, name: str, counted: bool = False, marked: Column | None = None, hashes: bool = False) -> None:
        self.spark = df.sparkSession
        self.path = fresh_path(self.spark, name)
        self.schema = df.schema
        counted = counted or marked is not None
        seen, none = Observation(), F.lit(0).cast("long")
        if counted:
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"), F.coalesce(F.bit_xor(none if marked is None else marked), none).alias("mark"), F.coalesce(F.sum(_bytes(df)), none).alias("bytes"))
        with tidy_shuffles(self.spark):
            df.write.option("parquet.enable.dictionary", str(not hashes).lower()).parquet(self.path)
        self.rows, self.mark, self.bytes = (seen.get[c] for c in ("rows", "mark", "bytes")) if counted else (None, None, None)

    def side(self) -> DataFrame:
        """How a counted table joins: sent to every task where its rows and bytes are few, shuffled where they are not."""
        return F.broadcast(self.df) if self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES else self.df

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        drop_path(self.spark, self.path)


def keep(df: DataFrame, name: str) -> DataFrame:
    return Kept(df, name).df


#: Rows of the map of perhaps_in: 2^25 bits.
MAP_ROWS = 1 << 17


def perhaps_in(rows: DataFrame, keys: DataFrame, key: str, bits: int = 1) -> DataFrame:
    """The rows whose key (a long) may be among the keys, by a map of MAP_ROWS x 4 x 64 bits that is sent to every task.

    Its size is fixed; with more keys than bits it lets all rows pass, and the join that follows decides. A key sets
    ``bits`` bits (1 or 2) of its word.
    """

    def cell(h: Column) -> Column:
        return h.bitwiseAND(F.lit(MAP_ROWS - 1))

    def word(h: Column) -> Column:
        return F.shiftright(h, 40).bitwiseAND(F.lit(3))

    def bit(h: Column) -> Column:
        one = lambda at: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, at).bitwiseAND(F.lit(63)).cast("int"))
        return one(48) if bits == 1 else one(48).bitwiseOR(one(54))

    mixed, own = F.col("_h"), F.xxhash64(key)
    words = [F.bit_or(F.when(word(mixed) == i, bit(mixed)).otherwise(0)).alias(f"_w{i}") for i in range(4)]
    cells = keys.select(own.alias("_h")).groupBy(cell(mixed).alias("_cell")).agg(*words)
    of = F.when(word(own) == 0, F.col("_w0")).when(word(own) == 1, F.col("_w1")).when(word(own) == 2, F.col("_w2")).otherwise(F.col("_w3"))
    return rows.join(F.broadcast(cells), cell(own) == F.col("_cell")).filter(of.bitwiseAND(bit(own)) == bit(own)).select(*rows.columns)


def one_row_an_id(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows(key, value) with the largest value of each key. Only keys that repeat are gathered."""
    repeats = Kept(rows.groupBy(key).count().filter("count > 1").select(key), name, counted=True)
    if not repeats.rows:
        return rows
    largest = rows.join(repeats.side(), key, "left_semi").groupBy(key).agg(F.max(value).alias(value))
    return rows.join(repeats.side(), key, "left_anti").unionByName(largest)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows in an Arrow batch of texts: at some kilobytes a text, a few megabytes in the JVM and in each Python worker.
BATCH_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """The same rows; Arrow batches of this session have at most BATCH_ROWS rows from now on."""
    name, conf = "spark.sql.execution.arrow.maxRecordsPerBatch", df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= BATCH_ROWS:
        conf.set(name, str(BATCH_ROWS))
    return df


def ascii_lower(col):
    """Lower-cases A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def text_bytes(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def worker_store(name: str) -> dict:
    """A dictionary that stays with the Python worker from task to task."""
    import sys

    return vars(sys).setdefault("_skyfold_store", {}).setdefault(name, {})
