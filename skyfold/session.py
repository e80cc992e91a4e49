"""Session settings and the shared folder."""

from __future__ import annotations

import atexit
import contextlib
import re
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def session(app: str = "skyfold", **conf: str) -> SparkSession:
    """UTC, adaptive execution, and the state store that keyed streaming state needs."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    builder = builder.config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def drop_folder(spark: SparkSession, path: str) -> None:
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):  # the session may be gone
            drop_folder(spark, path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage is cut, and lost executors cost a task."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def with_conf(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Settings that hold inside (two underscores stand for a dot); what held before holds again after."""
    names = {k.replace("__", "."): v for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that spark.checkpoint.dir names; where it is unset, in the warehouse, if all run on one
    machine or the warehouse is no machine's own folder. It is removed when the session's process ends."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        shared = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and (shared.startswith("file:") or "://" not in shared):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _made:
        atexit.register(_clean)
    path = f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def require_schema(df: DataFrame, columns: str) -> DataFrame:
    """Fails unless df has at least these columns (names separated by blanks)."""
    missing = set(columns.split()) - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return df
