"""Maps written by frame into a scaffold of known times: a streaming and batch sink on the Python Data Source API.

A scaffold (create) fixes the times, the pixels and the names of the variables. A task writes the rows of its frames as
Parquet files of its own; that changes nothing yet. The commit of a batch puts one manifest, whole or not at all, which names
the files of each frame. Readers follow manifests alone and take each frame from the last batch that has it, so

* a batch that is tried again replaces its own manifest and changes nothing,
* a batch that ends before its commit, or is aborted, leaves files that nobody reads, and no half frame,
* a time that the scaffold lacks fails the batch.

Values are single precision.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceStreamArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from skyfold.sources.files import listed, put, read_bytes, store

SCAFFOLD = "scaffold.json"


def create(path: str, times: list[float], npix: int, variables: list[str], overwrite: bool = False) -> None:
    """The scaffold of a run; one that is there is an error unless ``overwrite``, which forgets its frames."""
    system, root = store(path)
    there = [f for f in listed(path, SCAFFOLD) if f == f"{root}/{SCAFFOLD}"]
    if there and not overwrite:
        raise FileExistsError(f"{path} holds maps already")
    if there:
        system.delete_dir_contents(root)
    if len(set(times)) != len(times):
        raise ValueError("times repeat")
    put(path, f"{root}/{SCAFFOLD}", json.dumps({"times": list(times), "npix": npix, "variables": variables}).encode())


def scaffold(path: str) -> dict:
    return json.loads(read_bytes(path, f"{store(path)[1]}/{SCAFFOLD}"))


@dataclass
class Written(WriterCommitMessage):
    """Frame numbers and files of a task."""

    files: list[tuple[int, str]]


class Regions(DataSource):
    """Rows (t, pix, one column a variable) into the scaffold at ``path``. Options: path, batch (a name; batch mode only)."""

    @classmethod
    def name(cls) -> str:
        return "regions"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return RegionWriter(self.options, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> DataSourceStreamArrowWriter:  # noqa: N802
        return RegionStreamWriter(self.options, schema)


class _Writer:
    def __init__(self, options: dict[str, str], schema: StructType) -> None:
        self.path, self.batch = options["path"], options.get("batch", "")
        held = scaffold(self.path)
        self.variables, self.frames, self.npix = held["variables"], {t: i for i, t in enumerate(held["times"])}, held["npix"]
        missing = {"t", "pix", *self.variables} - set(schema.names)
        if missing:
            raise ValueError(f"missing columns: {', '.join(sorted(missing))}")

    def write(self, batches: Iterator) -> Written:
        import numpy as np
        import pyarrow as pa
        import pyarrow.parquet as pq

        table = pa.Table.from_batches(list(batches)) if not isinstance(batches, pa.Table) else batches
        files = []
        if table.num_rows:
            times, pix = table["t"].to_numpy(), table["pix"].to_numpy()
            unknown = sorted(set(times.tolist()) - set(self.frames))
            if unknown or not ((pix >= 0) & (pix < self.npix)).all():
                raise KeyError(f"not in the scaffold: {unknown[:5] or 'pixels'}")
            root = store(self.path)[1]
            for t in np.unique(times):
                own = table.filter(pa.array(times == t))
                data = pa.table({"pix": own["pix"].cast(pa.int64()), **{v: own[v].cast(pa.float32()) for v in self.variables}})
                out, name = io.BytesIO(), f"{root}/frames/{self.frames[float(t)]:08d}-{uuid.uuid4().hex}.parquet"
                pq.write_table(data, out)
                put(self.path, name, out.getvalue())
                files.append((self.frames[float(t)], name[len(root) + 1 :]))
        return Written(files)

    def _commit(self, messages: list, batch: str) -> None:
        frames: dict[int, list[str]] = {}
        for m in messages:
            for number, name in m.files if m is not None else ():
                frames.setdefault(number, []).append(name)
        put(self.path, f"{store(self.path)[1]}/commits/{batch}.json", json.dumps(frames).encode())

    def _drop(self, messages: list) -> None:
        system, root = store(self.path)
        for m in messages:
            for _, name in m.files if m is not None else ():
                system.delete_file(f"{root}/{name}")


class RegionWriter(_Writer, DataSourceArrowWriter):
    def commit(self, messages: list) -> None:
        self._commit(messages, self.batch or f"b{len(listed(f'{self.path}/commits')):012d}")

    def abort(self, messages: list) -> None:
        self._drop(messages)


class RegionStreamWriter(_Writer, DataSourceStreamArrowWriter):
    def commit(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._commit(messages, f"s{batchId:012d}")

    def abort(self, messages: list, batchId: int) -> None:  # noqa: N803
        self._drop(messages)


def read(spark: SparkSession, path: str) -> DataFrame:
    """frame, t, pix and the variables of every pixel of the scaffold; null where no batch has written the frame."""
    held, (_, root) = scaffold(path), store(path)
    latest: dict[int, list[str]] = {}
    for name in listed(f"{path}/commits", ".json"):  # one small file a batch, in order
        latest.update({int(k): v for k, v in json.loads(read_bytes(path, name)).items()})
    kind = "pix long, " + ", ".join(f"`{v}` float" for v in held["variables"])
    times = spark.createDataFrame(list(enumerate(map(float, held["times"]))), "frame int, t double")
    whole = times.crossJoin(spark.range(held["npix"]).toDF("pix"))
    files = [f"{path.rstrip('/')}/{n}" for names in latest.values() for n in names]
    if not files:
        return whole.select("*", *(F.lit(None).cast("float").alias(v) for v in held["variables"]))
    rows = spark.read.schema(kind).parquet(*files).withColumn("frame", F.regexp_extract(F.input_file_name(), r"/(\d+)-[0-9a-f]+\.parquet", 1).cast("int"))
    return whole.join(rows, ["frame", "pix"], "left").select("frame", "t", "pix", *held["variables"])
