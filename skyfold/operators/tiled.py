"""The regularised map over tiles of pixels: conjugate gradients whose every step is two passes over (frame, tile).

No task holds rows x pixels: it holds one tile's phases for one frame, within the planner's budget. A step is

1. forward: each tile gives its part of the model rows, K_t p_t; the parts are added up by (frame, row).
2. adjoint: each tile takes the summed rows V back, q_t = K_t^H (w V) + lambda p_t, and moves its part of x and r. The
   step's length needs no pass of its own, for p.Ap = sum of w |V|^2 + lambda p.p.

What a step leaves is written to the shared folder, so plans stay short however many steps there are. Frames that have
converged are carried along unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.solve import PHASE_BYTES, Frame, frame_columns, tile_pixels
from skyfold.session import stored, with_conf

#: Steps between two looks whether all frames have converged; those that have stay as they are anyway.
CHECK = 4
_STATE = "frame int, tile int, x array<double>, r array<double>, p array<double>, rz double, rr double, bb double, used double, steps int"
_PART = "frame int, at int, re double, im double, pp double"


def packs(rows: DataFrame, freq: float, diameter: float | None) -> DataFrame:
    """One row a frame: its rows as an array in a fixed order, bounded by the array's baselines and channels."""
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in frame_columns(rows, diameter)[1:]]
    if "freq" not in rows.columns:
        columns.append(F.lit(freq).alias("freq"))
    return rows.groupBy(F.col("frame").cast("int").alias("frame")).agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("pack"))


def tiles(pixels: DataFrame, size: int) -> DataFrame:
    """One row a tile: its pixels in order."""
    cell = F.struct("pix", "x", "y", "z")
    return pixels.groupBy(F.floor(F.col("pix") / size).cast("int").alias("tile")).agg(F.array_sort(F.collect_list(cell)).alias("grid"))


def _list(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False)


def _fields(batch: pa.RecordBatch, name: str) -> dict[str, np.ndarray]:
    inner = batch.column(name).flatten()
    return {f.name: inner.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(inner.type)}


def _operator(batch: pa.RecordBatch, diameter: float | None, budget: int) -> tuple[Frame, np.ndarray]:
    rows, grid = _fields(batch, "pack"), _fields(batch, "grid")
    zenith = np.array([rows[c][0] for c in ("zx", "zy", "zz")]) if diameter and len(rows["w"]) else None
    unit = np.stack([grid[c] for c in "xyz"], 1)
    return Frame(unit, np.stack([rows[c] for c in ("bx", "by_", "bz")], 1), rows["w"], rows["freq"], zenith, diameter, budget), rows["re"] + 1j * rows["im"]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1)


def _row(batch: pa.RecordBatch, **values) -> pa.RecordBatch:
    names = [c.split()[0] for c in _STATE.split(", ")]
    kinds = {"tile": pa.int32(), "frame": pa.int32(), "steps": pa.int32(), "x": pa.list_(pa.float64()), "r": pa.list_(pa.float64()), "p": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([values[n] if n in values else batch.column(n)[0].as_py()], kinds.get(n, pa.float64())) for n in names], names)


def _model(cells: DataFrame, run) -> DataFrame:
    """One row a frame: the model rows v, summed over tiles, and p.p."""
    summed = cells.mapInArrow(run, _PART).groupBy("frame", "at").agg(F.sum("re").alias("re"), F.sum("im").alias("im"), F.sum("pp").alias("pp"))
    return summed.groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("at", "re", "im"))).alias("v"), F.sum("pp").alias("pp"))


def solve(rows: DataFrame, pixels: DataFrame, freq: float = 1575420000.0, eta: float = 1e-2, diameter: float | None = None, maxiter: int = 100, tol: float = 1e-5, start: DataFrame | None = None, budget: int = PHASE_BYTES) -> DataFrame:
    """rows and pixels as solve.tikhonov takes them to (frame, pix, x, r, steps): the map, its residual, the steps taken.

    ``start``(frame, pix, x) holds maps to start from (warm start). Frames without weight give their start or zeros.
    """
    spark, warm = rows.sparkSession, start is not None
    frames = stored(packs(rows, freq, diameter), "tiled-frames")
    longest, count = frames.agg(F.coalesce(F.max(F.size("pack")), F.lit(1))).first()[0], pixels.count()
    size = tile_pixels(longest, count, budget)
    grid = stored(tiles(pixels, size), "tiled-grid")
    cells = frames.crossJoin(grid)
    if warm:
        own = start.join(pixels.select("pix"), "pix", "right").withColumn("tile", F.floor(F.col("pix") / size).cast("int"))
        own = own.groupBy(F.col("frame").cast("int").alias("frame"), "tile").agg(F.map_from_entries(F.collect_list(F.struct("pix", F.col("x").cast("double")))).alias("_x"))
        cells = cells.join(own, ["frame", "tile"], "left")
        at = lambda g: F.coalesce(F.element_at("_x", g["pix"]), F.lit(0.0))
        cells = cells.withColumn("x", F.transform("grid", at)).drop("_x")
    else:
        cells = cells.withColumn("x", F.transform("grid", lambda g: F.lit(0.0)))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with ``p``: the tile's part of the model rows, and of p.p on its first."""
        for b in _each(batches):
            operator, _ = _operator(b, diameter, budget)
            p = _list(b, "p")
            v, n = operator.forward(p), len(operator.w)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, b.column("frame")[0].as_py(), np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(v.real), pa.array(v.imag), pa.array(np.where(np.arange(n) == 0, p @ p, 0.0))], ["frame", "at", "re", "im", "pp"])

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            operator, seen = _operator(b, diameter, budget)
            x, total, right = _list(b, "x"), float(operator.w.sum()), operator.adjoint(seen)
            lam = eta * total
            v = _fields(b, "v") if warm else None
            r = right - (operator.adjoint(v["re"] + 1j * v["im"]) + lam * x) if v is not None else right.copy()
            if not total:
                r, right = np.zeros(len(x)), np.zeros(len(x))
            z = r / (operator.diagonal() + lam) if total else r
            yield _row(b, x=x, r=r, p=np.zeros(len(x)), rz=float(r @ z), rr=float(r @ r), bb=float(right @ right), used=0.0, steps=0)

    def direction(b: pa.RecordBatch, operator: Frame) -> np.ndarray:
        rho, used, lam = b.column("rho")[0].as_py(), b.column("before")[0].as_py(), eta * float(operator.w.sum())
        return _list(b, "r") / (operator.diagonal() + lam) + (rho / used if used else 0.0) * _list(b, "p")

    def ahead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            operator, _ = _operator(b, diameter, budget)
            names = [c for c in b.schema.names if c != "p"]
            yield from parts(iter([pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array([direction(b, operator)], pa.list_(pa.float64()))], [*names, "p"])]))

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _each(batches):
            v = b.column("v")[0]
            if not v.is_valid:  # a frame that has converged
                yield _row(b)
                continue
            operator, _ = _operator(b, diameter, budget)
            p, v, lam = direction(b, operator), _fields(b, "v"), eta * float(operator.w.sum())
            rho = b.column("rho")[0].as_py()
            alpha = rho / (float(operator.w @ (v["re"] ** 2 + v["im"] ** 2)) + lam * b.column("pp")[0].as_py())
            r = _list(b, "r") - alpha * (operator.adjoint(v["re"] + 1j * v["im"]) + lam * p)
            z = r / (operator.diagonal() + lam)
            yield _row(b, x=_list(b, "x") + alpha * p, r=r, p=p, rz=float(r @ z), rr=float(r @ r), used=rho, steps=b.column("steps")[0].as_py() + 1)

    with with_conf(spark, spark__sql__execution__arrow__maxRecordsPerBatch="16"):
        if warm:
            cells = cells.join(stored(_model(cells.select("frame", "pack", "grid", F.col("x").alias("p")), parts), "tiled-model").drop("pp"), "frame", "left")
        state = stored(cells.mapInArrow(begin, _STATE), "tiled-state")
        for step in range(maxiter):
            scalars = state.groupBy("frame").agg(F.sum("rz").alias("rho"), F.max("used").alias("before"), F.sum("rr").alias("_rr"), F.sum("bb").alias("_bb"))
            todo = scalars.filter((F.col("_bb") > 0) & (F.col("_rr") > tol * tol * F.col("_bb"))).drop("_rr", "_bb")
            if step % CHECK == 0 and todo.isEmpty():
                break
            open_ = state.join(frames, "frame").join(grid, "tile")
            rows_ = stored(_model(open_.join(todo, "frame").select("frame", "pack", "grid", "r", "p", "rho", "before"), ahead), "tiled-model")
            state = stored(open_.join(rows_.join(todo, "frame"), "frame", "left").mapInArrow(move, _STATE), "tiled-state")
    cell = F.explode(F.arrays_zip("grid.pix", "x", "r")).alias("c")
    return state.join(grid, "tile").select("frame", cell, "steps").select("frame", F.col("c")["pix"].cast("int").alias("pix"), F.col("c")["x"].alias("x"), F.col("c")["r"].alias("r"), "steps")

