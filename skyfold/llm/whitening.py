"""Embedding whitening by matrix-free block subspace iteration.

1. An entry c becomes the integer x = floor(256 c). The fit list is each distinct x vector once, written to the shared
   folder; its per-dimension sums are exact.
2. A pass over the fit list computes V Q = Xᵀ(X Q) / n on centred rows X for a block Q of a few orthonormal columns. Each task
   adds up its own rows and sends one block of dimensions x columns; V itself is never formed and no row leaves its task.
3. Between passes the driver, which holds that block alone, takes Rayleigh-Ritz values and vectors of QᵀVQ, the residuals
   V y - e y of the first ``k`` and the next Q by QR.
4. Passes end when every one of the k residuals is at most ``TOLERANCE`` of the largest eigenvalue. Where the residuals fall so
   slowly that more than ``PATIENCE`` passes would be needed (flat spectra), the block gets twice as many columns, up to
   all dimensions, where Rayleigh-Ritz is exact; so the end is reached on any spectrum.
5. Rows are projected on e^(-1/2) y; a last pass over the fit list measures the covariance of the result.

Broadcast and collected: blocks of dimensions x columns only, bounded by the square of the dimension.

Defined results: rows whose vector is null, empty or holds null or non-finite entries, or entries beyond 2^54 whose x is
no exact integer, are dropped; so are rows of another length than the most frequent one (ties: the shorter). Rows that repeat an id or a vector each
have their rows; a null id stays null. A component whose eigenvalue is no more than rounding of the largest has no rows
(equal vectors, one row, fewer dimensions than ``k``). ``deviation`` is null where it fits no long. Further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import Kept

COMPONENTS, BLOCK, PATIENCE, SCALE = 4, 16, 8, 256
#: Of a residual, as a share of the largest eigenvalue: some units of the last place a dimension.
TOLERANCE = 8 * np.finfo(float).eps
LARGEST = float(1 << 54)


@dataclass
class Whitening:
    """What a fit returns: all of it is of the size of dimensions x components."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float = 0.0
    residuals: list[float] = field(default_factory=list)
    passes: int = 0
    width: int = 0

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])

    @property
    def projection(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def integers(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Rows (vec_id, x) with x = floor(256 c) as longs, of the vectors that take part."""
    vector, scaled = F.col(f"`{vector_column}`"), lambda c: c.cast("double") * SCALE
    sound = F.forall(vector, lambda c: c.isNotNull() & (F.abs(scaled(c)) < LARGEST))  # NaN is larger than any number
    rows = rows.filter(vector.isNotNull() & (F.size(vector) > 0) & sound)
    rows = rows.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.transform(vector, lambda c: F.floor(scaled(c)).cast("long")).alias("x"))
    usual = rows.groupBy(F.size("x").alias("_d")).count().orderBy(F.desc("count"), "_d").limit(1).select("_d")
    return rows.join(F.broadcast(usual), F.size("x") == F.col("_d"), "left_semi")


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int64)


def _summed(fit: DataFrame, kernel, kind: str) -> dict[int, object]:
    """kernel: matrix of a batch to an array of sums. Each task adds up its batches; the sums of all tasks by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                part = kernel(_matrix(batch.column(0)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int64)), pa.array(total)], ["at", "v"])

    exact = F.sum(F.col("v").cast("decimal(20,0)")) if kind == "long" else F.sum("v")
    return {r.at: r.v for r in fit.mapInArrow(run, f"at long, v {kind}").groupBy("at").agg(exact.alias("v")).collect()}


def _counts(x: np.ndarray) -> np.ndarray:
    """Rows, and for each dimension the sums of the upper and lower 32 bits, which no batch can overflow."""
    return np.concatenate([[len(x)], (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)])


def _times(fit: DataFrame, mean: np.ndarray, q: np.ndarray, n: int) -> tuple[np.ndarray, float]:
    """V q and the trace of V, in one pass."""

    def kernel(x: np.ndarray) -> np.ndarray:
        centred = x - mean
        return np.append((centred.T @ (centred @ q)).ravel(), (centred * centred).sum())

    found = _summed(fit, kernel, "double")
    sums = np.array([found[i] for i in range(len(found))]) / n
    return sums[:-1].reshape(q.shape), float(sums[-1])


def _widened(q: np.ndarray, width: int, rng: np.random.Generator) -> np.ndarray:
    return np.linalg.qr(np.concatenate([q, rng.standard_normal((len(q), width - q.shape[1]))], 1))[0]


def fit(vectors: DataFrame, k: int = COMPONENTS, block: int = BLOCK, seed: int = 0) -> Whitening | None:
    """vectors: what integers() returns. None where there are none."""
    held = Kept(vectors.select("x").distinct(), "whitening-fit")
    counted = _summed(held.df, _counts, "long")
    if not counted:
        return None
    d, n = (len(counted) - 1) // 2, int(counted[0])
    model = Whitening(n, [(int(counted[1 + i]) << 32) + int(counted[1 + d + i]) for i in range(d)], np.zeros(0), np.zeros((d, 0)), 0.0)
    mean, rng, k = model.mean, np.random.default_rng(seed), min(k, d)
    width = min(d, max(block, k))
    q = np.linalg.qr(rng.standard_normal((d, width)))[0]
    before = math.inf
    while True:
        z, model.trace = _times(held.df, mean, q, n)
        model.passes += 1
        inner = q.T @ z
        values, turn = np.linalg.eigh((inner + inner.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        y, z = q @ turn, z @ turn
        top = max(float(values[0]), 0.0)
        model.residuals = [float(np.linalg.norm(z[:, i] - y[:, i] * values[i])) / top if top else 0.0 for i in range(k)]
        worst, enough = max(model.residuals), TOLERANCE * max(d, 16)
        if worst <= enough or width == d:
            break
        left = math.log(worst / enough) / math.log(before / worst) if worst < before < math.inf else math.inf
        if before < math.inf and left > PATIENCE:
            width, before = min(d, 2 * width), math.inf
        else:
            before = worst
        q = np.linalg.qr(z)[0] if q.shape[1] == width else _widened(np.linalg.qr(z)[0], width, rng)
    sound = [i for i in range(k) if values[i] > 4 * d * np.finfo(float).eps * top]
    vectors_ = y[:, sound]
    model.values, model.width = values[sound], width
    model.vectors = vectors_ * np.where(vectors_[np.abs(vectors_).argmax(0), range(len(sound))] < 0, -1.0, 1.0) if sound else vectors_
    if sound:
        projection = model.projection

        def moments(x: np.ndarray) -> np.ndarray:
            w = (x - mean) @ projection
            return (w.T @ w).ravel()

        found = _summed(held.df, moments, "double")
        covariance = np.array([found[i] for i in range(len(found))]).reshape(len(sound), -1) / n
        model.identity_error = float(np.abs(covariance - np.eye(len(sound))).max())
    held.drop()
    return model


_WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def transform(vectors: DataFrame, model: Whitening | None) -> DataFrame:
    """A row for each row of vectors and component; see _WHITENED for the columns."""
    if model is None or not len(model.values):
        return vectors.sparkSession.createDataFrame([], _WHITENED)
    n, sums, mean, projection = model.n, model.sums, model.mean, model.projection
    explained, error, k = model.values / model.trace, model.identity_error, len(model.values)
    largest = max(map(abs, sums))

    def deviations(x: np.ndarray) -> pa.Array:
        if (n * float(np.abs(x).max()) + largest) ** 2 * x.shape[1] < 2.0**62:
            off = n * x - np.array(sums, np.int64)
            return pa.array((off * off).sum(1))
        exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
        return pa.array([v if v < 1 << 63 else None for v in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1))
            at = pa.array(np.repeat(np.arange(m), k))
            columns = [batch.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), deviations(x).take(at), pa.array(((x - mean) @ projection).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _WHITENED.split(", ")])

    return vectors.select("vec_id", "x").mapInArrow(run, _WHITENED)


def whiten(rows: DataFrame, k: int = COMPONENTS, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    vectors = integers(rows, id_column, vector_column)
    return transform(vectors, fit(vectors, k))
