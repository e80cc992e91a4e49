"""Corners of nested equal-area pixels, by the same closed form as their centres."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _points(face: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Unit vectors of places (x, y) in [0, 1] on base faces."""
    jr = (2 + face // 4) - x - y
    jp = np.where(face // 4 == 1, 2 * (face % 4), 2 * (face % 4) + 1)
    nr = np.where(jr < 1, jr, np.where(jr > 3, 4 - jr, 1.0))
    z = np.where(jr < 1, 1 - nr * nr / 3, np.where(jr > 3, nr * nr / 3 - 1, (2 - jr) * 2 / 3))
    phi = np.pi / 4 * np.where(nr > 0, (jp * nr + x - y) / np.where(nr > 0, nr, 1), 0)
    r = np.sqrt(np.maximum(1 - z * z, 0))
    return np.stack([r * np.cos(phi), r * np.sin(phi), z], -1)


def _bits(p: np.ndarray, order: int, first: int) -> np.ndarray:
    return sum((((p >> (2 * b + first)) & 1) << b for b in range(order)), np.zeros_like(p))


def centres(pix: np.ndarray, nside: int) -> np.ndarray:
    order = nside.bit_length() - 1
    inside = pix % (nside * nside)
    return _points(pix // (nside * nside), (_bits(inside, order, 0) + 0.5) / nside, (_bits(inside, order, 1) + 0.5) / nside)


def corners(pix: np.ndarray, nside: int) -> np.ndarray:
    """pixels x 4 x 3: north, west, south, east."""
    order = nside.bit_length() - 1
    inside, face = pix % (nside * nside), pix // (nside * nside)
    x, y = _bits(inside, order, 0), _bits(inside, order, 1)
    return np.stack([_points(face, (x + i) / nside, (y + j) / nside) for i, j in ((1, 1), (0, 1), (0, 0), (1, 0))], 1)


def pixel_corners(spark: SparkSession, nside: int) -> DataFrame:
    """pix and its corners: 12 single-precision numbers, as a viewer wants them."""

    def run(batches):
        for b in batches:
            c = corners(b.column(0).to_numpy(), nside).reshape(len(b), 12).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.FixedSizeListArray.from_arrays(pa.array(c.ravel()), 12).cast(pa.list_(pa.float32()))], ["pix", "corners"])

    return spark.range(12 * nside * nside).toDF("pix").mapInArrow(run, "pix long, corners array<float>")
