"""A bank of quiet models for every pixel: integrated Wiener processes of order 1 and 2, mixed by their evidence.

All models of a block of pixels step at once, as the single filter does; a task holds one block's states, whose size is that
of the bank. A model of order 1 is one of order 2 whose acceleration is known to be 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.filter import BLOCK, blocked, turns

_OUT = "pix long, k long, t double, mean double, best int, weight double, scale int, znorm double"


class Model(NamedTuple):
    order: int
    sigma2: float


class Bank:
    """States of a block's pixels under each model; time of the last frame (nan: none), frames so far, log weights."""

    def __init__(self, models: list[Model], noise: float, diffuse: float, forget: float, calm: float) -> None:
        m = len(models)
        self.second = np.array([q.order == 2 for q in models])[:, None]
        self.sigma2 = np.array([q.sigma2 for q in models], float)[:, None]
        self.noise, self.forget, self.calm = noise, forget, calm
        self.x, self.p = np.zeros((3, m, BLOCK)), np.zeros((6, m, BLOCK))
        self.p[0] = self.p[3] = diffuse
        self.p[5] = np.where(self.second, diffuse, 0.0)
        self.log_w, self.before, self.k = np.full((m, BLOCK), -np.log(m)), np.full(BLOCK, np.nan), np.zeros(BLOCK, np.int64)

    def step(self, at: np.ndarray, t: np.ndarray, y: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, ...]:
        """A frame of distinct pixels ``at`` to k, mean, best, weight, scale, znorm."""
        self.k[at] += 1
        x0, x1, x2 = self.x[:, :, at]
        p00, p01, p02, p11, p12, p22 = self.p[:, :, at]
        d = np.where(np.isnan(self.before[at]), 0.0, t - self.before[at])  # a first frame has no prediction
        h, s, two = d * d / 2, self.sigma2, self.second
        x0, x1 = x0 + d * x1 + h * x2, x1 + d * x2
        a00, a01, a02 = p00 + d * p01 + h * p02, p01 + d * p11 + h * p12, p02 + d * p12 + h * p22
        a11, a12 = p11 + d * p12, p12 + d * p22
        p00 = a00 + d * a01 + h * a02 + s * np.where(two, d * d * d * d * d / 20, d * d * d / 3)
        p01 = a01 + d * a02 + s * np.where(two, d * d * d * d / 8, d * d / 2)
        p02 = a02 + s * np.where(two, d * d * d / 6, 0.0)
        p11 = a11 + d * a12 + s * np.where(two, d * d * d / 3, d)
        p12 = a12 + s * np.where(two, d * d / 2, 0.0)
        p22 = p22 + s * np.where(two, d, 0.0)
        v, e = p00 + self.noise, np.where(seen, y - x0, 0.0)
        z = e / np.sqrt(v)
        new = (x0 + p00 / v * e, x1 + p01 / v * e, x2 + p02 / v * e)
        self.x[:, :, at] = np.where(seen, np.stack(new), np.stack((x0, x1, x2)))
        left = (self.noise * p00 / v, self.noise * p01 / v, self.noise * p02 / v, p11 - p01 * p01 / v, p12 - p01 * p02 / v, p22 - p02 * p02 / v)
        self.p[:, :, at] = np.where(seen, np.stack(left), np.stack((p00, p01, p02, p11, p12, p22)))
        self.before[at] = t
        moved = self.forget * self.log_w[:, at] - (np.log(2 * np.pi * v) + z * z) / 2
        log_w = np.where(seen & (np.abs(z).max(0) <= self.calm), moved, self.log_w[:, at])
        w = np.exp(log_w - log_w.max(0))
        log_w = log_w - log_w.max(0) - np.log(w.sum(0))  # nothing grows with the light curve
        self.log_w[:, at], w = log_w, w / w.sum(0)
        best, scale, one = np.round(w, 9).argmax(0), np.round(np.abs(z), 9).argmax(0), np.arange(len(at))
        return self.k[at], (w * self.x[0][:, at]).sum(0), best, w[best, one], scale, z[scale, one]


def filter_bank(series: DataFrame, models: list[Model], noise: float = 1e-2, diffuse: float = 1e6, forget: float = 1.0, calm: float = float("inf"), tie: str | None = None) -> DataFrame:
    """series(pix, t, y, ok) to (pix, k, t, mean, best, weight, scale, znorm), a row a frame, k from 1 in time order.

    ``mean`` is the flux averaged over the models after the frame, ``best`` the place in ``models`` of the one with the largest
    weight and ``weight`` that weight; ``znorm`` is the largest normalised innovation over the models, with its sign, and
    ``scale`` its model (ties, to nine digits: the earlier model). Before a frame weighs, weights are raised to the power
    ``forget``. Where an innovation is beyond ``calm`` for any model, weights stay as they are, so a flexible model does not gain by a flare. A frame without
    data (ok false or null, or y null) coasts and leaves weights alone. A null pix is a pixel of its own; a null t is an error.
    """
    if not models or any(m.order not in (1, 2) or not m.sigma2 > 0 for m in models):
        raise ValueError("a bank needs models of order 1 or 2 and of positive sigma2")
    own = blocked(series.select(F.col("pix").cast("long"), F.coalesce(F.col("t").cast("double"), F.raise_error(F.lit("frame without a time"))).alias("t"), F.col("y").cast("double"), F.col("ok"), *([F.col(tie)] if tie else [])))
    rows = own.repartition("block").sortWithinPartitions("block", "t", *([tie] if tie else [])).select("pix", "t", "y", "ok", "block", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pix, time, y, ok, blocks, slots = batch.columns
            seen = pc.and_(pc.fill_null(ok, False), pc.is_valid(y)).to_numpy(zero_copy_only=False)
            t, y, blocks, slots = time.to_numpy(), pc.fill_null(y, 0.0).to_numpy(), blocks.to_numpy(), slots.to_numpy()
            found = [np.empty(len(t), kind) for kind in (np.int64, float, np.int32, float, np.int32, float)]
            for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(blocks)) + 1):
                if held is None or blocks[own[0]] != block:
                    held, block = Bank(models, noise, diffuse, forget, calm), blocks[own[0]]
                for part in turns(slots[own]):
                    at = own[part]
                    for to, values in zip(found, held.step(slots[at], t[at], y[at], seen[at]), strict=True):
                        to[at] = values
            k, *rest = found
            yield pa.RecordBatch.from_arrays([pix, pa.array(k), time, *map(pa.array, rest)], [c.split()[0] for c in _OUT.split(", ")])

    return rows.mapInArrow(run, _OUT)
