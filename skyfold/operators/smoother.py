"""The fixed-lag smoother of the per-pixel filter: each frame's state given ``lag`` frames more.

Blocks of pixels are walked in time order as the filter walks them. A ring of the last lag + 1 filtered states a pixel is
all that a task holds; when a pixel has one more frame, a backward pass over its ring (Rauch, Tung and Striebel) gives the
frame that leaves. At the end of a block what is left in the ring comes out with the frames there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.filter import BLOCK, Block, blocked

SMOOTHED = "pix long, k long, t double, smoothed double, variance double"


class Ring:
    """Filtered states (x0, x1, p00, p01, p11, t) of the last frames of a block's pixels."""

    def __init__(self, lag: int, sigma2: float, noise: float) -> None:
        self.lag, self.sigma2, self.noise = lag, sigma2, noise
        self.block, self.pix = Block(), np.full(BLOCK, -1, np.int64)
        self.states = np.zeros((lag + 1, 6, BLOCK))

    def back(self, at: np.ndarray, k: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Smoothed value and variance of frame k - steps of pixels ``at``, whose newest frame is k."""
        size = self.lag + 1
        s0, s1, v00, v01, v11, after = self.states[k % size, :, at].T
        for j in range(1, steps + 1):
            x0, x1, p00, p01, p11, t = self.states[(k - j) % size, :, at].T
            d = after - t
            # C = P A' / (A P A' + Q) and M = I - C A, multiplied out so that the diffuse start cancels exactly
            h, q = p01 + d * p11, self.sigma2
            det = p00 * p11 - p01 * p01 + q * (d * p00 + d * d * p01 + d**3 * p11 / 3) + q * q * d**4 / 12
            m00 = (q * (d * d * h / 2 - d**3 * p11 / 6) + q * q * d**4 / 12) / det
            m01 = -q * ((p00 + d * p01) * d * d / 2 - p01 * d**3 / 6) / det
            m10 = -q * (h * d - p11 * d * d / 2) / det
            m11 = (q * (d * p00 + d * d * p01 / 2) + q * q * d**4 / 12) / det
            c00, c10 = 1 - m00, -m10
            c01, c11 = -m01 - d * c00, 1 - m11 - d * c10
            e0, e1 = s0 - x0 - d * x1, s1 - x1
            s0, s1 = x0 + c00 * e0 + c01 * e1, x1 + c10 * e0 + c11 * e1
            w00, w01, w11 = v00 + q * d**3 / 3, v01 + q * d * d / 2, v11 + q * d
            v00 = m00 * m00 * p00 + 2 * m00 * m01 * p01 + m01 * m01 * p11 + c00 * c00 * w00 + 2 * c00 * c01 * w01 + c01 * c01 * w11
            v01 = m00 * (m10 * p00 + m11 * p01) + m01 * (m10 * p01 + m11 * p11) + c00 * (c10 * w00 + c11 * w01) + c01 * (c10 * w01 + c11 * w11)
            v11 = m10 * m10 * p00 + 2 * m10 * m11 * p01 + m11 * m11 * p11 + c10 * c10 * w00 + 2 * c10 * c11 * w01 + c11 * c11 * w11
            after = t
        return s0, v00

    def _rows(self, at: np.ndarray, k: np.ndarray, steps: int) -> tuple[np.ndarray, ...]:
        value, variance = self.back(at, k, steps)
        return self.pix[at], k - steps, self.states[(k - steps) % (self.lag + 1), 5, at], value, variance

    def walk(self, at: np.ndarray, pix: np.ndarray, t: np.ndarray, y: np.ndarray, seen: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Rows in time order: the frames that leave the ring."""
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
        turn = np.empty(len(at), np.int64)
        turn[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
        for rows in np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1]):
            own = at[rows]
            self.pix[own] = pix[rows]
            k, _, _ = self.block.step(own, t[rows], y[rows], seen[rows], self.sigma2, self.noise)
            self.states[k % (self.lag + 1), :, own] = self.block.state[:, own].T
            full = k > self.lag
            if full.any():
                yield self._rows(own[full], k[full], self.lag)

    def rest(self) -> Iterator[tuple[np.ndarray, ...]]:
        for steps in range(self.lag - 1, -1, -1):
            own = np.flatnonzero(self.block.k > steps)
            if len(own):
                yield self._rows(own, self.block.k[own], steps)


def smooth_pixels(series: DataFrame, sigma2: float = 1e-3, noise: float = 1e-2, lag: int = 8, tie: str | None = None) -> DataFrame:
    """series(pix, t, y, ok) to SMOOTHED rows, one for each row of the series. Rows without pixel or time are left out."""
    own = blocked(series.select(F.col("pix").cast("long"), F.col("t").cast("double"), F.col("y").cast("double"), F.col("ok"), *([F.col(tie)] if tie else [])).filter("pix is not null and t is not null"))
    rows = own.repartition("block").sortWithinPartitions("block", "t", *([tie] if tie else [])).select("pix", "t", "y", "ok", "block", "slot")
    names = [c.split()[0] for c in SMOOTHED.split(", ")]

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ring, block = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            pix, time, y, ok, blocks, slots = batch.columns
            seen = pc.and_(pc.fill_null(ok, False), pc.is_valid(y)).to_numpy(zero_copy_only=False)
            pix, t, y, blocks, slots = pix.to_numpy(), time.to_numpy(), pc.fill_null(y, 0.0).to_numpy(), blocks.to_numpy(), slots.to_numpy()
            parts: list[tuple[np.ndarray, ...]] = []
            for part in np.split(np.arange(len(t)), np.flatnonzero(np.diff(blocks)) + 1):
                if blocks[part[0]] != block:
                    parts += ring.rest() if ring else []
                    ring, block = Ring(lag, sigma2, noise), blocks[part[0]]
                parts += ring.walk(slots[part], pix[part], t[part], y[part], seen[part])
            yield out(parts)
        if ring:
            yield out(list(ring.rest()))

    return rows.mapInArrow(run, SMOOTHED)
