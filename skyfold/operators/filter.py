"""The per-pixel filter in batch: an ordered fold of constant memory, and the same with gaps. Pixels step in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: State before any data: flux, slope, their covariance (p00, p01, p11) and the time of the last frame.
START = (0.0, 0.0, 1e6, 0.0, 1e6, None)
#: Pixels of a block: what one task holds state of.
BLOCK = 1024
#: Fewer pixels than this that have a row at hand step one by one.
FEW = 16


def step(state: tuple, t: float, y: float | None, sigma2: float, noise: float) -> tuple[tuple, float, float]:
    """(state, filtered, znorm) after a frame at t; no y: the filter coasts. A first frame has no prediction."""
    x0, x1, p00, p01, p11, before = state
    if before is not None:
        d = t - before
        x0 += d * x1
        p00 += 2 * d * p01 + d * d * p11 + sigma2 * d * d * d / 3
        p01 += d * p11 + sigma2 * d * d / 2
        p11 += sigma2 * d
    if y is None:
        return (x0, x1, p00, p01, p11, t), x0, 0.0
    v, e = p00 + noise, y - x0
    x0, x1 = x0 + p00 / v * e, x1 + p01 / v * e
    p00, p01, p11 = noise * p00 / v, noise * p01 / v, p11 - p01 * p01 / v
    return (x0, x1, p00, p01, p11, t), x0, e / v**0.5


def turns(at: np.ndarray) -> list[np.ndarray]:
    """Rows of a block in time order, dealt so that each pixel is in a part once: first rows, second rows, and so on."""
    order = np.argsort(at, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(at[order]) != 0])
    turn = np.empty(len(at), np.int64)
    turn[order] = np.arange(len(at)) - np.repeat(starts, np.diff(np.r_[starts, len(at)]))
    return np.split(np.argsort(turn, kind="stable"), np.cumsum(np.bincount(turn))[:-1])


class Block:
    """States of a block's pixels: rows of ``state`` as in START (nan: no frame yet), ``k`` frames each."""

    def __init__(self, state: np.ndarray | None = None, k: np.ndarray | None = None) -> None:
        self.state = np.repeat(np.array([START], float).T, BLOCK, 1) if state is None else state
        self.k = np.zeros(BLOCK, np.int64) if k is None else k

    def step(self, at: np.ndarray, t: np.ndarray, y: np.ndarray, seen: np.ndarray, sigma2: float, noise: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A frame of distinct pixels ``at``: frames so far, filtered, znorm; ``seen`` tells where the pixel has data."""
        self.k[at] += 1
        if len(at) < FEW:
            done = []
            for i, now, value, ok in zip(at.tolist(), t.tolist(), y.tolist(), seen.tolist(), strict=True):
                *own, before = self.state[:, i].tolist()
                state, *out = step((*own, None if before != before else before), now, value if ok else None, sigma2, noise)
                self.state[:, i] = state
                done.append(out)
            filtered, znorm = np.array(done, float).reshape(-1, 2).T
            return self.k[at], filtered, znorm
        x0, x1, p00, p01, p11, before = self.state[:, at]
        d = np.where(np.isnan(before), 0.0, t - before)  # a first frame has no prediction
        x0 = x0 + d * x1
        p00 = p00 + 2 * d * p01 + d * d * p11 + sigma2 * d * d * d / 3
        p01 = p01 + d * p11 + sigma2 * d * d / 2
        p11 = p11 + sigma2 * d
        v, e = p00 + noise, np.where(seen, y - x0, 0.0)
        new = (x0 + p00 / v * e, x1 + p01 / v * e, noise * p00 / v, noise * p01 / v, p11 - p01 * p01 / v)
        self.state[:, at] = (*(np.where(seen, a, b) for a, b in zip(new, (x0, x1, p00, p01, p11), strict=True)), t)
        return self.k[at], self.state[0, at], e / np.sqrt(v)

    def walk(self, at: np.ndarray, t: np.ndarray, y: np.ndarray, seen: np.ndarray, sigma2: float, noise: float, skip_late: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows in time order: first the first rows of all pixels, then their second rows, and so on.

        ``skip_late`` leaves rows not after their pixel's last one out; their k is 0.
        """
        k, filtered, znorm = np.zeros(len(at), np.int64), np.zeros(len(at)), np.zeros(len(at))
        for rows in turns(at):
            if skip_late:
                before = self.state[5, at[rows]]
                rows = rows[np.isnan(before) | (t[rows] > before)]
            k[rows], filtered[rows], znorm[rows] = self.step(at[rows], t[rows], y[rows], seen[rows], sigma2, noise)
        return k, filtered, znorm


def blocked(series: DataFrame) -> DataFrame:
    """With ``block`` and ``slot``, a pixel's place in it; pixels without a number are one pixel of their own block."""
    pix = F.col("pix").cast("long")
    return series.withColumns({"block": F.coalesce(F.floor(pix / BLOCK), F.lit(-(1 << 62))), "slot": F.coalesce(F.pmod(pix, F.lit(BLOCK)), F.lit(0)).cast("long")})


def filter_pixels(series: DataFrame, sigma2: float = 1e-3, noise: float = 1e-2, tie: str | None = None) -> DataFrame:
    """series(pix, t, y, ok) to (pix, k, t, filtered, znorm), k from 1 in time order.

    Blocks of neighbouring pixels are dealt to tasks and sorted by time once; a task walks its rows with one block's
    states in hand, however long the light curves are, and all pixels that a frame holds step at once.
    """
    own = blocked(series.select(F.col("pix").cast("long"), F.col("t").cast("double"), F.col("y").cast("double"), F.col("ok"), *([F.col(tie)] if tie else [])))
    rows = own.repartition("block").sortWithinPartitions("block", "t", *([tie] if tie else [])).select("pix", "t", "y", "ok", "block", "slot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block = Block(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            pix, time, y, ok, blocks, slots = batch.columns
            seen = pc.and_(pc.fill_null(ok, False), pc.is_valid(y)).to_numpy(zero_copy_only=False)
            t, y, blocks, slots = time.to_numpy(), pc.fill_null(y, 0.0).to_numpy(), blocks.to_numpy(), slots.to_numpy()
            parts = []
            for own in np.split(np.arange(len(t)), np.flatnonzero(np.diff(blocks)) + 1):
                if blocks[own[0]] != block:
                    held, block = Block(), blocks[own[0]]
                parts.append(held.walk(slots[own], t[own], y[own], seen[own], sigma2, noise))
            k, filtered, znorm = (np.concatenate(c) for c in zip(*parts, strict=True))
            yield pa.RecordBatch.from_arrays([pix, pa.array(k), time, pa.array(filtered), pa.array(znorm)], ["pix", "k", "t", "filtered", "znorm"])

    return rows.mapInArrow(run, "pix long, k long, t double, filtered double, znorm double")
