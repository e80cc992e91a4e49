"""Conjugate gradients, the measurement operator in tiles of pixels, and the regularised map, one frame a group."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

C = 299792458.0
#: Bytes of phases that a task holds at once; the exponential takes about three times as much for a moment.
PHASE_BYTES = 128 << 20


def cg(a: Callable[[np.ndarray], np.ndarray], b: np.ndarray, x0: np.ndarray | None = None, m: Callable[[np.ndarray], np.ndarray] | None = None, maxiter: int = 100, tol: float = 1e-5, steps: list[int] | None = None) -> np.ndarray:
    """Solves a(x) = b for a symmetric positive definite a. A zero b returns the start vector at once. ``steps`` gets the number of steps."""
    x = np.zeros_like(b) if x0 is None else x0.copy()
    size = float(np.sqrt(b @ b))
    if size == 0:
        return x
    m = m or (lambda r: r)
    r = b - a(x)
    z = m(r)
    p, rho = z.copy(), float(r @ z)
    for done in range(maxiter + 1):
        if done == maxiter or float(np.sqrt(r @ r)) <= tol * size:
            if steps is not None:
                steps.append(done)
            break
        ap = a(p)
        alpha = rho / float(p @ ap)
        x, r = x + alpha * p, r - alpha * ap
        z = m(r)
        rho, last = float(r @ z), rho
        p = z + (rho / last) * p
    return x


def airy_beam(mu: np.ndarray, freq: float, diameter: float, terms: int = 40) -> np.ndarray:
    """Power beam (2 J1(x)/x)^2, x = pi D nu/c sin(theta), by its power series; 0 below the horizon."""
    q = (np.pi * diameter * freq / C / 2) ** 2 * np.maximum(1 - mu * mu, 0)
    term = total = np.ones_like(q)
    for k in range(1, terms):
        term = term * -q / (k * (k + 1))
        total = total + term
    return np.where(mu >= 0, total * total, 0.0)


def tile_pixels(rows: int, pixels: int, budget: int = PHASE_BYTES) -> int:
    """Pixels of a tile whose phases for ``rows`` rows fit the budget; all of them where they do."""
    return int(min(max(pixels, 1), max(1, budget // (16 * max(rows, 1)))))


class Frame:
    """The measurement operator of one frame: rows (baselines and channels) by pixels, tile by tile.

    A tile's phases are made when they are needed; where one tile holds all pixels they are kept.
    """

    def __init__(self, s: np.ndarray, b: np.ndarray, w: np.ndarray, nu: np.ndarray, zenith: np.ndarray | None = None, diameter: float | None = None, budget: int = PHASE_BYTES) -> None:
        self.s, self.b, self.w, self.nu = s, b, w, nu
        self.zenith, self.diameter = zenith, diameter
        size = tile_pixels(len(w), len(s), budget)
        self.tiles = [slice(i, min(i + size, len(s))) for i in range(0, len(s), size)]
        self._kept = self._phases(self.tiles[0]) if len(self.tiles) == 1 else None

    def _beams(self, tile: slice) -> dict[float, np.ndarray]:
        mu = self.s[tile] @ self.zenith
        return {f: airy_beam(mu, f, self.diameter) for f in np.unique(self.nu)}

    def _phases(self, tile: slice) -> np.ndarray:
        kernel = np.exp(2j * np.pi / C * self.nu[:, None] * (self.b @ self.s[tile].T))
        if self.diameter:
            for f, beam in self._beams(tile).items():
                kernel[self.nu == f] *= beam
        return kernel

    def phases(self, tile: slice) -> np.ndarray:
        return self._phases(tile) if self._kept is None else self._kept

    def forward(self, x: np.ndarray) -> np.ndarray:
        return sum((self.phases(t) @ x[t] for t in self.tiles), np.zeros(len(self.w), complex))

    def adjoint(self, v: np.ndarray) -> np.ndarray:
        """Of weighted rows."""
        return np.concatenate([(self.phases(t).conj().T @ (self.w * v)).real for t in self.tiles]) if self.tiles else np.zeros(0)

    def normal(self, x: np.ndarray) -> np.ndarray:
        return self.adjoint(self.forward(x))

    def diagonal(self) -> np.ndarray:
        if not self.diameter:
            return np.full(len(self.s), float(self.w.sum()))
        return np.concatenate([sum(beam**2 * self.w[self.nu == f].sum() for f, beam in self._beams(t).items()) for t in self.tiles])


def regularised(frame: Frame, v: np.ndarray, eta: float, x0: np.ndarray | None = None, tol: float = 1e-5, maxiter: int = 100, steps: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(map, dirty map) of a frame's rows v; zeros where no weight is left, the dirty map twice where eta is not above zero."""
    total = float(frame.w.sum())
    if total == 0:
        return np.zeros(len(frame.s)), np.zeros(len(frame.s))
    right, lam = frame.adjoint(v), eta * total
    if eta <= 0:
        return right / total, right / total
    squares = frame.diagonal()
    return cg(lambda u: frame.normal(u) + lam * u, right, x0, lambda r: r / (squares + lam), maxiter, tol, steps), right / total


def frame_columns(rows: DataFrame, diameter: float | None) -> list[str]:
    return ["frame", "re", "im", "w", "bx", "by_", "bz", *(["freq"] if "freq" in rows.columns else []), *(["zx", "zy", "zz"] if diameter else [])]


def grid_of(pixels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and unit vectors of a grid, collected once: 12 nside^2 rows, however many frames there are."""
    grid = pixels.select("pix", "x", "y", "z").orderBy("pix").toPandas()
    return grid["pix"].to_numpy(np.int64), grid[["x", "y", "z"]].to_numpy(float)


def frame_of(table, s: np.ndarray, freq: float, diameter: float | None, budget: int = PHASE_BYTES) -> tuple[Frame, np.ndarray]:
    """The operator and the rows of one frame; table: columns by name, as Arrow or pandas."""
    col = lambda c: np.asarray(table[c].to_numpy(), float)
    w, names = col("w"), getattr(table, "column_names", None) or list(table.columns)
    nu = col("freq") if "freq" in names else np.full(len(w), freq)
    zenith = np.array([col(c)[0] for c in ("zx", "zy", "zz")]) if diameter else None
    return Frame(s, np.stack([col(c) for c in ("bx", "by_", "bz")], 1), w, nu, zenith, diameter, budget), col("re") + 1j * col("im")


def tikhonov(rows: DataFrame, pixels: DataFrame, freq: float = 1575420000.0, eta: float = 1e-2, diameter: float | None = None, budget: int = PHASE_BYTES) -> DataFrame:
    """rows(frame, re, im, w, bx, by_, bz[, freq]) to (frame, pix, regularised, dirty).

    Frames are independent here (no warm start), so each is one Arrow group. Its phases are made in tiles of pixels within
    ``budget`` bytes. A column freq gives each row its channel. With a ``diameter`` rows also have the frame's boresight (zx, zy, zz), and
    each channel's power beam weighs the sky, so the Jacobi step differs from pixel to pixel.
    ``eta`` at or below zero gives the dirty map twice. An empty frame gives zeros. Grids or frames too large for one
    task: operators/tiled.py.
    """
    pix, s = grid_of(pixels)

    def run(table: pa.Table) -> pa.Table:
        x, d = regularised(*frame_of(table, s, freq, diameter, budget), eta)
        return pa.table({"frame": pa.array(np.full(len(pix), table["frame"][0].as_py()), pa.int32()), "pix": pa.array(pix.astype(np.int32)), "regularised": x, "dirty": d})

    return rows.select(*frame_columns(rows, diameter)).groupBy("frame").applyInArrow(run, "frame int, pix int, regularised double, dirty double")
