"""The fixed-lag smoother against a dense least-squares solution, on odd rows and over many blocks."""

import numpy as np

from skyfold.operators.filter import START
from skyfold.operators.smoother import smooth_pixels

SCHEMA = "pix long, t double, y double, ok boolean"


def dense(t, y, seen, upto, sigma2, noise):
    """Means and variances of the fluxes of frames 0 to upto given their data, by one Gaussian system."""
    n = upto + 1
    info, right = np.zeros((2 * n, 2 * n)), np.zeros(2 * n)
    info[:2, :2] += np.diag([1 / START[2], 1 / START[4]])
    for i in range(1, n):
        d = t[i] - t[i - 1]
        w = np.linalg.inv(sigma2 * np.array([[d**3 / 3, d * d / 2], [d * d / 2, d]]))
        g = np.zeros((2, 2 * n))
        g[:, 2 * i - 2 : 2 * i], g[:, 2 * i : 2 * i + 2] = -np.array([[1, d], [0, 1]]), np.eye(2)
        info += g.T @ w @ g
    for i in np.flatnonzero(seen[:n]):
        info[2 * i, 2 * i] += 1 / noise
        right[2 * i] += y[i] / noise
    cov = np.linalg.inv(info)
    return (cov @ right)[::2], np.diag(cov)[::2]


def test_equals_a_dense_smoother(spark):
    rng, rows = np.random.default_rng(3), []
    pixels = [*range(20), 1500, 4000, -7]
    for p in pixels:
        n = int(rng.integers(1, 16))
        for t in np.sort(rng.choice(60, n, replace=False)):
            rows.append((p, float(t), float(rng.normal()) if rng.random() < 0.9 else None, bool(rng.random() < 0.85)))
    rows += [(None, 1.0, 1.0, True), (3, None, 1.0, True)]
    for lag in (0, 4, 30):
        got = {(r.pix, r.k): (r.t, r.smoothed, r.variance) for r in smooth_pixels(spark.createDataFrame(rows, SCHEMA).repartition(3), 0.05, 0.2, lag).collect()}
        assert len(got) == len(rows) - 2
        for p in pixels:
            own = sorted(r for r in rows if r[0] == p and r[1] is not None)
            t, seen = np.array([r[1] for r in own]), np.array([r[2] is not None and r[3] for r in own])
            y = np.array([r[2] or 0.0 for r in own])
            for k in range(len(own)):
                mean, variance = dense(t, y, seen, min(k + lag, len(own) - 1), 0.05, 0.2)
                assert got[p, k + 1][0] == t[k] and np.allclose(got[p, k + 1][1], mean[k], atol=1e-4) and np.isclose(got[p, k + 1][2], variance[k], rtol=1e-3, atol=1e-4)
    assert smooth_pixels(spark.createDataFrame([], SCHEMA)).count() == 0
