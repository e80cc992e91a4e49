"""Whitening against a dense eigenvalue decomposition, and on odd rows."""

import numpy as np
import pytest

from skyfold.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, label int, x int, component string"


def frame(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], 1, 2, "c") for i, v in zip(ids, vectors, strict=True)], SCHEMA).repartition(3)


def dense(vectors):
    x = np.floor(256 * np.array(vectors)).astype(np.int64)
    fit = np.unique(x, axis=0)
    values, turn = np.linalg.eigh(np.cov(fit.T.astype(float), bias=True))
    return x, fit, values[::-1], turn[:, ::-1]


@pytest.mark.parametrize(("d", "decay"), [(3, 0.5), (24, 0.6), (40, 1.0)])
def test_equals_a_dense_decomposition(spark, d, decay):
    rng = np.random.default_rng(d)
    vectors = [*(rng.standard_normal((150, d)) * decay ** np.arange(d)), *[np.full(d, 0.25)] * 60]
    x, fit, values, turn = dense(vectors)
    rows = whitening.whiten(frame(spark, vectors)).collect()
    assert len(rows) == len(vectors) * min(4, d)
    got = {(r.vec_id, r.component): r for r in rows}
    sums = fit.sum(0)
    for j in range(min(4, d)):
        want = (x - sums / len(fit)) @ turn[:, j] / np.sqrt(values[j])
        have = np.array([got[i, j + 1].whitened for i in range(len(vectors))])
        assert np.allclose(have, want * np.sign(have @ want), atol=1e-9)
        assert abs(got[0, j + 1].explained / (values[j] / values.sum()) - 1) < 1e-12
    assert all(r.n == len(fit) and r.deviation == int(((len(fit) * x[r.vec_id] - sums) ** 2).sum()) and r.identity_error < 1e-10 for r in rows)


def test_a_narrow_block_gets_wider_on_a_flat_spectrum(spark):
    rng = np.random.default_rng(1)
    vectors = whitening.integers(frame(spark, rng.standard_normal((400, 48))))
    flat = whitening.fit(vectors, block=6)
    assert flat.width == 48 and max(flat.residuals) < 1e-13
    steep = whitening.fit(whitening.integers(frame(spark, rng.standard_normal((200, 48)) * 0.2 ** np.arange(48))), block=6)
    assert steep.width == 6 and max(steep.residuals) <= whitening.TOLERANCE * 48


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    base = [[0.1, 0.2, 0.9], [0.4, -0.5, 0.1], [-0.3, 0.7, 0.2], [0.1, 0.2, 0.9], [-0.0, 0.0, 0.0]]
    rows = frame(spark, [*base, None, [], [1, None, 2], [nan, 1, 1], [inf, 0, 0], [1, 2], [1e300, 0, 0]], [0, 1, 2, None, 2, 5, 6, 7, 8, 9, 10, 11])
    got = whitening.whiten(rows).collect()
    assert sorted({r.vec_id for r in got}, key=str) == [0, 1, 2, None] and len(got) == 15 and {r.n for r in got} == {4}
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, [[0.5, 0.5]] * 3)).count() == 0 and whitening.whiten(frame(spark, [[]])).count() == 0
    line = whitening.whiten(frame(spark, [[0.5, 0.5], [1.5, 1.5], [2.5, 2.5]])).collect()
    assert {r.component for r in line} == {1} and abs(line[0].explained - 1) < 1e-12
    huge = whitening.whiten(frame(spark, [[1e12, 0], [0, 1.0], [-1e12, 2.0]])).collect()
    assert all(r.deviation is None for r in huge if r.vec_id != 1)
