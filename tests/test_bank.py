"""The model bank against dense Gaussian conditioning, its choice of model on planted curves, weights through a flare, odd rows."""

from math import factorial

import numpy as np
import pytest

from skyfold.operators.bank import Model, filter_bank

NOISE, DIFFUSE = 0.2, 1e3
MODELS = [Model(1, 0.05), Model(1, 0.5), Model(2, 0.05)]


def moves(q, s, d):
    a = np.array([[d ** (j - i) / factorial(j - i) if j >= i else 0.0 for j in range(q + 1)] for i in range(q + 1)])
    c = np.array([[s * d ** (2 * q - i - j + 1) / (factorial(q - i) * factorial(q - j) * (2 * q - i - j + 1)) for j in range(q + 1)] for i in range(q + 1)])
    return a, c


def dense(model, t, y):
    """Flux at the last time and log evidence of all rows that have data, from the joint covariance of all frames."""
    q, n = model.order, len(t)
    cov = [np.eye(q + 1) * DIFFUSE]
    for i in range(1, n):
        a, c = moves(q, model.sigma2, t[i] - t[i - 1])
        cov.append(a @ cov[-1] @ a.T + c)
    flux = np.array([[(cov[min(i, j)] @ moves(q, 1.0, abs(t[j] - t[i]))[0].T)[0, 0] for j in range(n)] for i in range(n)])
    have = ~np.isnan(y)
    s = flux[np.ix_(have, have)] + NOISE * np.eye(have.sum())
    solved = np.linalg.solve(s, y[have]) if have.any() else np.zeros(0)
    return flux[-1, have] @ solved, -(np.linalg.slogdet(2 * np.pi * s)[1] + y[have] @ solved) / 2 if have.any() else 0.0


def frame(spark, curves):
    rows = [(p, float(a), None if np.isnan(b) else float(b), True) for p, (t, y) in curves.items() for a, b in zip(t, y, strict=True)]
    return spark.createDataFrame(rows, "pix long, t double, y double, ok boolean").repartition(5)


def test_means_and_weights_are_those_of_dense_conditioning(spark):
    rng = np.random.default_rng(3)
    curves = {}
    for p in (*range(20), 5000):  # more and fewer pixels than a block steps at once
        t = np.cumsum(rng.uniform(0.2, 2.0, 9))
        y = rng.normal(0, 2, 9).cumsum()
        y[rng.random(9) < 0.2] = np.nan
        curves[p] = t, y
    got = {(r.pix, r.k): r for r in filter_bank(frame(spark, curves), MODELS, NOISE, DIFFUSE).collect()}
    assert len(got) == 21 * 9
    for p, (t, y) in curves.items():
        for k in range(1, 10):
            flux, evidence = np.array([dense(m, t[:k], y[:k]) for m in MODELS]).T
            w = np.exp(evidence - evidence.max())
            w /= w.sum()
            assert np.isclose(got[p, k].mean, w @ flux, atol=1e-6) and np.isclose(got[p, k].weight, w.max(), atol=1e-6)
            assert np.isclose(w[got[p, k].best], w.max(), atol=1e-8)


def test_the_model_that_made_a_curve_wins(spark):
    rng = np.random.default_rng(4)
    models, curves = [Model(1, 0.01), Model(1, 10.0), Model(2, 0.01)], {}
    for p in range(30):
        m, x = models[p % 3], np.zeros(models[p % 3].order + 1)
        y = []
        a, c = moves(m.order, m.sigma2, 1.0)
        for _ in range(120):
            x = a @ x + rng.multivariate_normal(np.zeros(len(x)), c)
            y.append(x[0] + rng.normal(0, NOISE**0.5))
        curves[p] = np.arange(120.0), np.array(y)
    last = {r.pix: r.best for r in filter_bank(frame(spark, curves), models, NOISE, DIFFUSE).filter("k = 120").collect()}
    assert sum(last[p] == p % 3 for p in last) >= 27


def test_a_flare_moves_no_weight_where_weights_freeze(spark):
    t = np.arange(40.0)
    y = np.sin(t / 9)
    y[30:33] += 60.0
    bank = [Model(1, 0.001), Model(1, 50.0)]
    for calm, moved in ((4.0, False), (float("inf"), True)):
        got = {r.k: r for r in filter_bank(frame(spark, {1: (t, y)}), bank, NOISE, DIFFUSE, calm=calm).collect()}
        assert got[30].best == 0 and abs(got[31].znorm) > 4 and got[31].scale == 0
        assert (got[31].best == 1) == moved and (moved or got[31].weight == pytest.approx(got[30].weight, abs=1e-12))
    forgot = filter_bank(frame(spark, {1: (t, y)}), bank, NOISE, DIFFUSE, forget=0.5).filter("k = 29").first()
    assert forgot.weight < filter_bank(frame(spark, {1: (t, y)}), bank, NOISE, DIFFUSE).filter("k = 29").first().weight


def test_odd_rows(spark):
    rows = [(None, 1.0, 2.0, True), (1, 1.0, None, True), (1, 2.0, 5.0, None), (1, 2.0, 5.0, None), (1, 3.0, 1.0, True)]
    got = filter_bank(spark.createDataFrame(rows, "pix long, t double, y double, ok boolean"), MODELS, NOISE, DIFFUSE).collect()
    mine = sorted((r for r in got if r.pix == 1), key=lambda r: r.k)
    assert [r.k for r in mine] == [1, 2, 3, 4] and [r.mean for r in mine[:3]] == [0, 0, 0] and {round(r.weight, 9) for r in mine[:3]} == {round(1 / 3, 9)}
    assert [r.k for r in got if r.pix is None] == [1]
    assert filter_bank(spark.createDataFrame([], "pix long, t double, y double, ok boolean"), MODELS).count() == 0
    for wrong in ([], [Model(3, 1.0)], [Model(1, 0.0)]):
        with pytest.raises(ValueError):
            filter_bank(spark.createDataFrame(rows, "pix long, t double, y double, ok boolean"), wrong)
    with pytest.raises(Exception, match="without a time"):
        filter_bank(spark.createDataFrame([(1, None, 1.0, True)], "pix long, t double, y double, ok boolean"), MODELS).collect()


def test_sequential_tests_are_their_folds(spark):
    sf = "/root/testdata/sf0.01"  # here some pixels are decided either way and some stay open
    from skyfold import catalogue
    from skyfold.plans.filtering import WALD

    curves = {}
    for r in spark.read.parquet(f"{sf}/events.parquet").orderBy("ts", "event_id").collect():
        curves.setdefault(r.user_id, []).append((r.event_id, r.value))
    low, wald = {}, {}
    for p, rows in curves.items():
        g, s, past = 0, 0, None
        for k, (i, y) in enumerate(rows, 1):
            g = max(0, g - round((y - 1) * 1000) - 250)
            s += round((y - 50) * 20) - 250
            low[i], past = g, past or (("shift" if s > 0 else "none", k) if abs(s) >= WALD else None)
        wald[p] = past or ("open", len(rows))
    q = catalogue.queries()
    assert {r.event_id: r.g for r in q["cusum_negative"](spark, sf).collect()} == low
    assert {r.pix: (r.decision, r.frames) for r in q["sprt"](spark, sf).collect()} == wald
    assert {d for d, _ in wald.values()} == {"shift", "none", "open"}
