"""Gains against planted ones, a dense least-squares solution and the rule of the weights; odd rows."""

import numpy as np

from skyfold.operators.calibrate import NU, alternate, gains, residuals

SCHEMA = "interval long, a1 int, a2 int, re double, im double, w double, mre double, mim double, note string"


def planted(rng, n, intervals, noise, spoilt, dead=()):
    rows, truth = [], {}
    for f in range(intervals):
        g = (0.8 + 0.4 * rng.random(n)) * np.exp(1j * rng.normal(0, 0.5, n))
        g[0] = abs(g[0])
        truth[f] = g
        for t in range(2):
            for p in range(n):
                for q in range(p + 1, n):
                    m = complex(*rng.normal(0, 5, 2))
                    v = g[p] * m * np.conj(g[q]) + complex(*rng.normal(0, noise, 2)) + (80 if rng.random() < spoilt else 0)
                    w = 0.0 if p in dead or q in dead else 1 / noise**2
                    v = complex(v)
                    rows.append((f, p, q, v.real, v.imag, w, m.real, m.imag, "x") if (p + q + t) % 3 else (f, q, p, v.real, -v.imag, w, m.real, -m.imag, "y"))
    return rows, truth


def test_planted_gains_come_back_and_a_dead_antenna_has_none(spark):
    rng = np.random.default_rng(5)
    rows, truth = planted(rng, 9, 5, 0.05, 0.05, dead=(4,))
    df = spark.createDataFrame(rows, SCHEMA)
    solved = gains(df).persist()
    got = {(r.interval, r.a): complex(r.re, r.im) for r in solved.collect()}
    assert set(got) == {(f, a) for f in range(5) for a in range(9) if a != 4}
    assert max(abs(got[f, a] - truth[f][a]) for f, a in got) < 0.02
    plain = {(r.interval, r.a): complex(r.re, r.im) for r in gains(df, nu=None).collect()}
    assert max(abs(plain[k] - truth[k[0]][k[1]]) for k in plain) > 0.05  # the spoilt rows pull plain least squares
    left = residuals(df, solved).collect()
    assert len(left) == len(rows) and {r.note for r in left} == {"x", "y"}
    off = [abs(complex(r.re, r.im)) for r in left if 4 not in (r.a1, r.a2)]
    assert np.median(off) < 0.15 and max(off) > 50  # an outlier stays whole in what is left
    assert all((r.re, r.im, r.w) == (0, 0, 0) for r in left if 4 in (r.a1, r.a2))


def test_the_end_is_a_fixed_point_of_reweighted_least_squares(spark):
    rng = np.random.default_rng(6)
    rows, _ = planted(rng, 6, 1, 0.2, 0.1)
    g = np.zeros(6, complex)
    for r in gains(spark.createDataFrame(rows, SCHEMA), tol=1e-10, rounds=200).collect():
        g[r.a] = complex(r.re, r.im)
    p, q, v, m, w = (np.array(c) for c in zip(*[(r[1], r[2], complex(r[3], r[4]), complex(r[6], r[7]), r[5]) for r in rows], strict=True))
    wt = w * (NU + 2) / (NU + w * abs(v - g[p] * m * g[q].conj()) ** 2)
    for a in range(6):  # each gain solves its own linear least squares given the others
        z = np.where(p == a, m * g[q].conj(), np.where(q == a, m.conj() * g[p].conj(), 0))
        d = np.where(q == a, v.conj(), v)
        assert abs((wt * d * z.conj()).sum() / (wt * abs(z) ** 2).sum() - g[a]) < 1e-6


def test_odd_rows_leave_no_trace(spark):
    rng = np.random.default_rng(7)
    rows, _ = planted(rng, 5, 2, 0.1, 0.0)
    nan, none = float("nan"), None
    odd = [(0, 1, 2, nan, 0.0, 1.0, 1.0, 1.0, ""), (0, 1, 2, 1.0, 0.0, none, 1.0, 1.0, ""), (none, 1, 2, 1.0, 0.0, 1.0, 1.0, 1.0, ""), (0, none, 2, 1.0, 0.0, 1.0, 1.0, 1.0, ""), (0, 3, 3, 9.0, 9.0, 9.0, 9.0, 9.0, ""),
           (0, -1, 3, 9.0, 9.0, 9.0, 9.0, 9.0, ""), (0, 1, 2, float("inf"), 0.0, 1.0, 1.0, 1.0, ""), (0, 1, 2, 1.0, 0.0, -1.0, 1.0, 1.0, ""), (7, 1, 2, 1.0, 0.0, 0.0, 1.0, 1.0, "")]
    with_odd, without = ({(r.interval, r.a): (r.re, r.im) for r in gains(spark.createDataFrame(x, SCHEMA), tol=1e-5).collect()} for x in (rows + odd, rows))
    assert set(with_odd) == set(without) and all(np.allclose(with_odd[k], without[k], atol=1e-9) for k in without)
    doubled, once = ({(r.interval, r.a): (r.re, r.im) for r in gains(spark.createDataFrame(x, SCHEMA), nu=None).collect()} for x in (rows + rows, rows))
    assert all(np.allclose(doubled[k], once[k], atol=1e-6) for k in once)
    assert gains(spark.createDataFrame([], SCHEMA)).count() == 0
    assert residuals(spark.createDataFrame([], SCHEMA), gains(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_model_of_zero_gives_no_gain():
    assert not alternate(np.zeros((3, 3), complex), np.zeros((3, 3)), np.zeros(3, complex), 1e-9).any()
