"""Tiled and warm-started maps, and late rows of the filter stream."""

import numpy as np
import pytest

import __spark_entry__ as entry
from skyfold.operators.filter import START, step
from skyfold.operators.pixels import centres
from skyfold.operators.solve import C, Frame, airy_beam, regularised, tile_pixels
from skyfold.operators.tiled import solve

ROW = "frame int, re double, im double, w double, bx double, by_ double, bz double"


def grid(spark, nside):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(centres(np.arange(12 * nside * nside), nside))], "pix int, x double, y double, z double")


def rows_of(rng, frame, n, w=None):
    w = rng.uniform(0.5, 2, n) if w is None else np.full(n, w)
    return np.column_stack([np.full(n, frame), rng.normal(size=(n, 2)), w, rng.normal(size=(n, 3))])


def as_rows(table):
    return [(int(r[0]), *map(float, r[1:])) for r in table]


def dense(table, pix, eta, nu=1575420000.0, beam=None):
    k = np.exp(2j * np.pi / C * nu * (table[:, 4:7] @ pix.T))
    k = k if beam is None else k * beam
    w, v = table[:, 3], table[:, 1] + 1j * table[:, 2]
    return np.linalg.solve((k.conj().T @ (w[:, None] * k)).real + eta * w.sum() * np.eye(len(pix)), (k.conj().T @ (w * v)).real)


def test_planner():
    assert tile_pixels(276, 196608, 1 << 30) * 276 * 16 <= 1 << 30 and tile_pixels(276, 48, 1 << 30) == 48 and tile_pixels(10**9, 48, 1) == 1
    rng = np.random.default_rng(3)
    b, w, s = rng.normal(size=(30, 3)), rng.uniform(1, 2, 30), centres(np.arange(192), 4)
    one, many = Frame(s, b, w, np.full(30, 1.5e9)), Frame(s, b, w, np.full(30, 1.5e9), budget=16 * 30 * 7)
    x, v = rng.normal(size=192), rng.normal(size=30) + 1j * rng.normal(size=30)
    assert len(one.tiles) == 1 and len(many.tiles) == 28 and np.allclose(one.forward(x), many.forward(x)) and np.allclose(one.adjoint(v), many.adjoint(v))


def test_tiled_solver_equals_dense_systems(spark):
    """Frames of different size, one without weight, one with zero rows; tiles of 16 pixels."""
    rng = np.random.default_rng(4)
    tables = {f: rows_of(rng, f, n, w) for f, n, w in ((0, 50, None), (1, 20, None), (2, 10, 0.0))}
    tables[3] = rows_of(rng, 3, 12)
    tables[3][:, 1:3] = 0
    rows = spark.createDataFrame([r for t in tables.values() for r in as_rows(t)], ROW).repartition(3)
    out = solve(rows, grid(spark, 2), eta=0.1, tol=1e-10, budget=16 * 50 * 16).toPandas()
    for f in (0, 1):
        own = out[out.frame == f].sort_values("pix")
        want = dense(tables[f], centres(np.arange(48), 2), 0.1)
        assert own.pix.tolist() == list(range(48)) and np.allclose(own.x, want, atol=1e-7) and own.steps.nunique() == 1
    assert len(out) == 4 * 48 and not out[out.frame >= 2].x.any() and not out[out.frame >= 2].steps.any()
    near = out[["frame", "pix", "x"]]
    again = solve(rows, grid(spark, 2), eta=0.1, tol=1e-6, start=spark.createDataFrame(near), budget=16 * 50 * 16).toPandas()
    assert not again.steps.any() and np.allclose(again.sort_values(["frame", "pix"]).x, near.sort_values(["frame", "pix"]).x)


def test_tiled_solver_with_beam_and_channels(spark):
    rng = np.random.default_rng(5)
    pix, z, nu = centres(np.arange(48), 2), np.array([0.0, 0.6, 0.8]), np.where(np.arange(40) % 2, 1.5e9, 1.6e9)
    table = rows_of(rng, 0, 40)
    data = [(*r, float(f), *map(float, z)) for r, f in zip(as_rows(table), nu, strict=True)]
    out = solve(spark.createDataFrame(data, ROW + ", freq double, zx double, zy double, zz double"), grid(spark, 2), eta=0.1, diameter=0.125, tol=1e-10, budget=16 * 40 * 20).toPandas().sort_values("pix")
    want = dense(table, pix, 0.1, nu[:, None], np.stack([airy_beam(pix @ z, f, 0.125) for f in nu]))
    assert np.allclose(out.x, want, atol=1e-7)


def test_tiled_query_is_the_map_of_single_tasks(spark, sf):
    found = {n: entry.queries()[n](spark, sf).toPandas().sort_values(["frame", "pix"]) for n in ("tikhonov_map", "tikhonov_tiled")}
    one, tiled = (found[n].regularised.to_numpy() for n in ("tikhonov_map", "tikhonov_tiled"))
    assert len(one) == len(tiled) and abs(one - tiled).max() < 5e-3 * abs(one).max()


def test_warm_maps_equal_a_sequential_run_over_restarts(spark):
    """Slowly changing frames, one empty, over three queries on one checkpoint; a frame that comes again is late."""
    from skyfold.streaming.maps import solve_parts

    rng = np.random.default_rng(6)
    s, base = centres(np.arange(48), 2), rows_of(rng, 0, 40)
    tables = []
    for f in range(6):
        t = base.copy()
        t[:, 0], t[:, 1:3] = f, base[:, 1:3] * (1 + 0.01 * f)
        if f == 2:
            t[:, 3] = 0
        tables.append(t)
    frame = lambda ts: spark.createDataFrame([(run, *r) for run in (0, 1) for t in ts for r in as_rows(t)], "run long, " + ROW).repartition(2)
    parts = [frame(tables[:3]), frame(tables[3:5]), frame([tables[1], tables[5]])]
    maps, late = solve_parts(parts, grid(spark, 2), eta=0.1, tol=1e-8)
    assert sorted(map(tuple, late.collect())) == [(0, 1), (1, 1)]
    got, before, steps = maps.toPandas(), None, {}
    for t in tables:
        count = []
        f = Frame(s, t[:, 4:7], t[:, 3], np.full(40, 1575420000.0))
        x, dirty = regularised(f, t[:, 1] + 1j * t[:, 2], 0.1, before, 1e-8, steps=count)
        before = x if f.w.sum() else before
        for run in (0, 1):
            own = got[(got.run == run) & (got.frame == t[0, 0])].sort_values("pix")
            assert np.allclose(own.regularised, x, atol=1e-12) and np.allclose(own.dirty, dirty) and set(own.steps) == {count[0] if count else 0}
        steps[int(t[0, 0])] = count[0] if count else 0
    cold = solve_parts(parts[:2], grid(spark, 2), eta=0.1, tol=1e-8, warm=False)[0].toPandas().groupby("frame").steps.first()
    assert steps[0] == cold[0] and all(0 < steps[f] < cold[f] for f in (1, 3, 4)) and steps[2] == cold[2] == 0


@pytest.mark.parametrize("delay", [0.0, 25.0])
def test_no_row_of_the_filter_stream_is_lost(spark, delay):
    """Rows out of order over four parts: what steps is what a plain walk steps, all others are on the side."""
    from skyfold.streaming.pipeline import filter_parts

    rng = np.random.default_rng(7)
    rows = [(int(p), float(t), float(rng.normal()) if rng.random() < 0.9 else None, bool(rng.random() < 0.9)) for p in (*range(30), 3000) for t in rng.choice(200, 20, replace=False)]
    rows += [(5, 50.0, 1.0, True)] * 2 + [(6, None, 1.0, True), (None, 3.0, 1.0, True), (None, 4.0, 2.0, True)]
    arrives = [min(3, max(0, int((t or 0) / 50 + rng.choice([0, 0, 0, 1])))) for _, t, _, _ in rows]
    parts = [[r for r, a in zip(rows, arrives, strict=True) if a == i] for i in range(4)]
    kept, late = filter_parts([spark.createDataFrame(p, "pix long, t double, y double, ok boolean").repartition(3) for p in parts], 0.05, 0.2, delay)
    kept, late = kept.toPandas(), late.toPandas()
    assert len(kept) + len(late) == len(rows)
    states, waiting, newest, want, side = {}, [], {}, [], []
    block = lambda p: "none" if p is None else p // 1024
    for part in [*parts, [(p, np.inf, None, False) for p in (None, 0, 3000)] if delay else []]:
        waiting += part
        for p, t, _, _ in part:
            newest[block(p)] = max(newest.get(block(p), -np.inf), -np.inf if t is None else t)
        due = [r for r in waiting if r[1] is None or r[1] <= newest[block(r[0])] - delay or newest[block(r[0])] == np.inf]
        waiting = [r for r in waiting if r not in due]
        for p, t, y, ok in sorted(due, key=lambda r: (r[1] is None, r[1])):
            state = states.get(p, START)
            if t is None or state[5] is not None and t <= state[5]:
                side.append((p, t))
            elif t < np.inf:
                states[p], filtered, znorm = step(state, t, y if ok and y is not None else None, 0.05, 0.2)
                want.append((-1 if p is None else p, t, filtered, znorm))
    got = sorted(zip(kept.pix.fillna(-1).astype(int), kept.t, kept.filtered, kept.znorm, strict=True))
    assert len(late) == len(side) > 3 and np.allclose(got, sorted(want), atol=1e-9)
