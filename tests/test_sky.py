"""Kernels against NumPy, identities of the imaging operators, and every query against its SQL."""

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from skyfold.fixtures import register, with_views
from skyfold.operators.filter import START, Block, filter_pixels, step
from skyfold.operators.pixels import centres, corners
from skyfold.operators.solve import cg, tikhonov

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(table):
    def plain(v):
        if v is None or (isinstance(v, float) and np.isnan(v)):
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted((tuple(plain(v) for v in r) for r in table), key=repr)


@pytest.mark.parametrize("name", ["dirty_map", "apply_inverse_gains", "baseline_rotate", "pixel_grid", "airy_beam", "iwp_filter_gap", "hessian_diag", "cg_two_steps", "rephase", "lm_dirty_stokes", "satellite_tracks", "stokes_jones", "frame_has_observation", "color_limits", "track_trails", "stream_prepared", "stream_filter"])
def test_query_equals_its_sql(spark, sf, name):
    got = entry.queries()[name](spark, sf)
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = db.sql(f"select {', '.join(got.columns)} from ({entry.oracle_sql()[name]}) q").fetchall()
    assert rows(got.collect()) == rows(want)


@pytest.mark.parametrize("name", ["hessian_diag", "hessian_matvec", "cg_step", "cg_two_steps", "lm_dirty_stokes", "cube_writer", "image_frame"])
def test_imaging_keeps_every_frame(spark, sf, name):
    register(spark, sf)
    want = {r.frame for r in spark.sql(with_views("select distinct frame from vis", "spark")).collect()}
    assert len(want) == 16 and {r.frame for r in entry.queries()[name](spark, sf).select("frame").distinct().collect()} == want


def test_stokes_images_equal_numpy_on_the_whole_grid(spark, sf):
    register(spark, sf)
    vis = spark.sql(with_views("select v.frame, p.e-q.e u, p.n-q.n v, p.u-q.u w_, v.re, v.im, v.w from vis v join ant p on p.a=v.a1 join ant q on q.a=v.a2", "spark")).toPandas()
    i, j = np.divmod(np.arange(576), 24)
    x, y = (i - 12) * 0.02, (j - 12) * 0.02
    n = np.sqrt(1 - x * x - y * y)
    frames = {}
    for frame, r in vis.groupby("frame"):
        ph = 2 * np.pi * 1575420000.0 / 299792458.0 * (np.outer(x, r.u) + np.outer(y, r.v) - np.outer(n - 1, r.w_))
        frames[frame] = (np.cos(ph) * (0.95 * r.re * r.w).to_numpy() - np.sin(ph) * (0.95 * r.im * r.w).to_numpy()).sum(1) / n
    got = entry.queries()["lm_dirty_stokes"](spark, sf).toPandas()
    assert len(got) == 16 * 576
    assert all(np.allclose(g.sort_values(["i", "j"]).stokes_i, frames[f], atol=1e-6) for f, g in got.groupby("frame"))
    mean = entry.queries()["cube_mean_ext"](spark, sf).filter("stokes='I'").toPandas().sort_values(["x", "y"]).cube_mean
    assert len(mean) == 576 and np.allclose(mean, np.mean(list(frames.values()), axis=0), atol=1e-5)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_query_has_a_callable_and_known_sql():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_pixel_query_equals_numpy(spark, sf):
    got = np.array([tuple(r) for r in entry.queries()["pixel_grid"](spark, sf).orderBy("pix").collect()])
    assert np.allclose(got[:, 1:], centres(np.arange(192), 4), atol=1e-9)


@pytest.mark.parametrize("nside", [1, 2, 4, 8])
def test_pixel_centres_are_distinct_and_corners_surround_them(nside):
    pix = np.arange(12 * nside * nside)
    c, k = centres(pix, nside), corners(pix, nside)
    assert np.allclose((c * c).sum(1), 1) and len(np.unique(np.round(c, 9), axis=0)) == len(pix)
    middle = k.mean(1) / np.linalg.norm(k.mean(1), axis=1)[:, None]
    assert ((middle * c).sum(1) > np.cos(0.5 / nside)).all()


def test_filter_whitens():
    rng = np.random.default_rng(0)
    sigma2, noise, z = 0.05, 0.2, []
    for _ in range(60):
        x, state = np.zeros(2), START
        for i in range(200):
            x = np.array([[1, 1], [0, 1]]) @ x + rng.multivariate_normal([0, 0], sigma2 * np.array([[1 / 3, 1 / 2], [1 / 2, 1]]))
            state, _, zn = step(state, float(i), x[0] + rng.normal(0, noise**0.5), sigma2, noise)
            if i >= 50:
                z.append(zn)
    assert abs(np.mean(z)) < 0.05 and 0.9 < np.mean(np.square(z)) < 1.1


def test_filter_coasts_over_a_gap_and_its_covariance_grows():
    state, _, _ = step(START, 0.0, 1.0, 0.05, 0.2)
    near, _, z = step(state, 1.0, None, 0.05, 0.2)
    far, _, _ = step(state, 31.0, None, 0.05, 0.2)
    assert z == 0 and far[2] > near[2] > state[2]


def test_blocks_step_as_single_pixels_do(spark):
    rng = np.random.default_rng(5)
    series = [(int(p), float(t), float(rng.normal()), bool(rng.random() < 0.8)) for p in (*range(-3, 40), 5000) for t in rng.choice(300, 40, replace=False)]
    series += [(7, 1000.0 + i, float(rng.normal()), True) for i in range(3000)]  # one long light curve
    series += [(8, 400.0, None, True), (8, 401.0, 1.0, None), (None, 3.0, 2.0, True)]
    got = {(r.pix, r.k): (r.t, r.filtered, r.znorm) for r in filter_pixels(spark.createDataFrame(series, "pix long, t double, y double, ok boolean"), 0.05, 0.2).collect()}
    assert len(got) == len(series)
    for pix in {r[0] for r in series}:
        state = START
        for k, (_, t, y, ok) in enumerate(sorted((r for r in series if r[0] == pix), key=lambda r: r[1]), 1):
            state, filtered, znorm = step(state, t, y if ok else None, 0.05, 0.2)
            assert np.allclose(got[pix, k], (t, filtered, znorm), atol=1e-9)


def test_late_rows_of_a_block_are_left_out():
    held = Block()
    at, seen = np.repeat(np.arange(20), 2), np.ones(40, bool)
    k, _, _ = held.walk(at, np.tile([1.0, 1.0], 20), np.ones(40), seen, 0.05, 0.2, skip_late=True)
    assert k.tolist() == [1, 0] * 20
    k, _, _ = held.walk(np.arange(20), np.where(np.arange(20) < 10, 0.5, 2.0), np.ones(20), seen[:20], 0.05, 0.2, skip_late=True)
    assert k.tolist() == [0] * 10 + [2] * 10


def test_cg_against_a_dense_solve():
    rng = np.random.default_rng(1)
    m = rng.normal(size=(20, 20))
    a, b = m @ m.T + np.eye(20), rng.normal(size=20)
    assert np.allclose(cg(lambda x: a @ x, b, tol=1e-10), np.linalg.solve(a, b), atol=1e-6)
    assert not cg(lambda x: a @ x, np.zeros(20)).any()


def test_tikhonov_recovers_a_point_and_empty_frames_are_zero(spark):
    rng = np.random.default_rng(2)
    pix = np.arange(192)
    s = centres(pix, 4)
    b = rng.normal(size=(300, 3)) * 0.4
    v = np.exp(2j * np.pi * 1575420000.0 / 299792458.0 * (b @ s[77]))
    data = [(0, float(z.real), float(z.imag), 1.0, *map(float, x)) for z, x in zip(v, b, strict=True)] + [(1, 1.0, 0.0, 0.0, *map(float, x)) for x in b]
    grid = spark.createDataFrame([(int(p), *map(float, x)) for p, x in zip(pix, s, strict=True)], "pix int, x double, y double, z double")
    out = tikhonov(spark.createDataFrame(data, "frame int, re double, im double, w double, bx double, by_ double, bz double"), grid).toPandas()
    first = out[out.frame == 0]
    assert first.loc[first.regularised.idxmax(), "pix"] == 77 and first.loc[first.dirty.idxmax(), "pix"] == 77
    assert not out[out.frame == 1][["regularised", "dirty"]].to_numpy().any()


def test_fan_out_keeps_every_name_and_a_batch_may_be_tried_again(spark, tmp_path):
    from skyfold.streaming.pipeline import fan_out, latest_frames, read_frames

    for name, i in (("raw", 0), ("smooth", 1), ("raw", 2)):
        spark.createDataFrame([(name, i, float(i))], "name string, seq int, v double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for log in ("log", "again"):  # a second run from the start writes the same batches
        stream = read_frames(spark, str(tmp_path / "in"), "name string, seq int, v double")
        fan_out(stream, str(tmp_path / "maps"), str(tmp_path / "latest"), str(tmp_path / log)).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "maps")).count() == 3
        assert sorted((r.name, r.seq) for r in latest_frames(spark, str(tmp_path / "latest")).collect()) == [("raw", 2), ("smooth", 1)]


def test_tikhonov_with_beam_and_channels_solves_the_dense_system(spark):
    from skyfold.operators.solve import C, airy_beam

    rng = np.random.default_rng(4)
    pix = centres(np.arange(48), 2)
    b, z, nu = rng.normal(size=(60, 3)), np.array([0.0, 0.6, 0.8]), np.where(np.arange(60) % 2, 1.5e9, 1.6e9)
    w, v = rng.uniform(0.5, 2, 60), rng.normal(size=60) + 1j * rng.normal(size=60)
    data = [(0, float(x.real), float(x.imag), float(y), *map(float, r), float(f), *map(float, z)) for x, y, r, f in zip(v, w, b, nu, strict=True)]
    grid = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(pix)], "pix int, x double, y double, z double")
    out = tikhonov(spark.createDataFrame(data, "frame int, re double, im double, w double, bx double, by_ double, bz double, freq double, zx double, zy double, zz double"), grid, eta=0.1, diameter=0.125).toPandas().sort_values("pix")
    k = np.exp(2j * np.pi / C * nu[:, None] * (b @ pix.T)) * np.stack([airy_beam(pix @ z, f, 0.125) for f in nu])
    right = (k.conj().T @ (w * v)).real
    dense = np.linalg.solve((k.conj().T @ (w[:, None] * k)).real + 0.1 * w.sum() * np.eye(48), right)
    assert np.allclose(out["dirty"], right / w.sum()) and np.allclose(out["regularised"], dense, atol=1e-4 * abs(dense).max())


def test_jones_weights_are_squared_slopes():
    from skyfold.functions.expressions import Cx, converter

    rng = np.random.default_rng(2)
    p, q = rng.normal(size=(2, 2, 2)) @ [1, 1j], rng.normal(size=(2, 2, 2)) @ [1, 1j]
    w = rng.uniform(1, 2, 4)
    cx = lambda m: [Cx(repr(float(z.real)), repr(float(z.imag))) for z in m.ravel()]
    for feed, parts in {"LINEAR": {"I": [[1, 0], [0, 1]], "Q": [[1, 0], [0, -1]], "U": [[0, 1], [1, 0]], "V": [[0, 1j], [-1j, 0]]}, "CIRCULAR": {"I": [[1, 0], [0, 1]], "Q": [[0, 1], [1, 0]], "U": [[0, 1j], [-1j, 0]], "V": [[1, 0], [0, -1]]}}.items():
        got = converter("WEIGHT", feed, True)([repr(float(x)) for x in w], cx(p), cx(q))
        for s, part in parts.items():
            assert np.isclose(eval(got[s]), (w.reshape(2, 2) * abs(p @ np.array(part) @ q.conj().T) ** 2).sum())  # noqa: S307
    with pytest.raises(NotImplementedError):
        converter("VIS", "CROSSED", False)


def test_pixel_centres_of_a_run_with_large_order_keys(spark):
    small = spark.range(192)
    near = "select a.pix, b.pix other from pix a join pix b on a.x*b.x+a.y*b.y+a.z*b.z>=9e-1"
    found = []
    for keys in (small, small.union(spark.range(900_000, 5_000_000_000, 99_999_999)).orderBy("id")):
        keys.selectExpr("id o_orderkey").createOrReplaceTempView("orders")
        found.append(rows(spark.sql(with_views(near, "spark")).collect()))
    assert found[0] == found[1] and len(found[0]) > 192


def test_arrival_of_rows_needs_no_window_over_all(spark, sf):
    from skyfold.plans import programs

    register(spark, sf)
    got, want = (spark.sql(with_views(text, "spark")) for text in (programs._ARRIVED, programs._ARRIVAL))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and rows(got.select(*want.columns).collect()) == rows(want.collect())
