"""Merged alarms against a graph walked by hand, fits against dense least squares, a planted source against its sidelobes."""

import numpy as np

from skyfold.operators.confirm import C, candidates, confirm, fit
from skyfold.operators.pixels import centres, corners

FREQ = 1575420000.0
ROWS = "frame int, re double, im double, w double, bx double, by_ double, bz double"


def walked(pix, nside):
    """Smallest pixel of each pixel's component: corners compared pair by pair."""
    c = corners(pix, nside)
    touch = (np.abs(c[:, None, :, None] - c[None, :, None, :]).max(-1) < 1e-7).any((2, 3))
    label = {}
    for start in range(len(pix)):
        if start in label:
            continue
        seen, todo = {start}, [start]
        while todo:
            for j in np.flatnonzero(touch[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        label |= dict.fromkeys(seen, min(int(pix[j]) for j in seen))
    return [label[i] for i in range(len(pix))]


def test_components_are_those_of_the_pixel_graph(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for f, (nside, share) in enumerate([(8, 0.2), (8, 0.35), (8, 1.0), (8, 0.01)]):
        pix = np.flatnonzero(rng.random(12 * nside * nside) < share)
        z = rng.integers(0, 5, len(pix)).astype(float)  # ties
        rows += [(f, int(p), float(v)) for p, v in zip(pix, z, strict=True)]
        for p, v, c in zip(pix.tolist(), z.tolist(), walked(pix, nside), strict=True):
            want.setdefault((f, c), []).append((-v, p))
    rows += [(0, rows[0][1], -9.0), (0, None, 1.0), (None, 3, 1.0), (0, 3, None), (0, 5, float("nan")), (0, 12 * 64, 1.0), (0, -1, 1.0)]
    got = {(r.frame, r.component): (r.pixels, r.pix, r.z) for r in candidates(spark.createDataFrame(rows, "frame int, pix int, z double").repartition(5), 8).collect()}
    assert got == {k: (len(v), min(v)[1], -min(v)[0]) for k, v in want.items()}
    assert candidates(spark.createDataFrame([], "frame int, pix int, z double"), 8).count() == 0


def sky(spark, rng, nside, frames):
    pix = np.arange(12 * nside * nside)
    at = centres(pix, nside)
    base = {f: rng.normal(0, 1.5, (30, 3)) for f in range(frames)}
    rows = [(f, 0.0, 0.0, float(1 + i % 3), *map(float, b)) for f in base for i, b in enumerate(base[f])]
    grid = spark.createDataFrame([(int(p), *map(float, v)) for p, v in zip(pix, at, strict=True)], "pix int, x double, y double, z double")
    w = 1.0 + np.arange(30) % 3

    def psf(f, to):
        k = 2 * np.pi * FREQ / C * base[f]
        return (w[:, None] * np.cos(k @ (at - to).T)).sum(0) / w.sum()

    return at, spark.createDataFrame(rows, ROWS), grid, psf


def test_fits_equal_dense_least_squares_whatever_the_tiles(spark):
    rng = np.random.default_rng(9)
    at, rows, grid, psf = sky(spark, rng, 4, 2)
    maps = {f: rng.normal(size=192) for f in range(2)}
    maps[1][100:] = np.nan  # pixels without a value: a map of 100
    cells = [(f, p, None if np.isnan(v) else float(v)) for f in maps for p, v in enumerate(maps[f])] + [(5, 0, 1.0)]
    to = [(f, f"t{i % 290}", *map(float, v / np.linalg.norm(v))) for f in range(2) for i, v in enumerate(rng.normal(size=(300, 3)))]
    df = spark.createDataFrame([*to, to[0], (0, None, 1.0, 0.0, 0.0), (9, "far", 1.0, 0.0, 0.0)], "frame int, template string, x double, y double, z double")
    for tile in (50, 1024):
        got = fit(rows, spark.createDataFrame(cells, "frame int, pix int, z double"), grid, df, FREQ, tile=tile).collect()
        assert len(got) == 600
        for r in got[::7]:
            have = ~np.isnan(maps[r.frame])
            p, z = psf(r.frame, np.array([r.x, r.y, r.z]))[have], maps[r.frame][have]
            assert np.isclose(r.amplitude, p @ z / (p @ p)) and np.isclose(r.r2, (p @ z) ** 2 / (p @ p) / (z @ z))
    flat = fit(rows, spark.createDataFrame([(0, 1, 0.0)], "frame int, pix int, z double"), grid, df, FREQ).first()
    assert flat.amplitude == 0 and flat.r2 is None
    assert fit(rows.limit(0), spark.createDataFrame(cells, "frame int, pix int, z double"), grid, df, FREQ).count() == 0


def test_a_planted_source_stands_out_and_a_known_one_does_not(spark):
    rng = np.random.default_rng(10)
    at, rows, grid, psf = sky(spark, rng, 8, 2)
    new, known = 300, at[500] + 0.02
    known /= np.linalg.norm(known)
    maps = {0: 9 * psf(0, at[new]) + rng.normal(0, 0.3, 768), 1: 9 * psf(1, known) + rng.normal(0, 0.3, 768)}
    z = spark.createDataFrame([(f, p, float(v)) for f in maps for p, v in enumerate(maps[f])], "frame int, pix int, z double")
    sources = spark.createDataFrame([(f, "known", *map(float, known)) for f in range(2)] + [(7, "other", 1.0, 0.0, 0.0)], "frame int, name string, x double, y double, z double")
    found = candidates(z.filter("z > 3"), 8)
    got = confirm(found, rows, z, grid, sources, FREQ).collect()
    best = {f: max((r for r in got if r.frame == f), key=lambda r: r.z) for f in range(2)}
    assert best[0].pix == new and abs(best[0].amplitude - 9) < 0.5 and best[0].r2 > 0.8 and best[0].contrast > 0.5
    assert best[1].known_r2 > 0.8 and best[1].contrast < 0.05
    bare = confirm(found, rows, z, grid, sources.limit(0), FREQ).collect()
    assert {r.known_r2 for r in bare} == {0.0} and all(r.contrast == r.r2 for r in bare)
