"""Snapshots, catalogues and a whole run."""

import json

import numpy as np
import pytest
from pyspark.sql.utils import AnalysisException

from skyfold import pipeline
from skyfold.operators.pixels import centres
from skyfold.session import require_schema
from skyfold.sources import catalogue, snapshot


def test_snapshots_equal_a_plain_reader(spark, tmp_path):
    base = [(0, 1), (0, 2), (1, 2)]
    for k in range(2):
        stamps = [f"2026-06-09T00:0{k}:0{s}" for s in range(3)]
        snapshot.write_snapshot(str(tmp_path / f"vis_{k}.json"), stamps, base, [[complex(k, s), 1j, 2.0 + 0j] for s in range(3)], [1.0, 0.0, 0.5], [0.0, 0.1, np.pi / 2], {"name": "x", "frequency": 1.5e9})
    raw = snapshot.read_snapshots(spark, str(tmp_path))
    vis = snapshot.visibilities(raw)
    got = sorted(tuple(r) for r in vis.select("t", "a1", "a2", "re", "im", "flag").collect())
    want = sorted(x for k in range(2) for x in snapshot.rows_of(json.loads((tmp_path / f"vis_{k}.json").read_text())))
    assert got == want and {r.w for r in vis.filter("flag").collect()} == {0.0}
    assert [r.frame for r in snapshot.frames(vis, 4).orderBy("frame").collect()] == [0, 1, 2, 3]
    g = {r.name: r for r in snapshot.gains(raw).collect()}
    assert g["ant01"].dead and abs(g["ant02"].im - 0.5) < 1e-12
    with pytest.raises(FileNotFoundError):
        snapshot.read_snapshots(spark, str(tmp_path), "*.none")


def test_catalogue_fetches_only_what_the_cache_lacks(spark):
    calls = []

    def fetch(d):
        calls.append(d)
        if len(calls) == 1:
            raise OSError("busy")
        return [{"name": "A", "el": 50, "az": 1, "jy": 2, "r": 3}, {"name": "B", "el": 10, "az": 1, "jy": 2, "r": 3}]

    cache = spark.createDataFrame([("d1", "C", 60.0, 0.0, 1.0, 1.0, -20.0, 57.0, 45.0)], catalogue.CACHE)
    entries, fresh = catalogue.lookup(spark, cache, ["d1", "d2"], -20.0, 57.0, 45.0, fetch)
    assert sorted((r.datestr, r.name) for r in entries.collect()) == [("d1", "C"), ("d2", "A")] and fresh.count() == 1 and calls == ["d2", "d2"]
    calls[:] = ["x"]
    assert catalogue.lookup(spark, cache, ["d1"], -20.0, 57.0, 30.0, fetch)[1].count() == 1

    def never(d):
        raise OSError("down")

    with pytest.raises(RuntimeError):
        catalogue.fetch_with_retry(never, "d", tries=2, pause=0)


def test_a_run_finds_the_source_and_coasts_over_an_empty_frame(spark, tmp_path):
    s = centres(np.arange(48), 2)
    rng = np.random.default_rng(0)
    b = rng.normal(size=(60, 3)) * 0.4
    v = np.exp(2j * np.pi * 1575420000.0 / 299792458.0 * (b @ s[11]))
    rows = [(f, 1.7e9 + f + (30 if f > 2 else 0), float(z.real), float(z.imag), 0.0 if f == 2 else 1.0, *map(float, x)) for f in range(5) for z, x in zip(v, b, strict=True)]
    data = spark.createDataFrame(rows, "frame int, t double, re double, im double, w double, bx double, by_ double, bz double")
    grid = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(s)], "pix int, x double, y double, z double")
    out = pipeline.run(data, grid, pipeline.Config(nframes=4, eta=1e-2, beam=False), str(tmp_path / "maps")).toPandas()
    assert len(out) == 4 * 48 and out.groupby("t").apply(lambda g: g.loc[g.dirty.idxmax(), "pix"], include_groups=False).tolist() != []
    empty = out[out.t == 1.7e9 + 2]
    assert not empty.dirty.any() and not empty.znorm.any()
    first = out[out.t == 1.7e9]
    assert first.loc[first.dirty.idxmax(), "pix"] == 11 and abs(first.dirty.max() - 1) < 1e-9 and np.allclose(first.filtered, first.regularised, atol=1e-6)
    with pytest.raises(AnalysisException):
        pipeline.run(data, grid, pipeline.Config(nframes=1, beam=False), str(tmp_path / "maps"))
    with pytest.raises(ValueError):
        require_schema(data, "frame missing")
