"""Snapshot and catalogue connectors, and the region sink."""

import json
from datetime import UTC, datetime

import numpy as np
import pytest

from skyfold.session import with_conf
from skyfold.sinks import regions
from skyfold.sources import snapshot
from skyfold.sources.connectors import Catalogues, Snapshots

PUSH = {"spark__sql__python__filterPushdown__enabled": "true"}


def test_snapshot_source_equals_the_files_reader_and_prunes(spark, tmp_path):
    base = [(0, 1), (0, 2), (1, 2)]
    for k in range(3):
        stamps = [f"2026-06-09T00:0{k}:0{s}" for s in range(3)]
        snapshot.write_snapshot(str(tmp_path / f"vis_{k}.json"), stamps, base, [[complex(k, s), 1j, 2.0 + 0j] for s in range(3)], [1.0, 0.0, 0.5], [0.0, 0.1, 0.2], {"name": "x", "frequency": 1.5e9})
    spark.dataSource.register(Snapshots)
    rows = spark.read.format("snapshot").load(str(tmp_path))
    names = ["t", "a1", "a2", "re", "im", "flag", "w", "freq", "pol"]
    want = sorted(map(tuple, snapshot.visibilities(snapshot.read_snapshots(spark, str(tmp_path))).select(*names).collect()))
    assert sorted(map(tuple, rows.select(*names).collect())) == want and rows.rdd.getNumPartitions() == 3
    start = datetime(2026, 6, 9, 0, 1, 1, tzinfo=UTC).timestamp()
    with with_conf(spark, **PUSH):
        own = spark.read.format("snapshot").option("pushdown", True).load(str(tmp_path)).filter(f"file in ('vis_1.json', 'vis_2.json') and t >= {start}D and t < {start + 60}D")
        assert own.rdd.getNumPartitions() == 2 and sorted(own.select("file", "re").distinct().collect())[0].file == "vis_1.json"
        assert sorted(r[0] for r in own.select("t").distinct().collect()) == [start, start + 1, start + 59] and "vis_1.json" not in own._jdf.queryExecution().executedPlan().toString()
        assert spark.read.format("snapshot").option("pushdown", True).load(str(tmp_path)).filter("file = 'none'").count() == 0
    with pytest.raises(Exception, match="no snapshot"):
        spark.read.format("snapshot").option("suffix", ".none").load(str(tmp_path)).count()


def test_catalogue_source_fetches_in_tasks(spark, tmp_path):
    for d in ("d1", "d2"):
        (tmp_path / d).write_text(json.dumps([{"name": f"A{d}", "el": 50, "az": 1, "jy": 2, "r": 3}, {"name": "B", "el": 10, "az": 1, "jy": 2, "r": 3}]))
    spark.dataSource.register(Catalogues)
    source = lambda dates: spark.read.format("catalogue").option("url", f"file://{tmp_path}/{{datestr}}").option("dates", json.dumps(dates)).option("tries", "2").option("pause", "0")
    assert source(["d1", "d2", "d1"]).load().count() == 4 and source(["d1", "d2"]).option("elevation", "45").load().count() == 2
    with with_conf(spark, **PUSH):
        high = source(["d1", "d2", "d3"]).option("pushdown", True).load().filter("datestr = 'd1' and el >= 20")
        assert [r.name for r in high.collect()] == ["Ad1"] and high.rdd.getNumPartitions() == 1
    with pytest.raises(Exception, match="no catalogue for d3 after 2 tries"):
        source(["d3"]).load().count()


def frames(spark, times, value=0.0, npix=6):
    return spark.createDataFrame([(float(t), p, t + value, p / 3) for t in times for p in range(npix)], "t double, pix long, dirty double, other double").repartition(3)


def test_regions_are_whole_or_absent_and_a_batch_may_come_again(spark, tmp_path):
    spark.dataSource.register(regions.Regions)
    path = str(tmp_path / "maps")
    regions.create(path, [3.0, 1.0, 2.0], 6, ["dirty", "other"])
    with pytest.raises(FileExistsError):
        regions.create(path, [1.0], 6, ["dirty"])
    put = lambda df, batch: df.write.format("regions").mode("append").option("path", path).option("batch", batch).save()
    seen = lambda: {(r.frame, r.pix): r.dirty for r in regions.read(spark, path).collect()}
    assert len(seen()) == 18 and set(seen().values()) == {None}
    put(frames(spark, [1, 3]), "b0")
    first = seen()
    assert first[0, 0] == 3 and first[1, 5] == 1 and first[2, 0] is None
    put(frames(spark, [1, 3]), "b0")
    assert seen() == first
    with pytest.raises(Exception, match="not in the scaffold"):
        put(frames(spark, [2, 4]), "b1")
    assert seen() == first
    schema = frames(spark, [1]).schema
    writer = regions.RegionStreamWriter({"path": path}, schema)
    batches = frames(spark, [2], 0.5).toArrow().to_batches()
    halves = [writer.write(iter(b.slice(i * (b.num_rows // 2), b.num_rows // 2) for b in batches)) for i in range(2)]
    assert seen() == first  # both tasks have written, the commit has not happened
    writer.commit(halves, 7)
    writer.commit(halves, 7)
    assert {k: v for k, v in seen().items() if k[0] == 2} == {(2, p): 2.5 for p in range(6)} and {k: v for k, v in seen().items() if k[0] != 2} == {k: v for k, v in first.items() if k[0] != 2}
    writer.abort([writer.write(iter(batches))], 8)
    again = regions.RegionStreamWriter({"path": path}, schema)
    again.commit([again.write(iter(frames(spark, [1], 0.25).toArrow().to_batches())), None], 9)
    assert seen()[1, 0] == 1.25 and np.isclose(regions.read(spark, path).filter("frame = 1 and pix = 4").first().other, np.float32(4 / 3))


def test_regions_take_a_stream_and_a_restart(spark, tmp_path):
    spark.dataSource.register(regions.Regions)
    path, source, log = (str(tmp_path / n) for n in ("maps", "in", "log"))
    regions.create(path, [1.0, 2.0, 3.0], 6, ["dirty", "other"])
    for times in ([1], [2, 3]):
        frames(spark, times).write.mode("append").parquet(source)
        stream = spark.readStream.schema(frames(spark, [1]).schema).parquet(source)
        stream.writeStream.format("regions").option("path", path).option("checkpointLocation", log).trigger(availableNow=True).start().awaitTermination()
    got = {(r.t, r.pix): r.dirty for r in regions.read(spark, path).collect()}
    assert got == {(float(t), p): float(t) for t in (1, 2, 3) for p in range(6)}
