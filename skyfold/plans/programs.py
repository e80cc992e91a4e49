"""Queries that are programs and not one statement: folds, solvers, streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.fixtures import register, with_views
from skyfold.plans import bank, calibration, confirmation, filtering, linking
from skyfold.plans.imaging import ROWS
from skyfold.session import stored


def _rows(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    register(spark, sf_dir)
    return spark.sql(with_views(sql, "spark"))


def _rounded(df: DataFrame) -> DataFrame:
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return df.select("pix", "k", r("t", 6), r("filtered", 5), r("znorm", 5))


def iwp_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.operators.filter import filter_pixels

    series = _rows(spark, sf_dir, "select pix, t, y, true ok, event_id from lightcurve")
    return _rounded(filter_pixels(series, float(filtering.SIGMA2), float(filtering.NOISE), tie="event_id"))


def iwp_filter_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.operators.filter import filter_pixels

    return _rounded(filter_pixels(_rows(spark, sf_dir, filtering.GAP), float(filtering.SIGMA2), float(filtering.NOISE)))


def tikhonov_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.operators.solve import tikhonov

    return tikhonov(_rows(spark, sf_dir, ROWS), _rows(spark, sf_dir, "select * from pix"))


def _steps(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """n steps of the tiled solver from nothing, each step's state stored; tiles of 16 pixels, so that there are some."""
    from skyfold.operators import tiled

    r = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    rows = _rows(spark, sf_dir, ROWS)
    return tiled.solve(rows, _rows(spark, sf_dir, "select * from pix2"), maxiter=n, tol=0.0, budget=16 * 16 * 276).select("frame", "pix", r("x", 6), r("r", 4))


def cg_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, 1)


def cg_two_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir, 2)


def tikhonov_tiled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The map of tikhonov_map on tiles of 64 pixels, to ten times its tolerance."""
    from skyfold.operators import tiled

    rows = _rows(spark, sf_dir, ROWS)
    return tiled.solve(rows, _rows(spark, sf_dir, "select * from pix"), tol=1e-4, budget=16 * 64 * 276).select("frame", "pix", F.col("x").alias("regularised"), "steps")


def tikhonov_warm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames in four parts, each solve started from the map before it, over restarts of the query."""
    from skyfold.streaming import maps

    rows = _rows(spark, sf_dir, ROWS).drop("a1", "a2").withColumn("run", F.lit(0).cast("long"))
    return maps.solve_parts(maps.quarters(rows), _rows(spark, sf_dir, "select * from pix"))[0].drop("run")


#: A seventh of the rows arrives one part later than it should.
_ARRIVAL = "select pix, t, y, k % 7 = 0 delayed, least(cast(floor((t-lo)/((hi-lo)/4e0)) as int),3) + case when k % 7 = 0 then 1 else 0 end part from (select pix, t, y, event_id k, min(t) over () lo, max(t) over () hi from (select pix, t, y, event_id from lightcurve) s) q"
#: The same rows for Spark: the ends of the run are two numbers, which a window over all rows would find in one task.
_ARRIVED = _ARRIVAL.replace("min(t) over () lo, max(t) over () hi from (select pix, t, y, event_id from lightcurve) s", "lo, hi from lightcurve cross join (select min(t) lo, max(t) hi from lightcurve) w")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in and rows to the side, a pixel: a row is late if its pixel has stepped at its time or after."""
    from skyfold.streaming import pipeline

    rows = _rows(spark, sf_dir, _ARRIVED).withColumn("ok", F.lit(True))
    kept, late = pipeline.filter_parts([rows.filter(F.col("part") == i) for i in range(5)], float(filtering.SIGMA2), float(filtering.NOISE))
    both = kept.select("pix", F.lit(0).alias("late"), "t").union(late.select("pix", F.lit(1).alias("late"), "t"))
    return both.groupBy("pix").agg(F.sum(1 - F.col("late")).alias("n_in"), F.sum("late").alias("n_late"), (F.round(F.max("t"), 6) + F.lit(0.0)).alias("last_t"))


def scan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visibilities as snapshot files, a file for each frame, read back through the connector."""
    from skyfold.session import fresh_folder, with_conf
    from skyfold.sources.connectors import Snapshots

    folder = fresh_folder(spark, "snapshots")
    of = _rows(spark, sf_dir, "select v.frame, f.t, a1, a2, re, im from vis v join frames f on f.frame=v.frame")
    gain = _rows(spark, sf_dir, "select * from gain").agg(F.array_sort(F.collect_list(F.struct("a", "amp", "ph"))).alias("g")).select(F.col("g.amp").alias("gains"), F.col("g.ph").alias("phases"))
    stamp = F.date_format(F.timestamp_seconds("t"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = of.groupBy("frame", stamp.alias("stamp")).agg(F.array_sort(F.collect_list(F.struct("a1", "a2", "re", "im"))).alias("v")).crossJoin(gain)
    body = F.struct(F.lit('{"frequency": 1575420000.0}').alias("config"), F.array("stamp").alias("timestamp"), F.transform("v", lambda r: F.array(r["a1"], r["a2"])).alias("baselines"), F.array(F.transform("v", lambda r: F.array(r["re"], r["im"]))).alias("vis"), "gains", "phases")
    with with_conf(spark, spark__sql__session__timeZone="UTC"):
        rows.select("frame", F.to_json(body).alias("value")).repartition("frame").write.option("compression", "none").partitionBy("frame").text(folder)
    spark.dataSource.register(Snapshots)
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return spark.read.format("snapshot").option("suffix", ".txt").load(folder).select(r("t", 3), "a1", "a2", r("re", 9), r("im", 9), "flag", "w")


def write_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dirty maps into a scaffold of the run's times, and the scaffold read back."""
    from skyfold.plans.imaging import DIRTY
    from skyfold.session import fresh_folder
    from skyfold.sinks import regions

    maps = _rows(spark, sf_dir, f"select f.t, cast(d.pix as bigint) pix, d.dirty from ({DIRTY}) d join frames f on f.frame=d.frame")
    path, times = fresh_folder(spark, "regions"), [r.t for r in _rows(spark, sf_dir, "select t from frames order by t").collect()]  # one number a frame
    regions.create(path, times, 192, ["dirty"])
    spark.dataSource.register(regions.Regions)
    maps.repartition("t").write.format("regions").mode("append").option("path", path).save()
    return regions.read(spark, path).select((F.round("t", 3) + F.lit(0.0)).alias("t"), "pix", (F.round(F.col("dirty").cast("double"), 4) + F.lit(0.0)).alias("dirty"))


def color_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles over all frames by exact ranks: no task gathers the distinct values."""
    from skyfold.operators.ranking import quantiles

    r = lambda c: (F.round(c, 9) + F.lit(0.0)).alias(c)
    values = _rows(spark, sf_dir, "select val from maps48")
    both = quantiles(values, "val", {"p1": 0.01, "p99": 0.99}).crossJoin(quantiles(values.select(F.abs("val").alias("size")), "size", {"sym": 0.99}))
    return both.select(r("p1"), r("p99"), r("sym"))


LAG = 6


def rts_smoother(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each frame of the light curves given six more."""
    from skyfold.operators.smoother import smooth_pixels

    series = _rows(spark, sf_dir, "select pix, t, y, true ok, event_id from lightcurve")
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    return smooth_pixels(series, float(filtering.SIGMA2), float(filtering.NOISE), LAG, tie="event_id").select("pix", "k", r("t", 6), r("smoothed", 5), r("variance", 7))


def model_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Light curves under four quiet models, mixed by evidence."""
    from skyfold.operators.bank import Model, filter_bank

    series = _rows(spark, sf_dir, "select pix, t, y, true ok, event_id from lightcurve")
    models = [Model(q, float(s)) for q, s in bank.MODELS]
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    found = filter_bank(series, models, float(filtering.NOISE), float(bank.DIFFUSE), float(bank.FORGET), float(bank.CALM), tie="event_id")
    return found.select("pix", "k", r("t", 6), r("mean", 4), "best", r("weight", 6), "scale", r("znorm", 5))


def _angles() -> dict[str, float]:
    """Numbers of plans/linking.py, degrees as radians."""
    degree = float(linking.DEGREE)
    return {"rate": float(linking.RATE) * degree, "tol": float(linking.TOL) * degree, "gap": float(linking.GAP), "moving": float(linking.MOVING) * degree, "age": float(linking.AGE), "near": float(linking.NEAR) * degree}


def kinematic_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of detections within a day that one slow object may have made."""
    from skyfold.operators.linking import pairs_within

    n = _angles()
    return pairs_within(_rows(spark, sf_dir, linking.DETECTIONS), n["rate"], n["tol"], n["gap"], digits=(6, 8))


def predicted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each detection's nearest predicted object as of its time."""
    from skyfold.operators.linking import matches

    n = _angles()
    found = matches(_rows(spark, sf_dir, linking.DETECTIONS), _rows(spark, sf_dir, linking.PASSES), n["near"], n["age"])
    return found.select("id", "name", (F.col("apart") + F.lit(0.0)).alias("apart"))


def kinematic_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detections chained to tracks, with speed, predicted object and stream."""
    from skyfold.operators.linking import matches, route, tracks_within

    n, detections = _angles(), stored(_rows(spark, sf_dir, linking.DETECTIONS), "detections")
    found, members = tracks_within(detections, n["rate"], n["tol"], n["gap"], n["tol"])
    found, members = stored(found, "tracks"), stored(members, "members")
    near = matches(detections, _rows(spark, sf_dir, linking.PASSES), n["near"], n["age"])
    routed = route(found, members, near, detections, n["moving"])
    r = lambda c, d: (F.round(c, d) + F.lit(0.0)).alias(c)
    return routed.select("track_a", "track_b", "n", r("t0", 6), r("t1", 6), r("rate", 7), "confirmed", "matched", "name", "stream")


FDR = 0.05


def fdr_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of frames of a pixel that the filter did not expect: two squared residuals are chi-square with two degrees
    of freedom, whose tail is exp(-x/2); found at a false discovery rate over all pixels and pairs."""
    from skyfold.operators.ranking import benjamini_hochberg

    z = iwp_filter(spark, sf_dir)
    pairs = z.groupBy("pix", F.expr("(k-1) div 2").alias("pair")).agg(F.exp(-F.sum(F.col("znorm") * F.col("znorm")) / 2).alias("p"), F.count("*").alias("n")).filter("n = 2").drop("n")
    return benjamini_hochberg(pairs, "p", FDR).select("pix", "pair", (F.round("p", 12) + F.lit(0.0)).alias("p"))


#: Four digits more than what the queries show.
GAIN_TOL = 1e-9


def robust_gains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains of each frame against the catalogue's model, under Student-t weights."""
    from skyfold.operators.calibrate import gains
    from skyfold.plans.calibration import OBSERVED

    r = lambda c: (F.round(c, 5) + F.lit(0.0)).alias(c)
    return gains(_rows(spark, sf_dir, OBSERVED), tol=GAIN_TOL).select("interval", F.col("a").cast("int").alias("a"), r("re"), r("im"))


def calibrated_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the gains of robust_gains leave of each row, with its thermal weight."""
    from skyfold.operators.calibrate import gains, residuals
    from skyfold.plans.calibration import OBSERVED

    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    rows = stored(_rows(spark, sf_dir, OBSERVED), "observed")
    return residuals(rows, gains(rows, tol=GAIN_TOL)).select("interval", "a1", "a2", r("re", 3), r("im", 3), r("w", 4))


def _alarms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The normalised maps and the candidates in them."""
    from skyfold.operators.confirm import candidates

    maps = stored(_rows(spark, sf_dir, confirmation.MAPS), "maps")
    return maps, candidates(maps.filter(f"z >= {confirmation.ALARM}"), confirmation.NSIDE)


def alarm_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alarms of each frame, merged where pixels touch."""
    return _alarms(spark, sf_dir)[1].select(F.col("frame").cast("int").alias("frame"), "component", "pixels", "pix", (F.round("z", 6) + F.lit(0.0)).alias("z"))


def confirm_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merged alarms with the fit of their point-spread function against that of the best known source."""
    from skyfold.operators.confirm import confirm
    from skyfold.plans.geometry import FREQ

    maps, found = _alarms(spark, sf_dir)
    r = lambda c, n: (F.round(c, n) + F.lit(0.0)).alias(c)
    done = confirm(stored(found, "candidates"), _rows(spark, sf_dir, ROWS), maps, _rows(spark, sf_dir, "select * from pix"), _rows(spark, sf_dir, confirmation.KNOWN), float(FREQ), tile=64)
    return done.select(F.col("frame").cast("int").alias("frame"), "component", "pixels", "pix", r("z", 6), r("amplitude", 6), r("r2", 7), r("known_r2", 7), r("contrast", 7))


def pixel_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.operators.pixels import pixel_corners as run

    return run(spark, 4)


def stream_prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.streaming import pipeline

    return pipeline.replay(_rows(spark, sf_dir, ROWS), "frame", "frame int, a1 int, a2 int, re double, im double, w double, bx double, by_ double, bz double").select("frame", "a1", "a2", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im", "w")])


def stream_msv4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.streaming import pipeline

    return pipeline.replay(_rows(spark, sf_dir, "select frame, a1, a2, re, im, w from vis"), "frame", "frame int, a1 int, a2 int, re double, im double, w double").groupBy("frame").agg(F.count("*").alias("n"), F.countDistinct("a1").alias("antennas"), (F.round(F.sum("w"), 6) + F.lit(0.0)).alias("sum_w"))


def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.streaming import pipeline

    series = _rows(spark, sf_dir, filtering.GAP).select(F.col("pix").cast("long").alias("pix"), "t", "y", "ok", (F.col("k") % 4).cast("int").alias("_part"), "k")
    return _rounded(pipeline.filter_stream(series, float(filtering.SIGMA2), float(filtering.NOISE)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (iwp_filter, iwp_filter_gap, tikhonov_map, tikhonov_tiled, tikhonov_warm, cg_step, cg_two_steps, scan_snapshots, write_regions, color_limits, fdr_pixels, rts_smoother, model_bank, kinematic_links, predicted_matches, kinematic_tracks, robust_gains, calibrated_residual, alarm_components, confirm_candidates, pixel_corners, stream_late, stream_prepared, stream_msv4_rows, stream_filter)}


def oracle_sql() -> dict[str, str]:
    from skyfold.plans.imaging import DIRTY

    gap = with_views(filtering.recursion(filtering.GAP), "duckdb")
    return {
        **{name: with_views(text, "duckdb") for name, text in (calibration.sql() | confirmation.sql() | linking.sql()).items()},
        "iwp_filter": with_views(filtering.recursion(filtering.SERIES), "duckdb"),
        "iwp_filter_gap": gap,
        "stream_filter": gap,
        "rts_smoother": with_views(filtering.smoother(filtering.SERIES, LAG), "duckdb"),
        "model_bank": with_views(bank.recursion(filtering.SERIES), "duckdb"),
        "fdr_pixels": with_views(f"""select pix, pair, round(p,12)+0e0 p from (select *, max(case when p <= k*{FDR!r}e0/m then p end) over () cut from (
          select *, row_number() over (order by p) k, count(*) over () m from (
          select pix, cast((k-1)//2 as bigint) pair, exp(-sum(znorm*znorm)/2e0) p from ({filtering.recursion(filtering.SERIES)}) z group by pix, (k-1)//2 having count(*)=2) a) b) c where p <= cut""", "duckdb"),
        "scan_snapshots": with_views("select round(f.t,3)+0e0 t, a1, a2, round(re,9)+0e0 re, round(im,9)+0e0 im, p.amp=0e0 or q.amp=0e0 flag, case when p.amp=0e0 or q.amp=0e0 then 0e0 else 1e0 end w from vis v join frames f on f.frame=v.frame join gain p on p.a=v.a1 join gain q on q.a=v.a2", "duckdb"),
        "write_regions": with_views(f"select round(f.t,3)+0e0 t, p.pix, round(cast(cast(d.dirty as real) as double),4)+0e0 dirty from frames f cross join (select cast(pix as bigint) pix from pix) p left join ({DIRTY}) d on d.frame=f.frame and d.pix=p.pix", "duckdb"),
        "stream_late": with_views(f"""select pix, count(*) filter (not late) n_in, count(*) filter (late) n_late, round(max(t),6)+0e0 last_t from (
          select pix, t, coalesce(t <= max(t) over (partition by pix order by part range between unbounded preceding and 1 preceding), false) or row_number() over (partition by pix, part, t) > 1 late from ({_ARRIVAL}) a) b group by pix""", "duckdb"),
        "stream_prepared": with_views(f"select frame, a1, a2, round(re,6)+0e0 re, round(im,6)+0e0 im, round(w,6)+0e0 w from ({ROWS}) q", "duckdb"),
        "stream_msv4_rows": with_views("select frame, count(*) n, count(distinct a1) antennas, round(sum(w),6)+0e0 sum_w from vis group by frame", "duckdb"),
    }
