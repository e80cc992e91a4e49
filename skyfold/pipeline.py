"""A run from prepared rows to stored maps: image, optionally regularise, filter, write."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.functions import expressions as X
from skyfold.operators.filter import filter_pixels
from skyfold.operators.solve import tikhonov
from skyfold.session import require_schema


@dataclass(frozen=True)
class Config:
    """Defaults of a run; eta at or below zero leaves the regularised map out, beam=False the beam of ``diameter`` metres."""

    freq: float = 1575420000.0
    sigma2: float = 1e-3
    noise: float = 1e-2
    eta: float = 0.0
    beam: bool = True
    diameter: float = 0.125
    nframes: int | None = None
    overwrite: bool = False


def dirty_maps(rows: DataFrame, pixels: DataFrame, freq: float, diameter: float | None = None) -> DataFrame:
    """Weighted adjoint of every frame; frames without weight give zeros. The grid is the small side of the product.

    With a ``diameter`` the power beam around the frame's boresight (zx, zy, zz) weighs each pixel, on the sums.
    """
    phase = X.phase(("bx", "by_", "bz"), ("x", "y", "z"), f"{freq!r}D" if "e" in repr(freq) else f"{freq!r}e0")
    each = rows.crossJoin(pixels.select("pix", "x", "y", "z")).withColumn("ph", F.expr(phase))
    total = F.sum("w")
    value = F.sum(F.expr("w*(re*cos(ph)+im*sin(ph))"))
    dirty = F.when(total == 0, 0.0).otherwise(value / total)
    if not diameter:
        return each.groupBy("frame", "t", "pix").agg(dirty.alias("dirty"))
    sums = each.groupBy("frame", "t", "pix").agg(dirty.alias("plain"), F.first(F.expr("x*zx+y*zy+z*zz")).alias("mu"))
    terms = 14 + int(10 * diameter * freq / 299792458.0)  # x reaches pi D nu/c
    beam = F.expr(X.airy_power("mu", f"{freq!r}D" if "e" in repr(freq) else f"{freq!r}e0", f"{diameter!r}e0", terms))
    return sums.select("frame", "t", "pix", (F.col("plain") * beam).alias("dirty"))


def run(rows: DataFrame, pixels: DataFrame, config: Config, out: str | None = None) -> DataFrame:
    """rows(frame, t, re, im, w, bx, by_, bz; with the beam also zx, zy, zz, the boresight) to (t, pix, dirty, filtered, znorm[, regularised]); written to ``out`` if given.

    A frame in which any pixel is not finite, or all are zero, is no observation: the filter coasts over it.
    """
    rows = require_schema(rows, "frame t re im w bx by_ bz" + " zx zy zz" * config.beam)
    diameter = config.diameter if config.beam else None
    rows = rows if config.nframes is None else rows.filter(F.col("frame") < config.nframes)
    maps = dirty_maps(rows, pixels, config.freq, diameter)
    shown = "dirty"
    if config.eta > 0:
        solved = tikhonov(rows, pixels, config.freq, config.eta, diameter).select("frame", "pix", "regularised")
        maps, shown = maps.join(solved, ["frame", "pix"]), "regularised"
    finite = ~(F.isnan(shown) | (F.abs(F.col(shown)) == float("inf")))
    seen = maps.groupBy("frame").agg((F.bool_and(finite) & ~F.bool_and(F.col(shown) == 0)).alias("ok"))
    series = maps.join(seen, "frame").select("pix", "t", F.col(shown).alias("y"), "ok")
    filtered = filter_pixels(series, config.sigma2, config.noise).select("pix", "t", "filtered", "znorm")
    result = maps.withColumn("pix", F.col("pix").cast("long")).join(filtered, ["pix", "t"])
    if out is not None:
        result.write.mode("overwrite" if config.overwrite else "errorifexists").parquet(out)
    return result
