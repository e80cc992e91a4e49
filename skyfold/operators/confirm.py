"""Candidates of alarm maps: alarms of a frame merged over shared pixel corners, and their fit to the point-spread function.

Two pixels touch if they share a corner, so adjacency is an equality of corner keys and needs no neighbour table. A frame's
alarms are bounded by the grid and merge inside one task. The template of a direction is made where it is needed, from the
frame's rotated baselines: a task holds the rows of one frame, one tile of pixels and PART templates, and gives sums that
are added up by template; nothing is made for frames without templates.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.operators.pixels import corners
from skyfold.operators.solve import PHASE_BYTES
from skyfold.operators.tiled import packs
from skyfold.session import require_schema

C = 299792458.0
#: Templates that a task fits at once.
PART = 256
#: Pixels of a tile.
TILE = 1024
_MERGED = "frame long, component long, pixels long, pix long, z double"
_SUMS = "frame long, template string, x double, y double, z double, pz double, pp double, zz double"


def components(pix: np.ndarray, nside: int) -> np.ndarray:
    """For each pixel the smallest pixel that it is joined to by shared corners."""
    keys = np.round(corners(pix, nside).reshape(-1, 3) * 1e6).astype(np.int64)
    _, corner = np.unique(keys, axis=0, return_inverse=True)
    corner, label = corner.reshape(len(pix), 4), pix.copy()
    while True:
        least = np.full(corner.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, corner.ravel(), np.repeat(label, 4))
        new = least[corner].min(1)
        if (new == label).all():
            return label
        label = new


def candidates(alarms: DataFrame, nside: int) -> DataFrame:
    """alarms(frame, pix, z) to (frame, component, pixels, pix, z): a row a component with its smallest pixel, its number
    of pixels and its highest z, ties to the smaller pixel. Rows with a null, a z that is not finite or a pixel off the
    grid are left out; of a pixel that repeats in a frame the highest z counts."""
    require_schema(alarms, "frame pix z")
    names = [c.split()[0] for c in _MERGED.split(", ")]
    own = alarms.select(F.col("frame").cast("long"), F.col("pix").cast("long"), F.col("z").cast("double")).filter(f"frame is not null and pix >= 0 and pix < {12 * nside * nside} and abs(z) < double('infinity')")
    packed = own.groupBy("frame", "pix").agg(F.max("z").alias("z")).groupBy("frame").agg(F.array_sort(F.collect_list(F.struct("pix", "z"))).alias("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, frame in enumerate(batch.column("frame").to_pylist()):
                inner = batch.column("a").slice(i, 1).flatten()
                pix, z = (inner.field(k).to_numpy() for k in range(2))
                label = components(pix, nside)
                order = np.lexsort((pix, -z, label))
                first = np.flatnonzero(np.r_[True, np.diff(label[order]) != 0])
                peak = order[first]
                size = np.diff(np.r_[first, len(pix)])
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (np.full(len(peak), frame), label[peak], size.astype(np.int64), pix[peak], z[peak])], names)

    return packed.mapInArrow(run, _MERGED)


def _fields(batch: pa.RecordBatch, name: str, i: int) -> dict[str, pa.Array]:
    inner = batch.column(name).slice(i, 1).flatten()
    return {f.name: inner.field(k) for k, f in enumerate(inner.type)}


def fit(rows: DataFrame, maps: DataFrame, pixels: DataFrame, templates: DataFrame, freq: float, budget: int = PHASE_BYTES, tile: int = TILE) -> DataFrame:
    """Each frame's map on the point-spread function of each template's direction, over the pixels that the map has.

    rows(frame, w, bx, by_, bz, ..), maps(frame, pix, z), pixels(pix, x, y, z), templates(frame, template, x, y, z) to
    (frame, template, x, y, z, amplitude, r2), a row for each distinct template: the least-squares factor of the template and the share of the map's squares that it
    explains; both null where the map is 0 all over or the frame has no weight. Rows with nulls are left out.
    """
    require_schema(rows, "frame re im w bx by_ bz")
    names = [c.split()[0] for c in _SUMS.split(", ")]
    size = max(1, min(tile, budget // (16 * PART)))
    grid = pixels.select(F.col("pix").cast("long"), *[F.col(c).cast("double").alias("s" + c) for c in "xyz"])
    maps = maps.select(F.col("frame").cast("long"), F.col("pix").cast("long"), F.col("z").cast("double")).dropna()
    tiles = maps.join(grid, "pix").groupBy("frame", F.floor(F.col("pix") / size).alias("tile")).agg(F.array_sort(F.collect_list(F.struct("pix", "z", "sx", "sy", "sz"))).alias("cells"))
    wanted = templates.select(F.col("frame").cast("long"), F.col("template").cast("string"), *[F.col(c).cast("double") for c in "xyz"]).dropna().distinct()
    counts = wanted.groupBy("frame").agg(F.ceil(F.count("*") / PART).alias("n"))
    part = F.pmod(F.xxhash64("template", "x", "y", "z"), F.col("n")).alias("part")
    parts = wanted.join(counts, "frame").groupBy("frame", part).agg(F.collect_list(F.struct("template", "x", "y", "z")).alias("wanted"))
    own = packs(rows.filter("frame is not null and w > 0"), freq, None).withColumn("frame", F.col("frame").cast("long"))
    work = parts.join(own, "frame").join(tiles, "frame").select("frame", "wanted", "pack", "cells")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, frame in enumerate(batch.column("frame").to_pylist()):
                pack = {k: v.to_numpy(zero_copy_only=False) for k, v in _fields(batch, "pack", i).items()}
                cell = {k: v.to_numpy(zero_copy_only=False) for k, v in _fields(batch, "cells", i).items()}
                want = _fields(batch, "wanted", i)
                k = (2 * np.pi / C * pack["freq"])[:, None] * np.stack([pack[c] for c in ("bx", "by_", "bz")], 1)
                to = np.stack([want[c].to_numpy(zero_copy_only=False) for c in "xyz"], 1)
                at, z = np.stack([cell[c] for c in ("sx", "sy", "sz")], 1), cell["z"]
                psf = np.zeros((len(to), len(at)))
                step = max(1, budget // (16 * (len(to) + len(at))))
                for j in range(0, len(k), step):  # rows in turn, within the budget
                    a, b, w = k[j : j + step] @ to.T, k[j : j + step] @ at.T, pack["w"][j : j + step, None]
                    psf += (w * np.cos(a)).T @ np.cos(b) + (w * np.sin(a)).T @ np.sin(b)
                psf /= pack["w"].sum()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(to), frame)), *(want[c] for c in ("template", "x", "y", "z")), pa.array(psf @ z), pa.array((psf * psf).sum(1)), pa.array(np.full(len(to), z @ z))], names)

    added = work.mapInArrow(run, _SUMS).groupBy("frame", "template", "x", "y", "z").agg(*[F.sum(c).alias(c) for c in ("pz", "pp", "zz")])
    return added.select("frame", "template", "x", "y", "z", F.expr("pz / nullif(pp, 0)").alias("amplitude"), F.expr("pz * pz / nullif(pp * zz, 0)").alias("r2"))


def confirm(found: DataFrame, rows: DataFrame, maps: DataFrame, pixels: DataFrame, sources: DataFrame, freq: float, **how: int) -> DataFrame:
    """Candidates with the fit of their own template, the best fit of a known source of the frame, and the contrast of the
    two (r2 less the source's; a frame without sources has 0 there). sources(frame, name, x, y, z)."""
    grid = pixels.select(F.col("pix").cast("long"), "x", "y", F.col("z").alias("zz"))
    own = found.join(grid, "pix").select("frame", F.concat(F.lit("c"), F.col("component")).alias("template"), "x", "y", F.col("zz").alias("z"))
    known = sources.join(found.select("frame").distinct(), "frame", "left_semi").select("frame", F.concat(F.lit("s"), F.col("name")).alias("template"), "x", "y", "z")
    fits = fit(rows, maps, pixels, own.unionByName(known), freq, **how)
    mine = fits.filter("template like 'c%'").select("frame", F.expr("cast(substr(template, 2) as bigint)").alias("component"), "amplitude", "r2")
    best = fits.filter("template like 's%'").groupBy("frame").agg(F.max("r2").alias("known_r2"))
    out = found.join(mine, ["frame", "component"], "left").join(best, "frame", "left").withColumn("known_r2", F.coalesce("known_r2", F.lit(0.0)))
    return out.withColumn("contrast", F.col("r2") - F.col("known_r2"))
