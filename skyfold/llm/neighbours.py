"""Approximate nearest neighbours by inner product: stable projections, kd-trees, a chi-square stopping test.

Largest inner product becomes smallest distance by one more coordinate: with M the largest norm, x gets sqrt(M^2 - |x|^2)
and a query 0. ``dims`` Gaussian (2-stable) projections of these make a low-dimensional image, in which a squared distance
over the true squared distance follows a chi-square law of ``dims`` degrees of freedom.

* Equal vectors are one row: it keeps the k + 1 smallest ids, which is all that any query can get of them.
* A kd-tree over the images, split at medians of a bounded sample, deals the rows to cells of about ``cell_rows``.
  Every row is in a cell, and each cell is indexed by a kd-tree of its own.
* In a tree, a query meets leaves by their distance in the image, and rows there are verified on the full vectors, until
  the next leaf's squared distance exceeds the chi-square quantile of ``stop`` times the k-th squared distance found:
  a nearer row would then be that far in the image with probability below 1 - stop.
* A query starts in its own cell and then visits just the cells that the test leaves open, in blocks of
  ``query_block`` queries, so no task holds more than a cell and a block.

Results are approximate; scores are exact inner products in double precision. With dims = 8 and stop = 0.97, measured
recall is in the README.

Defined results: vectors that are null, zero, of another length than most, or have null or non-finite components take
no part, nor do null ids; rows that repeat an id are one row, with the least of its vectors that take part (component by
component); fewer than k candidates give them all; ties go to the smaller id; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skyfold.llm.common import Kept

DIMS, STOP, CELL_ROWS, LEAF_ROWS, QUERY_BLOCK, SAMPLE = 8, 0.97, 16384, 256, 4096, 65536


def chi_square_quantile(p: float, dims: int) -> float:
    """For even dims, where the distribution function is a finite sum."""
    if dims % 2:
        raise ValueError("dims must be even")

    def below(x: float) -> float:
        term = total = 1.0
        for i in range(1, dims // 2):
            term *= x / 2 / i
            total += term
        return 1 - math.exp(-x / 2) * total

    lo, hi = 0.0, 100.0 + 10 * dims
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


class Split:
    """A kd-tree over image points: splits at medians of the widest side, down to ``leaves`` parts."""

    def __init__(self, points: np.ndarray, leaves: int) -> None:
        dims = points.shape[1]
        self.lo, self.hi, self.nodes = [], [], []

        def build(own: np.ndarray, n: int, lo: np.ndarray, hi: np.ndarray) -> int:
            if n > 1 and len(own) > 1:
                part = points[own]
                d = int(np.argmax(part.max(0) - part.min(0)))
                at = float(np.partition(part[:, d], len(own) // 2)[len(own) // 2])
                left = part[:, d] < at
                if left.any():
                    node = len(self.nodes)
                    self.nodes.append(None)
                    below, above = hi.copy(), lo.copy()
                    below[d] = above[d] = at
                    a = build(own[left], n // 2, lo, below)
                    b = build(own[~left], n - n // 2, above, hi)
                    self.nodes[node] = (d, at, a, b)
                    return node
            self.lo.append(lo)
            self.hi.append(hi)
            return -len(self.lo)

        self.root = build(np.arange(len(points)), leaves, np.full(dims, -np.inf), np.full(dims, np.inf))
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def part_of(self, points: np.ndarray) -> np.ndarray:
        out = np.zeros(len(points), np.int64)

        def walk(node: int, own: np.ndarray) -> None:
            if node < 0:
                out[own] = -node - 1
            elif len(own):
                d, at, a, b = self.nodes[node]
                left = points[own, d] < at
                walk(a, own[left])
                walk(b, own[~left])

        walk(self.root, np.arange(len(points)))
        return out

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance from a point to each part's region."""
        gap = np.maximum(np.maximum(self.lo - point, point - self.hi), 0)
        return (gap * gap).sum(1)


class Image:
    """The projections of rows and queries."""

    def __init__(self, dim: int, largest: float, dims: int, seed: int) -> None:
        self.matrix, self.largest = np.random.default_rng(seed).normal(size=(dim + 1, dims)), largest

    def rows(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix[:-1] + np.sqrt(np.maximum(self.largest - (x * x).sum(1), 0))[:, None] * self.matrix[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        return q @ self.matrix[:-1]


def search(x: np.ndarray, q: np.ndarray, bounds: np.ndarray, k: int, image: Image, quantile: float, leaf_rows: int = LEAF_ROWS) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query: rows of x and their inner products, the best k (with all that tie with the last).

    ``bounds`` holds each query's k-th inner product known so far, or -inf.
    """
    points, images = image.rows(x), image.queries(q)
    tree = Split(points, max(1, -(-len(x) // leaf_rows)))
    part = tree.part_of(points)
    order = np.argsort(part, kind="stable")
    ends = np.searchsorted(part[order], np.arange(len(tree.lo) + 1))
    x, points = x[order], points[order]
    leaf_lo = np.array([points[a:b].min(0) if b > a else np.full(points.shape[1], np.inf) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    leaf_hi = np.array([points[a:b].max(0) if b > a else np.full(points.shape[1], np.inf) for a, b in zip(ends[:-1], ends[1:], strict=True)])
    for j in range(len(q)):
        gap = np.maximum(np.maximum(leaf_lo - images[j], images[j] - leaf_hi), 0)
        far = (gap * gap).sum(1)
        base = float(q[j] @ q[j]) + image.largest
        kth, found, scores = bounds[j], np.zeros(0, np.int64), np.zeros(0)
        for leaf in np.argsort(far, kind="stable"):
            reach = quantile * max(base - 2 * kth, 0.0) if kth > -np.inf else np.inf
            if far[leaf] > reach:
                break
            a, b = ends[leaf], ends[leaf + 1]
            near = np.arange(a, b)
            if reach < np.inf:
                away = points[a:b] - images[j]
                near = near[(away * away).sum(1) <= reach]
            if not len(near):
                continue
            dots = x[near] @ q[j]
            good = dots >= kth
            found, scores = np.concatenate([found, near[good]]), np.concatenate([scores, dots[good]])
            if len(scores) >= k:
                kth = max(kth, np.partition(scores, len(scores) - k)[len(scores) - k])
                found, scores = found[scores >= kth], scores[scores >= kth]
        yield j, order[found], scores


def _doubles(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


_COLLAPSED = "vec binary, norm double, ids array<long>, asks boolean"


def _collapse(batches: Iterator[pa.RecordBatch], dim: int, k: int, every: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        groups: dict[bytes, set[int]] = {}
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is None or v is None or len(v) != dim or None in v:
                continue
            x = np.array(v, np.float64)
            if np.isfinite(x).all() and x.any():
                groups.setdefault(x.tobytes(), set()).add(i)
        vectors = list(groups)
        norms = [float(np.dot(x, x)) for x in map(np.frombuffer, vectors)]
        ids = [sorted(groups[v]) for v in vectors]
        yield pa.RecordBatch.from_arrays([pa.array(vectors, pa.binary()), pa.array(norms, pa.float64()), pa.array([x[: k + 1] for x in ids], pa.list_(pa.int64())), pa.array([any(i % every == 0 for i in x) for x in ids], pa.bool_())], ["vec", "norm", "ids", "asks"])


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, dims: int = DIMS, stop: float = STOP, cell_rows: int = CELL_ROWS, seed: int = 11, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score. Queries are the rows whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    lengths = rows.filter("vec_id is not null and size(v) > 0").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    dim = lengths.d
    repeats = Kept(rows.filter("vec_id is not null").groupBy("vec_id").count().filter("count > 1").select("vec_id"), "ann-repeats", counted=True)
    if repeats.rows:
        fits = (F.size("v") == dim) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        single = rows.join(repeats.side(), "vec_id", "left_semi").filter(fits).groupBy("vec_id").agg(F.min("v").alias("v"))
        rows = rows.join(repeats.side(), "vec_id", "left_anti").unionByName(single)
    collapsed = rows.mapInArrow(lambda it: _collapse(it, dim, k, every), _COLLAPSED)
    merged = collapsed.groupBy("vec", "norm").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids"), F.bool_or("asks").alias("asks"))
    points = Kept(merged.select(F.monotonically_increasing_id().alias("vid"), "vec", "norm", "ids", "asks"), "ann-points").df
    n, largest = points.agg(F.count("*"), F.max("norm")).first()
    if not n:
        return empty
    image, quantile = Image(dim, largest, dims, seed), chi_square_quantile(stop, dims)
    sample = points.select("vec").orderBy(F.xxhash64("vec")).limit(SAMPLE) if n > cell_rows else points.select("vec").limit(1)
    images = sample.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in image.rows(_doubles(b.column(0)))], pa.binary())], ["p"]) for b in it if len(b)), "p binary").toArrow()
    cells = Split(_doubles(images["p"]), max(1, -(-n // cell_rows)))

    def placed(batches: Iterator[pa.RecordBatch], of_queries: bool) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if len(b):
                x = _doubles(b.column(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cells.part_of(image.queries(x) if of_queries else image.rows(x)))], [*b.schema.names, "cell"])

    base = points.select("vid", "vec").mapInArrow(lambda it: placed(it, False), "vid long, vec binary, cell long")
    asking = points.filter("asks").select("vid", "vec", F.lit(float("-inf")).alias("bound")).mapInArrow(lambda it: placed(it, True), "vid long, vec binary, bound double, cell long")

    def visit(queries: DataFrame) -> DataFrame:
        """Searches of (vid, vec, bound, cell): (query, found, score)."""
        blocks = queries.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("blocks"))  # one row a cell
        left = base.join(blocks, "cell").select("cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "vid", "vec")
        right = queries.join(blocks, "cell").select("cell", F.pmod(F.xxhash64("vid"), F.col("blocks").cast("long")).cast("int").alias("block"), "vid", "vec", "bound")

        def run(a: pa.Table, b: pa.Table) -> pa.Table:
            query, found, score = [], [], []
            if len(a) and len(b):
                vids, asks = a["vid"].to_numpy(), b["vid"].to_numpy()
                for j, own, dots in search(_doubles(a["vec"]), _doubles(b["vec"]), b["bound"].to_numpy(), k + 1, image, quantile):
                    query.append(np.full(len(own), asks[j]))
                    found.append(vids[own])
                    score.append(dots)
            join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
            return pa.table({"query": pa.array(join(query, np.int64)), "found": pa.array(join(found, np.int64)), "score": pa.array(join(score, np.float64))})

        return left.groupBy("cell", "block").cogroup(right.groupBy("cell", "block")).applyInArrow(run, "query long, found long, score double")

    first = Kept(visit(asking), "ann-first").df
    if len(cells.lo) > 1:
        best = Window.partitionBy("query").orderBy(F.desc("score"))
        kth = first.withColumn("r", F.row_number().over(best)).filter(F.col("r") == k + 1).select(F.col("query").alias("vid"), F.col("score").alias("known"))

        def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                x = _doubles(b.column(1)) if len(b) else np.zeros((0, dim))
                points_, home = image.queries(x), cells.part_of(image.queries(x))
                for j, (vid, vec, bound) in enumerate(zip(*(c.to_pylist() for c in b.columns), strict=True)):
                    reach = quantile * max(float(x[j] @ x[j]) + image.largest - 2 * bound, 0.0) if bound > -math.inf else math.inf
                    out += [(vid, vec, bound, int(c)) for c in np.flatnonzero(cells.distances(points_[j]) <= reach) if c != home[j]]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.float64(), pa.int64()), strict=True)], ["vid", "vec", "bound", "cell"])

        others = points.filter("asks").select("vid", "vec").join(kth, "vid", "left").select("vid", "vec", F.coalesce("known", F.lit(float("-inf"))).alias("bound"))
        first = first.union(visit(Kept(others.mapInArrow(routed, "vid long, vec binary, bound double, cell long"), "ann-routed").df))
    near = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ids = points.select(F.col("vid").alias("found"), "ids")
    tops = first.join(ids, "found").select("query", "score", F.explode("ids").alias("vec_id")).withColumn("r", F.row_number().over(near)).filter(F.col("r") <= k + 1)
    lists = tops.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("r", "vec_id", "score"))).alias("near"))  # k + 1 each
    asked = rows.filter(F.col("vec_id") % every == 0).mapInArrow(lambda it: _collapse_each(it, dim), "query_id long, vec binary").distinct()
    joined = asked.join(points.select("vid", "vec"), "vec").join(lists, F.col("vid") == F.col("query"))
    own = F.slice(F.filter("near", lambda e: e["vec_id"] != F.col("query_id")), 1, k)
    return joined.select("query_id", F.posexplode(own).alias("pos", "e")).select("query_id", (F.col("pos") + 1).alias("rank"), "e.vec_id", "e.score")


def _collapse_each(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Ids and vectors of the rows that take part."""
    for batch in batches:
        rows = []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if i is not None and v is not None and len(v) == dim and None not in v:
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    rows.append((i, x.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], ["query_id", "vec"])
