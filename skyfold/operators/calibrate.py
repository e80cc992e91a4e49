"""Antenna gains from visibilities and a model: alternating least squares inside robust reweighting.

V_pq = g_p M_pq conj(g_q) within an interval. For fixed weights the gains depend on the rows only through two sums a
baseline, of w V conj(M) and of w |M|^2, so a round is one aggregation (combined before its shuffle) to a row for each
interval and baseline; alternating steps (Salvini and Wijnholds 2014) then run inside a task on those sums, whose number
the array bounds. Rounds reweight each row by a Student-t likelihood on its own residual, (nu + 2) / (nu + w |r|^2), until
no gain moves. The noise starts at what gains of 1 leave, in geometric
mean, which few outliers cannot lift, and cools to the stated one (plain least squares as a start would already have
followed the outliers). Intervals whose gains stand still are not computed again. The weights stay inside: what uses the gains
keeps the thermal ones, for a source that no catalogue knows looks like an outlier here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyfold.session import require_schema, stored

NU = 4.0
#: Alternating steps of one round at most.
STEPS = 500
#: The noise variance taken for the weights falls by this factor a round, from the geometric mean of what gains of 1 leave to the stated one.
COOL = 4.0
_STATE = "interval long, re array<double>, im array<double>, rounds int, moved double, scale double"


def alternate(data: np.ndarray, power: np.ndarray, start: np.ndarray, tol: float) -> np.ndarray:
    """Gains from Hermitian sums data[p, q] of w V conj(M) and symmetric power[p, q] of w |M|^2; 0 where an antenna has no
    row. Every second step is the mean with the one before, which ends the oscillation of plain alternation."""
    alive = power.sum(1) > 0
    g = np.where(alive, np.where(start == 0, 1.0, start), 0)
    for i in range(STEPS):
        below = power @ (g.real**2 + g.imag**2)
        new = np.divide(data @ g, below, out=np.zeros_like(g), where=below > 0)
        if i % 2:
            new = (new + g) / 2
        moved = np.abs(new - g).max(initial=0)
        g = new
        if moved <= tol * np.abs(g).max(initial=0):
            break
    return g


def referenced(g: np.ndarray) -> np.ndarray:
    """The phase of the first antenna that has a gain is 0: a common phase is not in the data."""
    first = np.flatnonzero(g)
    return g * np.conj(g[first[0]]) / abs(g[first[0]]) if len(first) else g


def _residual() -> Column:
    """|V - g_p M conj(g_q)|^2 with the gains of the round before in the arrays g_re and g_im; 1 before the first."""
    at = lambda c, a, start: F.coalesce(F.get(c, F.col(a)), F.lit(start))
    pr, pi, qr, qi = at("g_re", "a1", 1.0), at("g_im", "a1", 0.0), at("g_re", "a2", 1.0), at("g_im", "a2", 0.0)
    fr, fi = pr * qr + pi * qi, pi * qr - pr * qi
    dr, di = F.col("re") - (fr * F.col("mre") - fi * F.col("mim")), F.col("im") - (fr * F.col("mim") + fi * F.col("mre"))
    return dr * dr + di * di


def _solver(tol: float):
    names = [c.split()[0] for c in _STATE.split(", ")]
    kinds = [pa.int64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sums = row["sums"]
                p, q = np.array([s["a1"] for s in sums]), np.array([s["a2"] for s in sums])
                n = int(max(p.max(), q.max())) + 1
                data, power = np.zeros((n, n), complex), np.zeros((n, n))
                v = np.array([complex(s["vr"], s["vi"]) for s in sums])
                m = np.array([s["mm"] for s in sums])
                np.add.at(data, (p, q), v), np.add.at(data, (q, p), v.conj())
                np.add.at(power, (p, q), m), np.add.at(power, (q, p), m)
                before = np.zeros(n, complex)
                if row["g_re"]:
                    k = min(n, len(row["g_re"]))
                    before[:k] = np.array(row["g_re"][:k]) + 1j * np.array(row["g_im"][:k])
                g = referenced(alternate(data, power, before, tol / 10))
                moved = float(np.abs(g - before).max() / max(np.abs(g).max(), 1e-300))
                out.append((row["interval"], g.real.tolist(), g.imag.tolist(), row["rounds"] + 1, moved if row["scale"] <= 1 else 1.0, max(1.0, row["scale"] / COOL)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)], names)

    return run


def gains(rows: DataFrame, nu: float | None = NU, tol: float = 1e-7, rounds: int = 60) -> DataFrame:
    """rows(interval, a1, a2, re, im, w, mre, mim) to (interval, a, re, im, rounds): a gain for each antenna that has a row.

    Antennas are numbered from 0. ``nu`` None: plain least squares. An interval ends when its largest gain moves by less
    than ``tol`` of it, or after ``rounds``; a likelihood with heavy tails has many ends, and cooling is to reach that of
    most rows. Rows that hold a null or a number that is not finite, rows without weight, of an antenna with itself or of a
    negative antenna number are left out; an antenna without any other row has no gain, an interval without any other row
    no output. Repeated rows count each time.
    """
    require_schema(rows, "interval a1 a2 re im w mre mim")
    values = ("re", "im", "w", "mre", "mim")
    good = F.lit(True)
    for c in values:
        good = good & (F.abs(F.col(c)) < float("inf"))  # nan is above infinity
    own = rows.select(F.col("interval").cast("long"), F.col("a1").cast("int"), F.col("a2").cast("int"), *[F.col(c).cast("double") for c in values]).filter(good & (F.col("w") > 0) & (F.col("a1") >= 0) & (F.col("a2") >= 0) & (F.col("a1") != F.col("a2")) & F.col("interval").isNotNull())
    own = stored(own, "calibrate")
    none = F.lit(None).cast("array<double>")
    off = _residual() * F.col("w")
    start = own.withColumns({"g_re": none, "g_im": none}).groupBy("interval").agg(F.greatest(F.lit(1.0), F.coalesce(F.exp(F.avg(F.ln(off))), F.lit(1.0))).alias("scale"))
    held = start.select("interval", none.alias("g_re"), none.alias("g_im"), F.lit(0).alias("rounds"), "scale" if nu else F.lit(1.0).alias("scale"))
    done, most = [], rounds if nu else 1
    power = F.col("mre") * F.col("mre") + F.col("mim") * F.col("mim")
    for i in range(most):
        weight = F.col("w") * (nu + 2) / (F.lit(nu) + off / F.col("scale")) if nu else F.col("w")
        sums = own.join(held, "interval").groupBy("interval", "a1", "a2").agg(
            F.sum(weight * (F.col("re") * F.col("mre") + F.col("im") * F.col("mim"))).alias("vr"),
            F.sum(weight * (F.col("im") * F.col("mre") - F.col("re") * F.col("mim"))).alias("vi"),
            F.sum(weight * power).alias("mm"),
        )
        packed = sums.groupBy("interval").agg(F.array_sort(F.collect_list(F.struct("a1", "a2", "vr", "vi", "mm"))).alias("sums"))
        state = stored(packed.join(held, "interval").mapInArrow(_solver(tol), _STATE), "gains")
        if i + 1 == most:
            done.append(state)
            break
        done.append(state.filter(F.col("moved") <= tol))
        held = state.filter(F.col("moved") > tol).select("interval", F.col("re").alias("g_re"), F.col("im").alias("g_im"), "rounds", "scale")
        if held.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    each = out.select("interval", "rounds", F.posexplode(F.arrays_zip("re", "im")).alias("a", "g"))
    return each.filter("g.re <> 0 or g.im <> 0").select("interval", "a", "g.re", "g.im", "rounds")


def residuals(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """V / (g_p conj(g_q)) - M with the thermal weight w |g_p g_q|^2, for every row; 0 and no weight where an
    antenna has no gain or the row holds a null.

    rows(interval, a1, a2, re, im, w, mre, mim) and what :func:`gains` gives; other columns of rows stay.
    """
    side = lambda n: solved.select(F.col("interval").alias("_i" + n), F.col("a").alias("_a" + n), F.col("re").alias("_r" + n), F.col("im").alias("_m" + n))
    both = rows.join(side("1"), (F.col("interval") == F.col("_i1")) & (F.col("a1") == F.col("_a1")), "left").join(side("2"), (F.col("interval") == F.col("_i2")) & (F.col("a2") == F.col("_a2")), "left")
    fr, fi = F.col("_r1") * F.col("_r2") + F.col("_m1") * F.col("_m2"), F.col("_m1") * F.col("_r2") - F.col("_r1") * F.col("_m2")
    size = fr * fr + fi * fi
    re, im = (F.col("re") * fr + F.col("im") * fi) / size - F.col("mre"), (F.col("im") * fr - F.col("re") * fi) / size - F.col("mim")
    whole = re.isNotNull() & im.isNotNull() & F.col("w").isNotNull()
    rest = {n: F.when(whole, c).otherwise(0.0) for n, c in {"re": re, "im": im, "w": F.col("w") * size}.items()}
    return both.select(*[rest[c].alias(c) if c in rest else F.col(c) for c in rows.columns])
