"""Scalar expressions as SQL text, for ``F.expr`` and for whole statements: geodesy, Earth rotation, beam, complex numbers.

Literals carry exponents, so every engine reads them as doubles.
"""

from __future__ import annotations

from typing import NamedTuple

C = "299792458e0"
#: WGS84.
WGS84_A, WGS84_F = "6378137e0", "(1e0/298.257223563e0)"
WGS84_E2 = f"({WGS84_F}*(2e0-{WGS84_F}))"


class Cx(NamedTuple):
    """A complex number as a pair of expressions."""

    re: str
    im: str

    def __add__(self, o: Cx) -> Cx:
        return Cx(f"({self.re}+{o.re})", f"({self.im}+{o.im})")

    def __sub__(self, o: Cx) -> Cx:
        return Cx(f"({self.re}-({o.re}))", f"({self.im}-({o.im}))")

    def __mul__(self, o: Cx) -> Cx:
        return Cx(f"({self.re}*{o.re}-{self.im}*{o.im})", f"({self.re}*{o.im}+{self.im}*{o.re})")

    def __truediv__(self, o: Cx) -> Cx:
        n = o.abs2()
        return Cx(f"(({self.re}*{o.re}+{self.im}*{o.im})/{n})", f"(({self.im}*{o.re}-{self.re}*{o.im})/{n})")

    def conj(self) -> Cx:
        return Cx(self.re, f"(-({self.im}))")

    def scale(self, k: str) -> Cx:
        return Cx(f"({self.re}*{k})", f"({self.im}*{k})")

    def times_i(self) -> Cx:
        return Cx(f"(-({self.im}))", self.re)

    def abs2(self) -> str:
        return f"({self.re}*{self.re}+{self.im}*{self.im})"


def polar(amplitude: str, phase: str) -> Cx:
    return Cx(f"({amplitude}*cos({phase}))", f"({amplitude}*sin({phase}))")


def rounded(x: str, digits: int = 8) -> str:
    """Without a negative zero."""
    return f"(round({x},{digits})+0e0)"


def geodetic_to_ecef(lat: str, lon: str, alt: str) -> tuple[str, str, str]:
    """Degrees and metres to Earth-centred metres."""
    n = f"({WGS84_A}/sqrt(1e0-{WGS84_E2}*sin(radians({lat}))*sin(radians({lat}))))"
    return (f"(({n}+{alt})*cos(radians({lat}))*cos(radians({lon})))", f"(({n}+{alt})*cos(radians({lat}))*sin(radians({lon})))", f"(({n}*(1e0-{WGS84_E2})+{alt})*sin(radians({lat})))")


def enu_to_itrs(e: str, n: str, u: str, lat: str, lon: str) -> tuple[str, str, str]:
    """A local east-north-up vector in Earth-fixed axes."""
    sp, cp, sl, cl = f"sin(radians({lat}))", f"cos(radians({lat}))", f"sin(radians({lon}))", f"cos(radians({lon}))"
    return (f"(-{sl}*{e}-{sp}*{cl}*{n}+{cp}*{cl}*{u})", f"({cl}*{e}-{sp}*{sl}*{n}+{cp}*{sl}*{u})", f"({cp}*{n}+{sp}*{u})")


def dot(a: tuple[str, str, str], b: tuple[str, str, str]) -> str:
    return "(" + "+".join(f"{x}*{y}" for x, y in zip(a, b, strict=True)) + ")"


def cross(a: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[str, str, str]:
    return tuple(f"({a[i]}*{b[j]}-{a[j]}*{b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))  # type: ignore[return-value]


def unit_vector(ra: str, dec: str) -> tuple[str, str, str]:
    """Degrees to a unit vector."""
    return (f"(cos(radians({dec}))*cos(radians({ra})))", f"(cos(radians({dec}))*sin(radians({ra})))", f"sin(radians({dec}))")


ROTATION = [f"r{i}{j}" for i in "123" for j in "123"]


def earth_rotation(source: str, carry: str = "frame,t") -> str:
    """A query over rows with unix time t: the celestial-to-Earth matrix r11..r33 by IAU 2006 precession and sidereal time.

    Nutation, frame bias, polar motion and UT1-UTC are left out (below 20 arcseconds together with aberration).
    """
    arc = "*pi()/648e3"
    return f"""select {carry}, ca*ct*cz+sa*sz r11, -ca*ct*sz+sa*cz r12, -ca*st r13, -sa*ct*cz+ca*sz r21, sa*ct*sz+ca*cz r22, sa*st r23, st*cz r31, -st*sz r32, ct r33
from (select {carry}, cos(g-zz) ca, sin(g-zz) sa, cos(th) ct, sin(th) st, cos(ze) cz, sin(ze) sz
from (select {carry}, 2e0*pi()*(7790572732640e-13+273781191135448e-17*d+(d-floor(d)))+(14506e-6+4612156534e-6*c+13915817e-7*c*c){arc} g,
 (2650545e-6+2306083227e-6*c+2988499e-7*c*c){arc} ze, (-2650545e-6+2306077181e-6*c+10927348e-7*c*c){arc} zz, (2004191903e-6*c-4294934e-7*c*c){arc} th
from (select {carry}, d, d/36525e0 c from (select {carry}, (t-9467280e2)/864e2 d from {source}) er0) er1) er2) er3"""


def rotate(v: tuple[str, str, str], to_earth: bool, m: str = "") -> tuple[str, str, str]:
    """Earth-fixed to celestial (row vector times matrix), or back."""
    r = lambda i, j: f"{m}r{i}{j}"
    return tuple("(" + "+".join(f"{v[k]}*{r(j + 1, k + 1) if to_earth else r(k + 1, j + 1)}" for k in range(3)) + ")" for j in range(3))  # type: ignore[return-value]


def airy_power(mu: str, freq: str, diameter: str = "125e-3", terms: int = 14) -> str:
    """(2 J1(x)/x)^2 with x = pi D nu/c sin(theta), 0 below the horizon; ``mu`` is the cosine from boresight.

    A power series in (x/2)^2: good to 3e-15 up to x = 3. Wider apertures need more ``terms``.
    """
    from math import factorial

    q = f"(25e-2*pi()*pi()*{diameter}*{diameter}*({freq}/{C})*({freq}/{C})*greatest(1e0-{mu}*{mu},0e0))"
    series = "0e0"
    for k in reversed(range(terms)):
        series = f"({(-1) ** k}e0/({factorial(k)}e0*{factorial(k + 1)}e0)+{q}*{series})"
    return f"(case when {mu}>=0e0 then {series}*{series} else 0e0 end)"


def phase(b: tuple[str, str, str], s: tuple[str, str, str], freq: str) -> str:
    """2 pi nu/c (b . s)"""
    return f"(2e0*pi()*({freq}/{C})*{dot(b, s)})"


def stokes(v: list[Cx], circular: bool = False) -> dict[str, Cx]:
    """Correlations v00, v01, v10, v11 to Stokes parameters, without Jones matrices."""
    v00, v01, v10, v11 = v
    total, diff, both, anti = (v00 + v11).scale("5e-1"), (v00 - v11).scale("5e-1"), (v01 + v10).scale("5e-1"), (v10 - v01).times_i().scale("5e-1")
    return dict(zip("IQUV", (total, both, anti, diff) if circular else (total, diff, both, anti), strict=True))


def stokes_weights(w: list[str], circular: bool = False) -> dict[str, str]:
    near, far = f"({w[0]}+{w[3]})", f"({w[1]}+{w[2]})"
    return dict(zip("IQUV", (near, far, far, near) if circular else (near, near, far, far), strict=True))


def unjones(v: list[Cx], p: list[Cx], q: list[Cx]) -> list[Cx]:
    """P^-1 V Q^-H for 2x2 matrices given as four complex numbers each, row by row."""
    det = lambda m: m[0] * m[3] - m[1] * m[2]
    zero = Cx("0e0", "0e0")
    adj_p = [p[3], zero - p[1], zero - p[2], p[0]]
    qh = [q[0].conj(), q[2].conj(), q[1].conj(), q[3].conj()]
    adj_q = [qh[3], zero - qh[1], zero - qh[2], qh[0]]
    mul = lambda a, b: [a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3]]
    scale = det(p) * det(qh)
    return [x / scale for x in mul(mul(adj_p, v), adj_q)]


def jones_weights(w: list[str], p: list[Cx], q: list[Cx], circular: bool = False) -> dict[str, str]:
    """Weights of Stokes parameters behind Jones matrices: each correlation's weight times its squared slope.

    A correlation is an entry of P B Q^H, so its slope by a parameter is that entry with the parameter's part of B.
    """
    one, i = Cx("1e0", "0e0"), Cx("0e0", "1e0")
    minus = lambda z: Cx(f"(-{z.re})", f"(-{z.im})")
    diagonal, sides, anti, signs = {0: one, 3: one}, {1: one, 2: one}, {1: i, 2: minus(i)}, {0: one, 3: minus(one)}
    parts = dict(zip("IQUV", (diagonal, sides, anti, signs) if circular else (diagonal, signs, sides, anti), strict=True))

    def slope(a: int, b: int, part: dict[int, Cx]) -> Cx:
        total = Cx("0e0", "0e0")
        for at, z in part.items():
            total = total + p[2 * a + at // 2] * z * q[2 * b + at % 2].conj()
        return total

    return {s: "(" + "+".join(f"{w[2 * a + b]}*{slope(a, b, part).abs2()}" for a in (0, 1) for b in (0, 1)) + ")" for s, part in parts.items()}


#: What a correlation row becomes: kind of value, feed, and whether Jones matrices are given.
CONVERT = {
    ("VIS", "LINEAR", False): lambda v, p=None, q=None: stokes(v),
    ("VIS", "CIRCULAR", False): lambda v, p=None, q=None: stokes(v, True),
    ("VIS", "LINEAR", True): lambda v, p, q: stokes(unjones(v, p, q)),
    ("VIS", "CIRCULAR", True): lambda v, p, q: stokes(unjones(v, p, q), True),
    ("WEIGHT", "LINEAR", False): lambda w, p=None, q=None: stokes_weights(w),
    ("WEIGHT", "CIRCULAR", False): lambda w, p=None, q=None: stokes_weights(w, True),
    ("WEIGHT", "LINEAR", True): lambda w, p, q: jones_weights(w, p, q),
    ("WEIGHT", "CIRCULAR", True): lambda w, p, q: jones_weights(w, p, q, True),
}


def converter(kind: str, feed: str, jones: bool):
    """The entry of CONVERT; other polarisations are an error."""
    try:
        return CONVERT[kind, feed.upper(), jones]
    except KeyError:
        raise NotImplementedError(f"no conversion of {kind} for {feed} feeds") from None


STATE = ("x0", "x1", "p00", "p01", "p11")


def predict(dt: str, sigma2: str, s: dict[str, str]) -> dict[str, str]:
    """Integrated Wiener process over a time step: A x, A P A' + Q."""
    return {
        "x0": f"({s['x0']}+{dt}*{s['x1']})", "x1": s["x1"],
        "p00": f"({s['p00']}+2e0*{dt}*{s['p01']}+{dt}*{dt}*{s['p11']}+{sigma2}*{dt}*{dt}*{dt}/3e0)",
        "p01": f"({s['p01']}+{dt}*{s['p11']}+{sigma2}*{dt}*{dt}/2e0)", "p11": f"({s['p11']}+{sigma2}*{dt})",
    }


def update(y: str, noise: str, s: dict[str, str]) -> dict[str, str]:
    """Scalar observation of the first component; e and v are the innovation and its variance."""
    v, e = f"({s['p00']}+{noise})", f"({y}-{s['x0']})"
    return {
        "x0": f"({s['x0']}+{s['p00']}/{v}*{e})", "x1": f"({s['x1']}+{s['p01']}/{v}*{e})",
        "p00": f"({noise}*{s['p00']}/{v})", "p01": f"({noise}*{s['p01']}/{v})", "p11": f"({s['p11']}-{s['p01']}*{s['p01']}/{v})", "e": e, "v": v,
    }
