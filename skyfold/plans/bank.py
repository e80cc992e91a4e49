"""The model bank as recursions: one over (pixel, model) for the filters, one for the weights. DuckDB only."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.plans.filtering import NOISE

R = X.rounded
#: Order and sigma2 of each model; the prior variance of each state; power of old weights; innovation that freezes weights.
MODELS = ((1, "5e-3"), (1, "5e-2"), (1, "5e-1"), (2, "5e-3"))
DIFFUSE, FORGET, CALM = "1e4", "98e-2", "4e0"
_X, _P = ("x0", "x1", "x2"), ("p00", "p01", "p02", "p11", "p12", "p22")


def _after(prior: dict[str, str]) -> str:
    """The states after a frame, its innovation and its evidence."""
    v, e = f"({prior['p00']}+{NOISE})", f"(y-{prior['x0']})"
    now = {f"x{i}": f"{prior[f'x{i}']}+{prior[f'p0{i}']}/{v}*{e}" for i in range(3)}
    now |= {f"p0{i}": f"{NOISE}*{prior[f'p0{i}']}/{v}" for i in range(3)}
    now |= {f"p{i}{j}": f"{prior[f'p{i}{j}']}-{prior[f'p0{i}']}*{prior[f'p0{j}']}/{v}" for i, j in ((1, 1), (1, 2), (2, 2))}
    z = f"({e}/sqrt({v}))"
    kept = [f"case when ok then {now[c]} else {prior[c]} end {c}" for c in _X + _P]
    return ", ".join([*kept, f"case when ok then {z} else 0e0 end z", f"case when ok then -(ln(2e0*pi()*{v})+{z}*{z})/2e0 else 0e0 end l"])


def recursion(series: str) -> str:
    """Over series(pix, k, t, y, ok), k from 1."""
    models = ", ".join(f"({i}, {q}, {s})" for i, (q, s) in enumerate(MODELS))
    zero = dict.fromkeys(_X + _P, "0e0") | {"p00": DIFFUSE, "p11": DIFFUSE, "p22": f"(case when q=2 then {DIFFUSE} else 0e0 end)"}
    two = lambda a, b: f"s2*(case when q=2 then {a} else {b} end)"
    ahead = f"""select *, x0+d*x1+h*x2 n0, x1+d*x2 n1, x2 n2, a00+d*a01+h*a02+{two('d*d*d*d*d/20e0', 'd*d*d/3e0')} n00, a01+d*a02+{two('d*d*d*d/8e0', 'd*d/2e0')} n01,
  a02+{two('d*d*d/6e0', '0e0')} n02, a11+d*a12+{two('d*d*d/3e0', 'd')} n11, a12+{two('d*d/2e0', '0e0')} n12, p22+{two('d', '0e0')} n22 from (
 select *, p00+d*p01+h*p02 a00, p01+d*p11+h*p12 a01, p02+d*p12+h*p22 a02, p11+d*p12 a11, p12+d*p22 a12 from (
 select s.pix, f.m, f.q, f.s2, s.k, s.t, s.y, s.ok, s.t-f.t d, (s.t-f.t)*(s.t-f.t)/2e0 h, {', '.join('f.' + c for c in _X + _P)} from f join series s on s.pix=f.pix and s.k=f.k+1) b) c"""
    return f"""with recursive series as ({series}), model(m, q, s2) as (values {models}), f as (
 select pix, m, q, s2, k, t, y, ok, {_after(zero)} from series cross join model where k=1
 union all select pix, m, q, s2, k, t, y, ok, {_after({c: 'n' + c[1:] for c in _X + _P})} from ({ahead}) n),
e as (select pix, m, k, t, x0, z, l, ok and max(abs(z)) over (partition by pix, k)<={CALM} moves from f),
g as (select pix, m, k, t, x0, z, case when moves then l else 0e0 end lw from e where k=1
 union all select e.pix, e.m, e.k, e.t, e.x0, e.z, case when moves then {FORGET}*g.lw+e.l else g.lw end from g join e on e.pix=g.pix and e.m=g.m and e.k=g.k+1),
w as (select *, u/sum(u) over (partition by pix, k) w from (select *, exp(lw-max(lw) over (partition by pix, k)) u from g) a),
o as (select *, row_number() over (partition by pix, k order by round(w,9) desc, m) bw, row_number() over (partition by pix, k order by round(abs(z),9) desc, m) bz from w)
select pix, k, {R('max(t)', 6)} t, {R('sum(w*x0)', 4)} mean, cast(max(case when bw=1 then m end) as int) best, {R('max(case when bw=1 then w end)', 6)} weight,
 cast(max(case when bz=1 then m end) as int) scale, {R('max(case when bz=1 then z end)', 5)} znorm from o group by pix, k"""
