"""Visibilities with planted gains over a catalogue model, and the fixed point of robust calibration as a recursion."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.plans.geometry import BROT, FREQ, SKY

R = X.rounded
#: The model of a frame's baselines: the catalogue's sources, their flux in kJy.
_ph = X.phase(("b.bx", "b.by_", "b.bz"), ("s.x", "s.y", "s.z"), FREQ)
MODEL = f"select frame, a1, a2, sum(jy*1e-3*cos(ph)) mre, sum(jy*1e-3*sin(ph)) mim from (select b.frame, b.a1, b.a2, s.jy, {_ph} ph from ({BROT}) b join ({SKY}) s on s.frame=b.frame) q group by frame, a1, a2"
_g = X.polar("p.amp", "p.ph") * X.polar("q.amp", "q.ph").conj()
_m = X.Cx("m.mre", "m.mim")
_v = _g * _m
#: The view ``gain`` applied to the model, with the rows of ``vis`` as noise and one row in thirteen spoilt.
OBSERVED = f"""select cast(v.frame as bigint) interval, v.a1, v.a2, {_v.re}+v.re*4e0+case when (v.a1*v.a1+v.a2+v.frame)%13=0 then 2e2 else 0e0 end re, {_v.im}+v.im*4e0 im,
  case when p.amp*q.amp=0e0 then 0e0 else 25e0 end w, m.mre, m.mim
from vis v join gain p on p.a=v.a1 join gain q on q.a=v.a2 join ({MODEL}) m on m.frame=v.frame and m.a1=v.a1 and m.a2=v.a2"""
#: The noise cools by a factor of 4 every COOL half-steps, from the geometric mean of what gains of 1 leave.
NU, COOL, ALL = "4e0", 40, 800


def recursion() -> str:
    """Half-steps of the alternation from 1 under the weights of Student's t; DuckDB only."""
    gq, gp, v, m = X.Cx("gq.re", "gq.im"), X.Cx("gp.re", "gp.im"), X.Cx("b.re", "b.im"), X.Cx("b.mre", "b.mim")
    num, fit = v * m.conj() * gq, gp * m * gq.conj()
    weight = f"(b.w*({NU}+2e0)/({NU}+b.w*((b.re-{fit.re})*(b.re-{fit.re})+(b.im-{fit.im})*(b.im-{fit.im}))/greatest(1e0,h.s*power(25e-2,gp.n//{COOL}))))"
    return f"""with recursive obs as materialized ({OBSERVED}), b as materialized (select interval, a1 p, a2 q, re, im, w, mre, mim from obs where w>0e0 union all select interval, a2, a1, re, -im, w, mre, -mim from obs where w>0e0),
heat as materialized (select interval, greatest(1e0,exp(avg(ln(w*((re-mre)*(re-mre)+(im-mim)*(im-mim)))))) s from b group by interval), g as (
 select 0 n, interval, p a, 1e0 re, 0e0 im from b group by interval, p
 union all
 select n+1, interval, a, (sum(wt*nr)/sum(wt*d)+any_value(re))/2e0, (sum(wt*ni)/sum(wt*d)+any_value(im))/2e0 from (
  select gp.n, gp.interval, gp.a, gp.re, gp.im, {weight} wt, {num.re} nr, {num.im} ni, {m.abs2()}*{gq.abs2()} d
  from b join g gp on gp.interval=b.interval and gp.a=b.p join g gq on gq.interval=b.interval and gq.a=b.q join heat h on h.interval=b.interval where gp.n<{ALL}) s group by n, interval, a),
ends as (select interval, a, re, im from g where n={ALL}),
first as (select interval, re fr, im fi, sqrt(re*re+im*im) size from (select *, row_number() over (partition by interval order by a) k from ends) r where k=1),
solved as (select e.interval, e.a, (e.re*fr+e.im*fi)/size re, (e.im*fr-e.re*fi)/size im from ends e join first f on f.interval=e.interval)"""


def sql() -> dict[str, str]:
    g = X.Cx("p.re", "p.im") * X.Cx("q.re", "q.im").conj()
    v = X.Cx("o.re", "o.im") / g
    zero = lambda e, d: R(f"coalesce({e},0e0)", d)
    return {
        "robust_gains": f"{recursion()} select interval, a, {R('re', 5)} re, {R('im', 5)} im from solved",
        "calibrated_residual": f"""{recursion()} select o.interval, o.a1, o.a2, {zero(f'{v.re}-o.mre', 3)} re, {zero(f'{v.im}-o.mim', 3)} im, {zero(f'o.w*{g.abs2()}', 4)} w
from obs o left join solved p on p.interval=o.interval and p.a=o.a1 left join solved q on q.interval=o.interval and q.a=o.a2""",
    }
