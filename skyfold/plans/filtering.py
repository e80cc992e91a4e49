"""Kalman filter steps, frame statistics and views of maps."""

from __future__ import annotations

from skyfold.functions import expressions as X

R = X.rounded
#: ln(99) over a shift of 0.5, in thousandths: both errors 1 in 100.
WALD = 9190
SIGMA2, NOISE, DIFFUSE = "5e-2", "2e-1", "1e6"
OBS = "not bool_or(isnan(val) or abs(val)=cast('Infinity' as double)) and not bool_and(val=0e0)"
OBS_DUCK = OBS
_S = {c: c for c in X.STATE}
_STEP = "select event_id, 1e-1+(user_id%7)*1e-1 dt, value y, value*5e-1 x0, value*1e-1 x1, 1e0+(event_id%5) p00, 2e-1 p01, 5e-1 p11 from events"


def _list(d: dict[str, str], digits: int = 8) -> str:
    return ", ".join(f"{R(v, digits)} {k}" for k, v in d.items())


def recursion(series: str, keys: str = "pix") -> str:
    """The filter as a recursive query over series(pix, k, t, y, ok), k from 1: the definition that the operators match."""
    zero = {"x0": "0e0", "x1": "0e0", "p00": DIFFUSE, "p01": "0e0", "p11": DIFFUSE}

    def step(prior: dict[str, str]) -> str:
        u = X.update("y", NOISE, prior)
        parts = [f"case when ok then {u[c]} else {prior[c]} end {c}" for c in X.STATE]
        return ", ".join([*parts, f"case when ok then {u['e']}/sqrt({u['v']}) else 0e0 end znorm"])

    named = {c: f"q{c}" for c in X.STATE}
    ahead = X.predict("(s.t-f.t)", SIGMA2, {c: f"f.{c}" for c in X.STATE})
    inner = ", ".join(f"{ahead[c]} q{c}" for c in X.STATE)
    return f"""with recursive series as ({series}), f as (
 select {keys}, k, t, y, ok, {step(zero)} from series where k=1
 union all select {keys}, k, t, y, ok, {step(named)} from (select s.{keys}, s.k, s.t, s.y, s.ok, {inner} from f join series s on s.{keys}=f.{keys} and s.k=f.k+1) n)
select {keys}, k, {R('t', 6)} t, {R('x0', 5)} filtered, {R('znorm', 5)} znorm from f"""


def smoother(series: str, lag: int) -> str:
    """The fixed-lag smoother as a second recursion, from each frame's last look back to it (Joseph form)."""
    forward, q = recursion(series).rpartition("\nselect")[0], SIGMA2
    return f"""{forward}, ends as (select pix, max(k) n from f group by pix), b as (
 select f.pix, o.k, f.k j, f.t, f.x0, f.x1, f.p00, f.p01, f.p11 from f join (select s.pix, s.k, least(s.k+{lag}, e.n) last from f s join ends e on e.pix=s.pix) o on o.pix=f.pix and f.k=o.last
 union all
 select pix, k, j-1, t, f0+c00*e0+c01*e1, f1+c10*e0+c11*e1,
   m00*m00*f00+2*m00*m01*f01+m01*m01*f11+c00*c00*w00+2*c00*c01*w01+c01*c01*w11,
   m00*(m10*f00+m11*f01)+m01*(m10*f01+m11*f11)+c00*(c10*w00+c11*w01)+c01*(c10*w01+c11*w11),
   m10*m10*f00+2*m10*m11*f01+m11*m11*f11+c10*c10*w00+2*c10*c11*w01+c11*c11*w11 from (
 select *, -m01-d*c00 c01, 1-m11-d*c10 c11 from (
 select *, 1-m00 c00, -m10 c10, s0-f0-d*f1 e0, s1-f1 e1, s00+{q}*d*d*d/3e0 w00, s01+{q}*d*d/2e0 w01, s11+{q}*d w11 from (
 select *, ({q}*(d*d*h/2e0-d*d*d*f11/6e0)+{q}*{q}*d*d*d*d/12e0)/det m00, -{q}*((f00+d*f01)*d*d/2e0-f01*d*d*d/6e0)/det m01,
   -{q}*(h*d-f11*d*d/2e0)/det m10, ({q}*(d*f00+d*d*f01/2e0)+{q}*{q}*d*d*d*d/12e0)/det m11 from (
 select *, f01+d*f11 h, f00*f11-f01*f01+{q}*(d*f00+d*d*f01+d*d*d*f11/3e0)+{q}*{q}*d*d*d*d/12e0 det from (
 select b.pix, b.k, b.j, f.t, b.t-f.t d, b.x0 s0, b.x1 s1, b.p00 s00, b.p01 s01, b.p11 s11, f.x0 f0, f.x1 f1, f.p00 f00, f.p01 f01, f.p11 f11
 from b join f on f.pix=b.pix and f.k=b.j-1 where b.j>b.k) u) v) w) x) y)
select pix, k, {R('t', 6)} t, {R('x0', 5)} smoothed, {R('p00', 7)} variance from b where j=k"""


SERIES = "select pix, row_number() over (partition by pix order by t, event_id) k, t, y, true ok from lightcurve"
GAP = f"""select m.pix, row_number() over (partition by m.pix order by f.t) k, f.t, m.val y, o.ok from (select frame, pix, case when frame=5 then 0e0 else val end val from maps48) m join frames f on f.frame=m.frame
 join (select frame, {OBS} ok from (select frame, case when frame=5 then 0e0 else val end val from maps48) z group by frame) o on o.frame=m.frame"""


def sql() -> dict[str, str | tuple[str, str]]:
    ahead = X.predict("dt", SIGMA2, _S)
    now = X.update("y", NOISE, _S)
    blank = "select frame, pix, case when frame=3 then 0e0 when frame=7 and pix=0 then cast('NaN' as double) else val end val from maps48"
    kalman = {c: now[c] for c in X.STATE} | {"znorm": f"{now['e']}/sqrt({now['v']})"}
    running = "rows between unbounded preceding and current row"
    z = "select pix, event_id, k, cast(round((y-1e0)*1e3) as bigint) z from (select pix, event_id, y, row_number() over (partition by pix order by t, event_id) k from lightcurve) s"
    last = {n: f"(cast(sum(z) over (partition by pix order by k rows between {n - 1} preceding and current row) as bigint)*1e0)" for n in (1, 2, 4, 8, 16)}
    glr = ", ".join(f"{w}*{w}/{2 * n}e0" for n, w in last.items())  # squares of whole numbers over powers of two: exact
    return {
        "frame_has_observation": (f"select frame, {OBS} ok from ({blank}) q group by frame", f"select frame, {OBS_DUCK} ok from ({blank}) q group by frame"),
        "iwp_transition": f"select event_id, {R('dt')} a01, {_list({'q00': f'{SIGMA2}*dt*dt*dt/3e0', 'q01': f'{SIGMA2}*dt*dt/2e0', 'q11': f'{SIGMA2}*dt'}, 10)} from ({_STEP}) q",
        "kalman_predict": f"select event_id, {_list(ahead)} from ({_STEP}) q",
        "kalman_update": f"select event_id, {_list(kalman)} from ({_STEP}) q",
        "frame_scale": f"select frame, {R('min(val)')} lo, {R('max(val)')} hi, {R('max(abs(val))')} sym from maps48 group by frame",
        "color_limits": f"select {R('percentile_cont(1e-2) within group (order by val)', 9)} p1, {R('percentile_cont(99e-2) within group (order by val)', 9)} p99, {R('percentile_cont(99e-2) within group (order by abs(val))', 9)} sym from maps48",
        "ring_buffer": "select pix, event_id, k seq from (select pix, event_id, row_number() over (partition by pix order by t desc, event_id desc) k from lightcurve) q where k<=10",
        "latest_frame": tuple(f"select pix, r.event_id, {R('r.t', 6)} t, {R('r.y', 6)} y from (select pix, {best} r from lightcurve group by pix) q" for best in ("max_by(struct(event_id, t, y), struct(t, event_id))", "arg_max({'event_id': event_id, 't': t, 'y': y}, {'a': t, 'b': event_id})")),
        "maps_pivot": f"select frame, {R('max(case when pix=0 then val end)')} p0, {R('max(case when pix=1 then val end)')} p1, {R('max(case when pix=2 then val end)')} p2, {R('avg(val)')} mean from maps48 group by frame",
        "frame_header": "select frame, '{\"type\":\"frame\",\"name\":\"raw\",\"seq\":'||cast(frame as string)||',\"npix\":'||cast(count(*) as string)||'}' header from maps48 group by frame",
        "nis": f"select pix, event_id, {R('s/(1e6*n)', 8)} nis from (select pix, event_id, cast(sum(z*z) over (partition by pix order by k rows between 7 preceding and current row) as bigint)*1e0 s, count(*) over (partition by pix order by k rows between 7 preceding and current row) n from ({z}) q) w",
        "evidence": f"select pix, event_id, {R(f'sum(-5e-1*(ln(2e0*pi()*2e-1)+(z*1e-3)*(z*1e-3)/2e-1)) over (partition by pix order by k {running})', 3)} evidence from ({z}) q",
        "cusum": f"select pix, event_id, cast(s-least(0,min(s) over (partition by pix order by k {running})) as bigint) g from (select pix, event_id, k, cast(sum(z-250) over (partition by pix order by k {running}) as bigint) s from ({z}) q) w",
        "cusum_negative": f"select pix, event_id, cast(s-least(0,min(s) over (partition by pix order by k {running})) as bigint) g from (select pix, event_id, k, cast(sum(-z-250) over (partition by pix order by k {running}) as bigint) s from ({z}) q) w",
        # Wald's test of a shift of half a standard deviation (of 50, about a mean of 50) against none: the first frame past a bound decides
        "sprt": f"""select pix, case when min(case when abs(s)>={WALD} then k end) is null then 'open' when max(case when k=d then s end)>0 then 'shift' else 'none' end decision, cast(coalesce(max(d), max(k)) as bigint) frames from (
 select *, min(case when abs(s)>={WALD} then k end) over (partition by pix) d from (
 select pix, k, cast(sum(z-250) over (partition by pix order by k {running}) as bigint) s from (select pix, row_number() over (partition by pix order by t, event_id) k, cast(round((y-5e1)*2e1) as bigint) z from lightcurve) q) v) w group by pix""",
        "glr": f"select pix, event_id, greatest({glr})*1e-6 glr from ({z}) q",
    }
