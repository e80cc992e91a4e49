"""Alarms on dirty maps, merged and held against the point-spread function: definitions in SQL."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.plans.geometry import FREQ, SKY
from skyfold.plans.imaging import DIRTY, ROWS

R = X.rounded
NSIDE, ALARM = 4, "15e-1"
#: Each frame's map over its own spread.
MAPS = f"select frame, pix, dirty/s z from (select frame, pix, dirty, stddev_pop(dirty) over (partition by frame) s from ({DIRTY}) d) n where s>0e0"
#: Bright known sources.
KNOWN = f"select frame, name, x, y, z from ({SKY}) k where el>=6e1"


def corners(source: str, nside: int = NSIDE) -> str:
    """(frame, pix, z) with four keys of corners; places (u, v) on a base face as for the centres. DuckDB only."""
    o, n = nside.bit_length() - 1, nside
    ix = "+".join(f"((pix >> {2 * b}) & 1)*{1 << b}" for b in range(o))
    iy = "+".join(f"((pix >> {2 * b + 1}) & 1)*{1 << b}" for b in range(o))
    return f"""select frame, pix, z, cast(round(r*cos(phi)*1e6) as bigint) cx, cast(round(r*sin(phi)*1e6) as bigint) cy, cast(round(h*1e6) as bigint) cz from (
 select *, sqrt(greatest(1e0-h*h,0e0)) r, case when nr>0e0 then pi()/4e0*(jb*nr+u-v)/nr else 0e0 end phi from (
 select *, case when jr<1e0 then 1e0-nr*nr/3e0 when jr>3e0 then nr*nr/3e0-1e0 else (2e0-jr)*2e0/3e0 end h from (
 select *, case when jr<1e0 then jr when jr>3e0 then 4e0-jr else 1e0 end nr from (
 select *, (2+(f >> 2))*1e0-u-v jr, case when (f >> 2)=1 then 2*(f & 3) else 2*(f & 3)+1 end jb from (
 select a.frame, a.pix, a.z, a.pix >> {2 * o} f, (({ix})+i)*1e0/{n} u, (({iy})+j)*1e0/{n} v
 from ({source}) a cross join (select unnest([0,0,1,1]) i, unnest([0,1,0,1]) j) c) p) q) s) t) w"""


def sql() -> dict[str, str]:
    turn = lambda d: f"(2e0*pi()*({FREQ}/{X.C})*(r.bx*{d}.x+r.by_*{d}.y+r.bz*{d}.z))"
    merged = f"""with recursive maps as materialized ({MAPS}), alarm as materialized (select frame, pix, z from maps where z>={ALARM}), corner as materialized ({corners('select * from alarm')}),
edge as materialized (select distinct a.frame, a.pix, b.pix other from corner a join corner b on b.frame=a.frame and b.cx=a.cx and b.cy=a.cy and b.cz=a.cz),
reach as (select frame, pix, pix other from alarm union select r.frame, r.pix, e.other from reach r join edge e on e.frame=r.frame and e.pix=r.other),
label as (select frame, pix, min(other) component from reach group by frame, pix),
found as (select * from (select l.frame, l.component, l.pix, a.z, count(*) over (partition by l.frame, l.component) pixels, row_number() over (partition by l.frame, l.component order by a.z desc, l.pix) k
 from label l join alarm a on a.frame=l.frame and a.pix=l.pix) q where k=1)"""
    return {
        "alarm_components": f"{merged} select frame, cast(component as bigint) component, pixels, cast(pix as bigint) pix, {R('z', 6)} z from found",
        "confirm_candidates": f"""{merged}, row_ as materialized ({ROWS}), cell as materialized (select * from pix),
want as materialized (select f.frame, 'c'||cast(component as string) template, x, y, c.z from found f join cell c on c.pix=f.pix union select k.frame, 's'||name, x, y, z from ({KNOWN}) k where k.frame in (select frame from found)),
at_want as materialized (select t.frame, template, t.x, t.y, t.z, r.a1, r.a2, r.w, cos({turn('t')}) c, sin({turn('t')}) s from want t join row_ r on r.frame=t.frame where r.w>0e0),
at_cell as materialized (select r.frame, p.pix, r.a1, r.a2, cos({turn('p')}) c, sin({turn('p')}) s from row_ r cross join cell p where r.w>0e0),
psf as (select t.frame, t.template, t.x, t.y, t.z, p.pix, sum(t.w*(t.c*p.c+t.s*p.s))/sum(t.w) v from at_want t join at_cell p on p.frame=t.frame and p.a1=t.a1 and p.a2=t.a2 group by t.frame, t.template, t.x, t.y, t.z, p.pix),
fits as (select p.frame, p.template, p.x, p.y, sum(v*m.z)/nullif(sum(v*v),0e0) amplitude, sum(v*m.z)*sum(v*m.z)/nullif(sum(v*v)*sum(m.z*m.z),0e0) r2 from psf p join maps m on m.frame=p.frame and m.pix=p.pix group by p.frame, p.template, p.x, p.y, p.z),
known as (select frame, max(r2) k from fits where template like 's%' group by frame)
select f.frame, cast(f.component as bigint) component, f.pixels, cast(f.pix as bigint) pix, {R('f.z', 6)} z, {R('t.amplitude', 6)} amplitude, {R('t.r2', 7)} r2, {R('coalesce(k.k,0e0)', 7)} known_r2, {R('t.r2-coalesce(k.k,0e0)', 7)} contrast
from found f left join fits t on t.frame=f.frame and t.template='c'||cast(f.component as string) left join known k on k.frame=f.frame""",
    }
