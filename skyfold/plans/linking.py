"""Detections of fixed and moving objects with false alarms among them, and what linking finds: definitions in SQL."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.operators.linking import AXES, angle, chord2

R = X.rounded
#: Degrees an hour, degrees, hours: the gate of a link, error of a place; rate from which a track moves; age of a prediction and reach of a match.
RATE, TOL, GAP = "25e-2", "15e-2", "24e0"
MOVING, AGE, NEAR = "6e-2", "24e0", "4e-1"
DEGREE = "17453292519943295e-18"
#: The hour at which objects stand at their base.
EPOCH = "473352e0"
_AT = lambda ra, dec: ", ".join(f"{v} {c}" for v, c in zip(X.unit_vector(ra, dec), AXES, strict=True))
_RA, _DEC = "(((pix*37)%360)*1e0+((pix%3)*1e-1)*(t-{})+{})", "(((pix*53)%120)-60+{})"
#: Each event is a detection of its user's object; every eleventh is a false alarm somewhere.
DETECTIONS = f"""select id, t, confirmed, {_AT('ra', 'dec')} from (select event_id id, t, y>=5e0 confirmed,
 case when event_id%11=0 then ((event_id*7919)%3600)*1e-1 else {_RA.format(EPOCH, '((event_id*31)%21-10)*5e-3')} end ra,
 case when event_id%11=0 then ((event_id*104729)%1200)*1e-1-60e0 else {_DEC.format('((event_id*17)%19-9)*5e-3')} end dec from lightcurve) d"""
#: Where a third of the objects is predicted to stand, once a day.
PASSES = f"""select 'OBJ-'||cast(pix as string) name, t, {_AT(_RA.format(EPOCH, '0e0'), _DEC.format('0e0'))} from (
 select pix, {EPOCH}+24e0*dayno t from (select distinct pix from lightcurve where pix%3=2) o cross join (select distinct cast(floor((t-{EPOCH})/24e0) as bigint) dayno from lightcurve) d) p"""


def sql() -> dict[str, str]:
    ab = lambda side, table: ", ".join(f"{table}.{c} {side}{c}" for c in AXES)
    link = f"""select *, apart/(tb-ta) rate from (select *, {angle(chord2('f', 'h'))} apart from (
 select a.id a, b.id b, a.t ta, b.t tb, {ab('f', 'a')}, {ab('h', 'b')} from det a join det b on b.t>a.t and b.t<=a.t+{GAP}) p) q where apart<={RATE}*{DEGREE}*(tb-ta)+{TOL}*{DEGREE}"""
    known = f"select * from (select name, t t0, lead(t) over (partition by name order by t) t1, {', '.join(f'{c} p{c}, lead({c}) over (partition by name order by t) q{c}' for c in AXES)} from ({PASSES}) k) l where t1-t0<={AGE}"
    line = ", ".join(f"p{c}+((t-t0)/(t1-t0))*(q{c}-p{c}) l{c}" for c in AXES)
    near = f"""select id, name, apart from (select *, row_number() over (partition by id order by apart, name) k from (select id, name, round({angle(chord2('d', 's'))},9) apart from (
 select *, {', '.join(f'l{c}/sqrt(lx*lx+ly*ly+lz*lz) s{c}' for c in AXES)} from (select d.id, k.name, {ab('d', 'd')}, {line} from det d join ({known}) k on d.t>=k.t0 and d.t<k.t1) m) n) o where apart<={NEAR}*{DEGREE}) z where k=1"""
    step = f"""select * from (select *, round(sqrt({'+'.join(f'(e{c}/sqrt(ex*ex+ey*ey+ez*ez)-h{c})*(e{c}/sqrt(ex*ex+ey*ey+ez*ez)-h{c})' for c in AXES)})/({TOL}*{DEGREE}*sqrt(2e0+2e0*r+2e0*r*r)),9) score from (
 select *, {', '.join(f'f{c}+r*(f{c}-p{c}) e{c}' for c in AXES)} from (select p.a p, n.a, n.b, p.ta tp, n.tb, (n.tb-n.ta)/(p.tb-p.ta) r, {', '.join(f'p.f{c} p{c}, n.f{c}, n.h{c}' for c in AXES)} from link p join link n on n.a=p.b) i) j) k where score<=1e0"""
    head = f"with det as materialized ({DETECTIONS})"
    return {
        "kinematic_links": f"{head} select a, b, {R('tb-ta', 6)} dt, {R('rate', 8)} rate from ({link}) l",
        "predicted_matches": f"{head} select id, name, apart+0e0 apart from ({near}) m",
        "kinematic_tracks": f"""with recursive det as materialized ({DETECTIONS}), link as materialized ({link}), near as materialized ({near}), step as materialized ({step}),
on_ as materialized (select a.p, a.a, a.b from (select p, a, b, row_number() over (partition by p, a order by tb, score, b) k from step) a
 join (select p, a, b, row_number() over (partition by a, b order by tp desc, score, p) k from step) z on z.p=a.p and z.a=a.a and z.b=a.b where a.k=1 and z.k=1),
walk as (select l.a fa, l.b fb, l.a, l.b from link l where not exists (select 1 from on_ o where o.a=l.a and o.b=l.b) union all select w.fa, w.fb, o.a, o.b from walk w join on_ o on o.p=w.a and o.a=w.b),
member as (select fa, fb, b id from walk union all select fa, fb, a from walk where a=fa and b=fb),
track as (select fa, fb, count(*) n, min(t) t0, max(t) t1, sqrt({'+'.join(f'pow(regr_slope({c}, t), 2)' for c in AXES)}) rate, count(*) filter (confirmed) confirmed from member m join det d on d.id=m.id group by fa, fb having count(*)>=3),
vote as (select fa, fb, name, votes, row_number() over (partition by fa, fb order by votes desc, name) k from (select fa, fb, name, count(*) votes from member m join near n on n.id=m.id group by fa, fb, name) v)
select fa track_a, fb track_b, n, {R('t0', 6)} t0, {R('t1', 6)} t1, {R('rate', 7)} rate, confirmed, coalesce(votes,0) matched, name,
 case when rate>{MOVING}*{DEGREE} or name is not null then 'ssa' when confirmed>=n*5e-1 then 'astrophysical' else 'diagnostics' end stream
from (select t.*, v.votes, case when v.votes>=t.n*5e-1 then v.name end name from track t left join vote v on v.fa=t.fa and v.fb=t.fb and v.k=1) u""",
    }
