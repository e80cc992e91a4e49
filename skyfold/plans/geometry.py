"""Projections: geodesy, Earth rotation, directions, times, pixel grids, beam."""

from __future__ import annotations

from skyfold.fixtures import ALT, LAT, LON
from skyfold.functions import expressions as X

R = X.rounded
FREQ, FREQ2 = "157542e4", "15e8"

ITRS_ANT = "select a, name, {} x, {} y, {} z from ant".format(*X.enu_to_itrs("e", "n", "u", LAT, LON))
BASE = f"""select p.a a1, q.a a2, p.x-q.x bx, p.y-q.y by_, p.z-q.z bz from ({ITRS_ANT}) p join ({ITRS_ANT}) q on p.a<q.a"""
ROT = X.earth_rotation("frames")
ZENITH = X.geodetic_to_ecef(LAT, LON, ALT)
UP = (f"(cos(radians({LAT}))*cos(radians({LON})))", f"(cos(radians({LAT}))*sin(radians({LON})))", f"sin(radians({LAT}))")


def _zen() -> str:
    z = X.rotate(UP, to_earth=False)
    return f"select frame, t, {z[0]} zx, {z[1]} zy, {z[2]} zz from ({ROT}) rot"


ZEN = _zen()
_b = X.rotate(("bx", "by_", "bz"), to_earth=False)
BROT = f"select frame, t, a1, a2, {_b[0]} bx, {_b[1]} by_, {_b[2]} bz from ({BASE}) b cross join ({ROT}) rot"
MID = "select 5e-1*(min(t)+max(t)) t, 0 frame from frames"


def _azel() -> str:
    """Azimuth and elevation to celestial directions: local vector, Earth-fixed, celestial."""
    az, el = "radians(az)", "radians(el)"
    v = X.rotate(X.enu_to_itrs(f"(cos({el})*sin({az}))", f"(cos({el})*cos({az}))", f"sin({el})", LAT, LON), to_earth=False)
    return f"select c.frame, name, jy, el, {v[0]} x, {v[1]} y, {v[2]} z from catalog c join ({ROT}) rot on c.frame=rot.frame"


SKY = _azel()
RA, DEC = "degrees(atan2(y,x))", "degrees(asin(greatest(-1e0,least(1e0,z))))"
TRACKS = f"select frame, name, jy, case when {RA}<0e0 then {RA}+36e1 else {RA} end ra_deg, {DEC} dec_deg from ({SKY}) sky where el>=45e0"


def _uvw(s: tuple[str, str, str], b: tuple[str, str, str]) -> tuple[str, str, str]:
    """u, v, w of Earth-fixed baselines b towards s: u along pole x s."""
    u = X.cross(("0e0", "0e0", "1e0"), s)
    norm = f"sqrt({X.dot(u, u)})"
    unit = tuple(f"({c}/{norm})" for c in u)
    return X.dot(b, unit), X.dot(b, X.cross(s, unit)), X.dot(b, s)


def source_itrs(ra: str, dec: str) -> tuple[str, str, str]:
    return X.rotate(X.unit_vector(ra, dec), to_earth=True)


SRC = "select frame, t, {} sx, {} sy, {} sz from ({}) rot".format(*source_itrs("83e0", "22e0"), ROT)
UVW = "select frame, a1, a2, {} u, {} v, {} w from ({}) b cross join ({}) s".format(*_uvw(("sx", "sy", "sz"), ("bx", "by_", "bz")), BASE, SRC)
NOW = f"select frame, t, {', '.join(f'{e} {n}' for e, n in zip(X.rotate(('zx', 'zy', 'zz'), to_earth=True, m='rot.'), ('sx', 'sy', 'sz')))} from (select z.frame, z.t, zx, zy, zz, rot.* from ({ZEN}) z join (select frame fr, {', '.join(X.ROTATION)} from ({ROT}) rr) rot on z.frame=rot.fr) rot"


def _rephase() -> str:
    """Visibilities turned from the zenith to a fixed direction: l, m, n-1 and the phasor."""
    a, d, a2, d2 = "radians(ra0)", "radians(dec0)", "radians(83e0)", "radians(22e0)"
    lmn = (f"(cos({d2})*sin({a2}-{a}))", f"(sin({d2})*cos({d})-cos({d2})*sin({d})*cos({a2}-{a}))", f"(sin({d2})*sin({d})+cos({d2})*cos({d})*cos({a2}-{a})-1e0)")
    z = f"select frame, degrees(atan2(zy,zx)) ra0, degrees(asin(zz)) dec0 from ({ZEN}) z"
    uvw = "select n.frame, a1, a2, {} u, {} v, {} w from ({}) b cross join ({}) n".format(*_uvw(("sx", "sy", "sz"), ("bx", "by_", "bz")), BASE, NOW)
    ph = f"(-2e0*pi()*({FREQ}/{X.C})*(u*l+v*m+w*n1))"
    return f"""select frame,a1,a2, re*cos({ph})-im*sin({ph}) re, re*sin({ph})+im*cos({ph}) im, wt from (
 select v.frame,v.a1,v.a2,v.re,v.im,v.w wt,k.u,k.v,k.w,{lmn[0]} l,{lmn[1]} m,{lmn[2]} n1
 from vis v join ({uvw}) k on v.frame=k.frame and v.a1=k.a1 and v.a2=k.a2 join ({z}) z on v.frame=z.frame) q"""


REPHASED = _rephase()


def _cols(names: str, digits: int = 8) -> str:
    return ", ".join(f"{R(n, digits)} {n}" for n in names.split())


def sql() -> dict[str, str | tuple[str, str]]:
    from skyfold.fixtures import MICROS

    x = X.geodetic_to_ecef("lat", "lon", "h")
    site = X.geodetic_to_ecef(LAT, LON, ALT)
    micros = MICROS
    iso = {"spark": "date_format(ts,\"yyyy-MM-dd'T'HH:mm:ss\")||'Z'", "duckdb": "strftime(ts,'%Y-%m-%dT%H:%M:%S')||'Z'"}
    utc = {"spark": "date_format(ts,'yyyy-MM-dd HH:mm:ss')||' UTC'", "duckdb": "strftime(ts,'%Y-%m-%d %H:%M:%S')||' UTC'"}
    out: dict[str, str | tuple[str, str]] = {
        "geodetic_to_ecef": f"select s_suppkey id, {', '.join(f'{R(e, 4)} {n}' for e, n in zip(x, 'xyz'))} from (select s_suppkey, ((s_suppkey*37)%180)-9e1 lat, ((s_suppkey*53)%360)-18e1 lon, s_acctbal h from supplier) q",
        "enu_to_ecef": f"select a, {', '.join(f'{R(f'{s}+{n}', 6)} {n}' for s, n in zip(site, 'xyz'))} from ({ITRS_ANT}) q",
        "uvw_zenith": f"select v.frame, v.a1, v.a2, {R('p.e-q.e')} u, {R('p.n-q.n')} v, {R('p.u-q.u')} w from vis v join ant p on p.a=v.a1 join ant q on q.a=v.a2",
        "itrs_baselines": f"select a1, a2, {_cols('bx by_ bz')} from ({BASE}) q",
        "gain_complex": f"select a, {R('amp*cos(ph)')} re, {R('amp*sin(ph)')} im, amp=0e0 dead from gain",
        "antenna_names": "select a, name from ant",
        "radec_to_vec": "select id, {} x, {} y, {} z from (select p_partkey id, (p_partkey*7)%360+5e-1 ra, ((p_partkey*11)%180)-895e-1 dec from part) q".format(*map(R, X.unit_vector("ra", "dec"))),
        "azel_to_icrs": f"select frame, name, {_cols('x y z')}, {R(f'case when {RA}<0e0 then {RA}+36e1 else {RA} end', 6)} ra_deg, {R(DEC, 6)} dec_deg from ({SKY}) q",
        "zenith_vectors": f"select frame, {_cols('zx zy zz')} from ({ZEN}) q",
        "earth_rotation": f"select frame, {_cols(' '.join(X.ROTATION))} from ({ROT}) q",
        "baseline_rotate": f"select frame, a1, a2, {_cols('bx by_ bz', 7)} from ({BROT}) q",
        "source_itrs": f"select frame, {_cols('sx sy sz')} from ({SRC}) q",
        "uvw_project": f"select frame, a1, a2, {_cols('u v w', 6)} from ({UVW}) q",
        "rephase": f"select frame, a1, a2, {_cols('re im', 6)}, wt from ({REPHASED}) q",
        "rephase_field": f"select q.frame, q.a1, q.a2, {R('q.re', 6)} re, {R('q.im', 6)} im, {R('k.u', 6)} u, {R('k.v', 6)} v, {R('k.w', 6)} w, 'phasecenter' field_name, 'fk5' frame_name, 83e0 ra_deg, 22e0 dec_deg from ({REPHASED}) q join ({UVW}) k on q.frame=k.frame and q.a1=k.a1 and q.a2=k.a2",
        "pixel_grid": f"select pix, {_cols('x y z', 10)} from pix",
        "airy_beam": f"select frame, pix, {R(X.airy_power('mu', FREQ), 10)} beam from (select frame, pix, x*zx+y*zy+z*zz mu from pix cross join ({ZEN}) z) q",
        "common_phase_direction": f"select {R('degrees(atan2(zy,zx))', 7)} ra_deg, {R('degrees(asin(zz))', 7)} dec_deg from ({_zen().replace(ROT, X.earth_rotation(f'({MID}) mid'))}) q",
        "midpoint_time": "select frame, t from (select frame, t, row_number() over (order by t) k, count(*) over () n from frames) q where k=(n >> 1)+1",
        "frame_dt": f"select frame, t, {R('t-lag(t) over (order by t)')} dt from frames",
        "median_cadence": f"select {R('median(dt)')} cadence, {R('max(tm)', 3)} epoch from (select t-lag(t) over (order by t) dt, median(t) over () tm from frames) q",
        "frame_index": "select frame, t, row_number() over (order by t)-1 k from frames",
        "frame_means": f"select frame, {R('avg(t)', 3)} time_out, {R(f'avg({FREQ})', 3)} freq_out from frames group by frame",
        "lm_grid": f"select i, j, {R('x', 12)} x, {R('y', 12)} y, {R('-e/(sqrt(1e0-e)+1e0)', 14)} n1 from (select i, j, x, y, x*x+y*y e from (select a.a i, b.a j, (a.a-12)*2e-3 x, (b.a-12)*2e-3 y from ant a cross join ant b) g) h",
        "nyquist_cell": f"select {R('cell', 12)} cell, cast(nx+(nx%2) as bigint) nx from (select cell, cast(ceil(radians(1e0)/cell) as bigint) nx from (select 1e0/(2e0*uvmax*{FREQ}/{X.C}) cell from (select greatest(max(abs(u)),max(abs(v))) uvmax from (select p.e-q.e u, p.n-q.n v from vis w join ant p on p.a=w.a1 join ant q on q.a=w.a2) b) m) c) d",
    }
    for name, spark, duck in (("time_unix", micros["spark"], micros["duckdb"]),):
        out[name] = (f"select event_id, {R(f'{spark}/1e6', 6)} t from events", f"select event_id, {R(f'{duck}/1e6', 6)} t from events")
    out["time_format"] = (f"select event_id, {iso['spark']} datestr, {utc['spark']} label from events", f"select event_id, {iso['duckdb']} datestr, {utc['duckdb']} label from events")
    js = "'{\"name\":\"array\",\"frequency\":'||cast(1575420000+n_nationkey as string)||',\"lat\":-20.25,\"num_antenna\":'||cast(n_nationkey as string)||'}'"
    out["config_parse"] = (
        f"select k, c.name, c.frequency, c.lat, c.num_antenna from (select n_nationkey k, from_json({js}, 'name string, frequency double, lat double, num_antenna bigint') c from nation) q",
        f"select k, c->>'name' name, cast(c->>'frequency' as double) frequency, cast(c->>'lat' as double) lat, cast(c->>'num_antenna' as bigint) num_antenna from (select n_nationkey k, cast({js} as json) c from nation) q",
    )
    return out
