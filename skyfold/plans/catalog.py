"""Catalogues, tracks, file order and tables about the run."""

from __future__ import annotations

from skyfold.functions import expressions as X
from skyfold.plans.geometry import TRACKS

R = X.rounded
#: A cache that holds every third frame.
CACHE = "select * from catalog where frame%3=0"
#: The same with the site and elevation of each entry; frames 3 and 9 were fetched for another site or cut.
SITED = f"""select c.*, case when frame=3 then -3371e-2 else -202587508e-7 end lat, 577591989e-7 lon, case when frame=9 then 3e1 else 0e0 end elevation
from ({CACHE}) c"""
_point = "'['||cast(frame as string)||','||cast(cast(round(x*1e4) as bigint) as string)||','||cast(cast(round(y*1e4) as bigint) as string)||','||cast(cast(round(z*1e4) as bigint) as string)||']'"


def sql() -> dict[str, str | tuple[str, str]]:
    vec = X.unit_vector("ra_deg", "dec_deg")
    points = f"select name, frame, jy, {vec[0]} x, {vec[1]} y, {vec[2]} z, ra_deg, dec_deg from ({TRACKS}) q"
    track = f"select name, count(*) n, min(frame) first_frame, max(frame) last_frame, {R('avg(dec_deg)', 5)} mean_dec, {{}} points from (select name, frame, jy, ra_deg, dec_deg, cast(frame as string)||':'||cast(cast(round(ra_deg*1e3) as bigint) as string)||':'||cast(cast(round(jy*1e2) as bigint) as string) p from ({TRACKS}) t) u group by name"
    payload = f"select '{{{{\"name\":\"'||name||'\",\"points\":['||{{}}||']}}}}' payload from (select name, frame, jy, {_point} p from ({points}) t) u group by name".replace("{{{{", "{").replace("}}}}", "}")
    spark_list, duck_list = "array_join(transform(array_sort(collect_list(struct(frame,jy,p))),s->s.p),',')", "string_agg(p,',' order by frame,jy,p)"
    files = "select l_shipdate file, l_orderkey k, l_linenumber j from lineitem"
    return {
        "catalog_scan": "select frame, name, az, el, jy, r from catalog where el>=45e0",
        "catalog_unpad": "select frame, name, jy from (select frame, case when el<1e1 then '' else name end name, jy from catalog) q where name<>''",
        "catalog_cache_hit": f"select frame, name, az, el from ({SITED}) c where abs(lat-(-202587508e-7))<=1e-6 and abs(lon-577591989e-7)<=1e-6 and abs(elevation-0e0)<=1e-6 and name<>''",
        "catalog_cache_join": f"select f.frame, f.t, c.name, c.el from frames f left join ({CACHE}) c on c.frame=f.frame",
        "catalog_cache_miss": f"select f.frame, f.t from frames f left join (select distinct frame from ({CACHE}) k) c on c.frame=f.frame where c.frame is null",
        "catalog_merge": f"select frame, name, el, 'hit' origin from ({CACHE}) h union all select c.frame, c.name, c.el, 'fetched' origin from catalog c where c.frame%3<>0",
        "catalog_cache_write": "select frame, name, az, el, jy, r, -202587508e-7 lat, 577591989e-7 lon from catalog where el>=45e0",
        "catalog_width": "select max(n) width from (select frame, count(*) n from catalog group by frame) q",
        "satellite_tracks": (track.format(spark_list), track.format(duck_list)),
        "tracks_payload": (payload.replace("{}", spark_list), payload.replace("{}", duck_list)),
        "track_current": f"select f.frame, t.name, {R('t.ra_deg', 6)} ra_deg, {R('t.dec_deg', 6)} dec_deg from frames f join ({TRACKS}) t on t.frame=f.frame",
        "track_trails": f"select f.frame, t.name, t.frame at_frame, {R('t.ra_deg', 6)} ra_deg, {R('t.jy', 4)} jy from frames f join ({TRACKS}) t on t.frame<=f.frame",
        "region_align": "select o.frame, o.n from (select frame, count(*) n from vis group by frame) o left join frames f on f.frame=o.frame where f.frame is null or f.t>17179e5",
        "scan_order": f"select file, count(*) n, row_number() over (order by file)-1 pos from ({files}) q group by file",
        "scan_legacy_first_source": f"select frame, name, {R('el')} el, 'LL' pol from (select frame, name, el, row_number() over (partition by frame order by jy desc, name, r) k from catalog) q where k=1",
        "union_files": "select frame, a1, a2, 'first' part from vis where frame<8 union all select frame, a1, a2, 'second' part from vis where frame>=8",
        "profile_table": f"select stage, {R('total', 3)} total, {R('1e2*total/case when sum(total) over ()=0e0 then 1e0 else sum(total) over () end', 4)} percent, {R('total*1e3/n', 4)} ms_per_row from (select o_orderpriority stage, sum(o_totalprice)*1e0 total, count(*) n from orders group by o_orderpriority) q",
    }
