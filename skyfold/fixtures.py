"""Views over the driver's tables that stand for the inputs of a radio-array run; one SQL text for both engines."""

from __future__ import annotations

from pyspark.sql import SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings")

LAT, LON, ALT = "-20.2587508e0", "57.7591989e0", "20e0"
MICROS = {"spark": "unix_micros(cast(ts as timestamp))", "duckdb": "epoch_us(ts)"}

ANT = """select cast(n_nationkey as int) a, 'ant'||lpad(cast(n_nationkey as string),2,'0') name,
  17e-1*sqrt((n_nationkey+1)/24e0)*cos(n_nationkey*24e-1) e, 17e-1*sqrt((n_nationkey+1)/24e0)*sin(n_nationkey*24e-1) n, 0e0 u
from nation where n_nationkey<24"""
GAIN = "select a, case when a=15 then 0e0 else 1e0+((a%5)-2)*5e-2 end amp, (((a*7)%13)-6)*1e-1 ph from ant"
VIS = """select frame,a1,a2,avg(re) re,avg(im) im,cast(1e0 as double) w from (
  select cast(l_orderkey%16 as int) frame, cast(least(l_partkey%24,l_suppkey%24) as int) a1,
         cast(greatest(l_partkey%24,l_suppkey%24) as int) a2, l_discount-5e-2 re, l_tax-4e-2 im from lineitem) q
where a1<a2 group by frame,a1,a2"""
FRAMES = "select frame, 17179e5+frame*1e0+case when frame>=8 then 3e1 else 0e0 end t from (select distinct frame from vis) q"
CATALOG = """select cast(c_custkey%16 as int) frame, 'SAT-'||cast(c_custkey%40 as string) name,
  cast((c_custkey*37)%360 as double) az, cast((c_custkey*53)%90 as double) el, abs(c_acctbal) jy, 2e7+c_custkey r from customer"""


def pixels_sql(nside: int, source: str = "orders", key: str = "o_orderkey", engine: str = "duckdb") -> str:
    """Centres of the nested equal-area pixels (Gorski et al. 2005) for nside 2 or 4; ``source`` only supplies rows.

    Spark may ask whether a centre is null before it asks whether the key is small, so its numbers hold for any key."""
    o = nside.bit_length() - 1
    per = nside * nside
    ix = "+".join(f"((p >> {2 * b}) & 1)*{1 << b}" for b in range(o))
    iy = "+".join(f"((p >> {2 * b + 1}) & 1)*{1 << b}" for b in range(o))
    n = nside
    small = f"least({key}, {12 * per - 1})" if engine == "spark" else key
    return f"""select p pix, sqrt(1e0-z*z)*cos((jp-(ks+1)*5e-1)*(pi()/2e0/nullif(nr,0))) x, sqrt(1e0-z*z)*sin((jp-(ks+1)*5e-1)*(pi()/2e0/nullif(nr,0))) y, z from (
 select p,nr,ks,z, case when jp0>{4 * n} then jp0-{4 * n} when jp0<1 then jp0+{4 * n} else jp0 end jp from (
 select p,nr,ks,z, ((((jb*nr+ix-iy+1+ks)+{8 * n}) >> 1)-{4 * n}) jp0 from (
 select p,ix,iy,jb, case when jr<{n} then jr when jr>{3 * n} then {4 * n}-jr else {n} end nr,
   case when jr<{n} or jr>{3 * n} then 0 else ((jr-{n}) & 1) end ks,
   case when jr<{n} then 1e0-jr*jr/{3 * per}e0 when jr>{3 * n} then -1e0+({4 * n}-jr)*({4 * n}-jr)/{3 * per}e0 else ({2 * n}-jr)*2/{3 * n}e0 end z from (
 select p,ix,iy,jb,(2+(f >> 2))*{n}-ix-iy-1 jr from (
 select p, p >> {2 * o} f, {ix} ix, {iy} iy,
   case when (p >> {2 * o + 2})=1 then 2*((p >> {2 * o}) & 3) else 2*((p >> {2 * o}) & 3)+1 end jb
 from (select distinct cast({small} as int) p from {source} where {key}<{12 * per}) o) a) b) c) d) e"""


def views(engine: str) -> dict[str, str]:
    """Name to text, in the order in which they build on each other."""
    micros = MICROS[engine]
    maps = (
        "select cast(vec_id as int) frame, cast(pos as int) pix, cast(v as double) val from (select vec_id, posexplode(embedding) as (pos,v) from embeddings) q where pos<48"
        if engine == "spark"
        else "select cast(vec_id as int) frame, cast(i-1 as int) pix, cast(embedding[i] as double) val from embeddings cross join (select unnest(range(1,49)) i) r"
    )
    return {
        "ant": ANT, "gain": GAIN, "vis": VIS, "frames": FRAMES, "pix": pixels_sql(4, engine=engine), "pix2": pixels_sql(2, engine=engine),
        "lightcurve": f"select user_id pix, cast({micros} as double)/36e8 t, value y, event_id from events", "maps48": maps, "catalog": CATALOG,
    }


def with_views(sql: str, engine: str) -> str:
    """The query behind the views it uses, as one statement."""
    import re

    texts, used = views(engine), []

    def need(text: str) -> None:
        for name in texts:
            if name not in used and re.search(rf"\b(from|join)\s+{name}\b", text):
                need(texts[name])
                used.append(name)

    need(sql)
    head = "with recursive" if "with recursive" in sql.lower() else "with"
    parts = [f"{n} as ({texts[n]})" for n in used]
    body = re.sub(r"^\s*with (recursive )?", "", sql, count=1, flags=re.I) if re.match(r"\s*with ", sql, re.I) else None
    if body is not None:
        return f"{head} {', '.join([*parts, ''])}{body}" if parts else sql
    return f"{head} {', '.join(parts)}\n{sql}" if parts else sql


def register(spark: SparkSession, sf_dir: str) -> None:
    """The driver's tables as temporary views; their columns are pruned and filters pushed by Catalyst."""
    for name in TABLES:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
