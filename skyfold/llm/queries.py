"""The registered queries of the training-data operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyfold.llm.common import table


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import neighbours

    return neighbours.top_k(table(spark, sf_dir, "embeddings"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import warc

    pages = table(spark, sf_dir, "pages")
    folder, captures = warc.write_archives(pages)
    found = warc.read_captures(spark, folder, warc.build_index(captures, folder), warc.keys_of(pages))
    return found.selectExpr("page_id", "cast(octet_length(payload) as bigint) payload_bytes", "sha2(payload, 256) payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (select page_id, encode(coalesce(html, '')) body, sha256(coalesce(html, '')) digest from pages),
q as (select page_id, cast(octet_length(body) as bigint) n, digest, min(page_id) over (partition by digest) first from p)
select page_id, n payload_bytes, digest payload_digest,
       case when n >= 100 and first < page_id or n >= 100 and page_id is null and first is not null then 'revisit' else 'response' end record_type,
       case when n >= 100 and first < page_id or n >= 100 and page_id is null and first is not null then first end refers_to
from q
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import line_dedup

    clean = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"), count_columns=("n_lines", "n_removed"))
    return clean.select("doc_id", "n_lines", "n_removed", "text")


OP3_SQL = """
with l as (
  select doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 i, unnest(string_split(text, chr(10))) line from documents where text is not null
), t as (
  select doc_id, i, line, list_distinct(regexp_extract_all(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')) w from l
), f as (
  select row_number() over (order by doc_id, i) k, * from t where len(w) > 0
), c as (
  select min(k) k, s from (select k, list_sort(w) s from f) group by s
), n as (select k, len(s) n from c),
x as (select k, unnest(s) w from c),
o as (select w, row_number() over (order by count(*), w) r from x group by w),
q as (select x.k, n.n, o.r, row_number() over (partition by x.k order by o.r) p from x join o using (w) join n using (k)),
z as (select k, n, r from q where p <= n - (n * 80 + 99) // 100 + 1),
m as (select distinct a.k a, b.k b from z a join z b on a.r = b.r and b.k < a.k and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
j as (select distinct m.a k from m join c ca on ca.k = m.a join c cb on cb.k = m.b
      where 100 * len(list_intersect(ca.s, cb.s)) >= 80 * (len(ca.s) + len(cb.s) - len(list_intersect(ca.s, cb.s)))),
g as (select doc_id, i from f where k not in (select k from c) or k in (select k from j)),
r as (select l.doc_id, count(*) n_lines, count(g.i) n_removed, coalesce(string_agg(line, chr(10) order by l.i) filter (g.i is null), '') text
      from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id)
select doc_id, coalesce(n_lines, 0) n_lines, coalesce(n_removed, 0) n_removed, r.text from documents d left join r using (doc_id)
"""


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import licenses

    return licenses.digest(licenses.scan(table(spark, sf_dir, "documents")))


def _op4_sql() -> str:
    from skyfold.llm.licenses import PERCENT, PHRASES, TEMPLATES

    phrases = ", ".join(f"('{label}', string_split('{p}', ' '))" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', list_distinct(string_split('{t}', ' ')), {len(t.split())})" for label, t in TEMPLATES)
    return f"""
with phrases(label, p) as (values {phrases}), templates(label, t, n) as (values {templates}),
folded as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') s from documents),
w as (select doc_id, regexp_extract_all(s, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from folded),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) i from w where len(w) > 0),
base as (select doc_id, label, i - 1 word from places join phrases on w[i] = p[1] and w[i:i + len(p) - 1] = p),
near as (select doc_id, w, label, t, n from w cross join templates where 100 * len(list_intersect(t, list_distinct(w))) >= {PERCENT} * len(t)),
runs as (select doc_id, label, t, list_distinct(w[i:i + n - 1]) b from (select *, unnest(range(1, greatest(len(w) - n + 1, 1) + 1)) i from near) q),
held as (select doc_id, label, cast(len(list_intersect(t, b)) as double) / len(t) c, 100 * len(list_intersect(t, b)) >= {PERCENT} * len(t) ok from runs),
m as (select doc_id, label, c from held where ok),
b as (select doc_id, count(*) n, min(word) lo, max(word) hi, string_agg(distinct label, ',' order by label) labels from base group by doc_id),
x as (select doc_id, string_agg(distinct label, ',' order by label) labels from (select doc_id, label from base union all select doc_id, label from m) group by doc_id),
c as (select doc_id, max(c) c from m group by doc_id)
select w.doc_id, len(w.w) n_words, coalesce(b.n, 0) n_base, b.lo first_word, b.hi last_word, coalesce(b.labels, '') base_labels, coalesce(x.labels, '') labels,
       case when b.n > 0 then 1e0 else coalesce(c.c, 0e0) end score
from w left join b using (doc_id) left join x using (doc_id) left join c using (doc_id)
"""


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import substring_dedup

    return substring_dedup.passages(table(spark, sf_dir, "documents"))


def op6_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import near_dup

    return near_dup.components(table(spark, sf_dir, "documents"), k=4, percent=80)


OP6_SQL = """
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') w from documents
), s as (
  select distinct doc_id, case when len(w) < 4 then array_to_string(w, ' ') else array_to_string(w[i:i+3], ' ') end g
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) i from w where len(w) > 0)
), n as (select doc_id, count(*) n from s group by doc_id),
p as (
  select a.doc_id u, b.doc_id v, count(*) c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), e as (
  select u, v from p join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (select u, v from e union all select v, u from e),
reach as (
  select doc_id u, doc_id r from documents union select b.v, reach.r from reach join both_ways b on b.u = reach.u
), root as (select u, min(r) r from reach group by u)
select d.doc_id, coalesce(n.n, 0) n_shingles, r component_id, d.doc_id = r kept
from documents d left join n using (doc_id) join root on root.u = d.doc_id
"""


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import mixing

    planned = mixing.in_order(mixing.plan(table(spark, sf_dir, "documents")))
    return planned.selectExpr("doc_id", "size", "source_size", "target", "taken", "uses", "round(first_position, 9) first_position")


OP7_SQL = """
with docs as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) k,
         cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) size
  from documents
), sources as (
  select *, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 weight,
         row_number() over (order by source is null, encode(source)) - 1 r
  from (select source, cast(sum(size) as bigint) source_size from docs group by source)
), limits as (
  select *, cast(3 * source_size as double) / weight lim from sources
), levels as (
  select *, lim <= cast(cast(sum(source_size) over () as bigint) - coalesce(cast(sum(3 * source_size) over (order by lim, r rows between unbounded preceding and 1 preceding) as bigint), 0) as double)
                   / cast(sum(weight) over (order by lim, r rows between current row and unbounded following) as bigint) is_full
  from limits
), rest as (
  select cast(cast((select sum(source_size) from sources) as bigint) - coalesce(cast(sum(3 * source_size) filter (is_full) as bigint), 0) as double) words,
         cast(sum(weight) filter (not is_full) as bigint) weights from levels
), wanted as (
  select source, source_size, case when is_full then cast(3 * source_size as double) else weight * (words / weights) end target,
         case when r % 2 = 0 then 5e-1 else -5e-1 end slope
  from levels cross join rest
), placed as (
  select d.doc_id, d.size, w.source_size, w.target, w.slope, cast(floor(w.target + 5e-1) as bigint) goal,
         coalesce(cast(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding) as bigint), 0) b
  from docs d join wanted w on d.source is not distinct from w.source
), parts as (
  select *, case when source_size > 0 then goal // source_size else 0 end rounds from placed
), takes as (
  select *, greatest(0, least(size, goal - rounds * source_size - b)) part from parts
), used as (
  select *, case when size > 0 then rounds + cast(part > 0 as bigint) else 0 end uses, least(1e0, b / target) y from takes
)
select doc_id, size, source_size, target, cast(rounds * size + part as bigint) taken, cast(uses as bigint) uses,
       case when uses > 0 then round(2e0 * y / (1e0 + slope + sqrt(greatest(0e0, (1e0 + slope) * (1e0 + slope) - 4e0 * slope * y))), 9) end first_position
from used
"""


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import quality

    docs = table(spark, sf_dir, "documents")
    net = quality.train(docs, quality.learnable(table(spark, sf_dir, "labels")))
    scored = quality.score(docs, net)
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import media

    return media.digest(media.read_streams(media.write_streams(table(spark, sf_dir, "documents"))))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import packing

    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), packing.tokenizer_path()))


def op11_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import wrappers

    return wrappers.extract(table(spark, sf_dir, "pages"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import whitening

    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from skyfold.llm import conversations

    return conversations.repair(table(spark, sf_dir, "conversations"))


OP13_SQL = """
with recursive tab as (
  select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) order by i) t from (select unnest(range(256)) i)
), crc as (
  select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') text,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' '), ''), lambda x: cast(ascii(x) as bigint))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 kind
  from conversations cross join tab
), rows_ as (
  select conv_id, turn, case when kind = 4 then 'user' else role end role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end text
  from (select * from crc where kind <> 0 union all select * from crc where kind = 3)
), placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text)) i, left(role, 1) r from rows_
), faults as (
  select *, case when not regexp_matches(text, '[^\\x20\\x09-\\x0D]') then 'b'
                 when row_number() over (partition by conv_id, role, text order by i) > 1 then 'd'
                 when right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) not in ('.', '!', '?') then 't' else '' end f,
         lag(r) over (partition by conv_id order by i) || r pair
  from placed
), counts as (
  select conv_id, cast(coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as bigint) gaps, count(*) filter (f = 'b') blank,
         count(*) filter (f = 'd') duplicate, count(*) filter (f = 't') truncated, count(*) filter (pair not in ('su', 'ua', 'au')) illegal, count(*) total
  from faults group by conv_id
), walk as (
  select conv_id, cast(0 as bigint) i, {'c': 0, 'a': ''} n, {'c': 1000000000, 'a': ''} s, {'c': 1000000000, 'a': ''} u, {'c': 1000000000, 'a': ''} v from counts
  union all
  select w.conv_id, f.i, {'c': n.c + 3, 'a': n.a || 'D'},
    list_min([{'c': s.c + 3, 'a': s.a || 'D'}, {'c': case when x and r = 's' then n.c + y else 1000000000 end, 'a': n.a || 'K'}]),
    list_min([{'c': u.c + 3, 'a': u.a || 'D'}, {'c': n.c + ku, 'a': n.a || lu}, {'c': s.c + ku, 'a': s.a || lu}, {'c': u.c + 2 + ku, 'a': u.a || 'I' || lu}, {'c': v.c + ku, 'a': v.a || lu}]),
    list_min([{'c': v.c + 3, 'a': v.a || 'D'}, {'c': n.c + 2 + ka, 'a': n.a || 'I' || la}, {'c': s.c + 2 + ka, 'a': s.a || 'I' || la}, {'c': u.c + ka, 'a': u.a || la}, {'c': v.c + 2 + ka, 'a': v.a || 'I' || la}])
  from walk w join (
    select *, f in ('', 't') x, case when f = 't' then 1 else 0 end y,
           case when f in ('b', 'd') then 1000000000 else 0 end + case when f = 't' then 1 else 0 end + case when r = 'u' then 0 else 2 end ku, case when r = 'u' then 'K' else 'R' end lu,
           case when f in ('b', 'd') then 1000000000 else 0 end + case when f = 't' then 1 else 0 end + case when r = 'a' then 0 else 2 end ka, case when r = 'a' then 'K' else 'R' end la
    from faults) f on f.conv_id is not distinct from w.conv_id and f.i = w.i + 1
), best as (
  select w.conv_id, list_min([n, {'c': s.c + 4, 'a': s.a || 'II'}, {'c': u.c + 2, 'a': u.a || 'I'}, v]) b
  from walk w join counts c on c.conv_id is not distinct from w.conv_id and w.i = c.total
), letters as (
  select conv_id, generate_subscripts(string_split(b.a, ''), 1) p, unnest(string_split(b.a, '')) e from best where b.a <> ''
), steps as (
  select *, count(*) filter (e <> 'I') over (partition by conv_id order by p) i, count(*) filter (e <> 'D') over (partition by conv_id order by p) k from letters
), turns as (
  select s.*, f.role, f.text, max(case when s.e = 'K' and s.k = 1 and f.r = 's' then 1 else 0 end) over (partition by s.conv_id) lead
  from steps s left join faults f on f.conv_id is not distinct from s.conv_id and f.i = s.i and s.e <> 'I'
), repaired as (
  select conv_id, string_agg(case when e = 'K' then role when (k - lead) % 2 = 1 then 'user' else 'assistant' end || ':' || coalesce(text, ''), chr(10) order by p) t
  from turns where e <> 'D' group by conv_id
)
select o.conv_id, coalesce(gaps, 0) gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated, coalesce(illegal, 0) illegal,
       cast(coalesce(b.b.c, 0) as bigint) "cost", coalesce(b.b.a, '') audit, sha256(coalesce(r.t, '')) repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join best b on b.conv_id is not distinct from o.conv_id
left join repaired r on r.conv_id is not distinct from o.conv_id
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_warc": op2_warc,
    "op3_line_dedup": op3_line_dedup,
    "op4_licenses": op4_licenses,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_near_dup": op6_near_dup,
    "op7_mixing": op7_mixing,
    "op8_quality": op8_quality,
    "op9_media": op9_media,
    "op10_packing": op10_packing,
    "op11_extract": op11_extract,
    "op12_whitening": op12_whitening,
    "op13_repair": op13_repair,
}

SQL: dict[str, str] = {
    "op2_warc": OP2_SQL,
    "op3_line_dedup": OP3_SQL,
    "op4_licenses": _op4_sql(),
    "op6_near_dup": OP6_SQL,
    "op7_mixing": OP7_SQL,
    "op13_repair": OP13_SQL,
}
