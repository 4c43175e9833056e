"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

EXACT_DEDUP = f"""
with n as (
  select doc_id, length(coalesce(text, '')) as points, translate(coalesce(text, ''), {_BLANKS}, '') as norm from documents
), w as (
  select doc_id, norm, count(*) over (partition by norm) as group_size,
         first_value(doc_id) over (partition by norm order by points desc, doc_id nulls last) as keep_id
  from n
)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id as kept, sha256(norm) as text_sha256 from w
"""

LINE_DEDUP = f"""
with s as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos from s),
k as (
  select doc_id, line, pos, translate(trim(line, {_BLANKS}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from l
),
f as (select key, min(doc_id) as first_id from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
j as (select k.doc_id, k.line, k.pos, f.key is not null and k.doc_id <> f.first_id as gone from k left join f using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from j group by doc_id
"""

#: Weights 5, 2, 1 in turn, share 1.5, cap 2.
MIX_SOURCES = r"""
with d as (
  select doc_id, source, coalesce(text, '') as t from documents
), z as (
  select doc_id, source, length(regexp_replace(regexp_replace(t, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]', '', 'g')) as size,
         1 - (length(t) - length(regexp_replace(t, '[^\p{L}\p{N}\x20\x09-\x0D]', '', 'g'))) / greatest(length(t), 1) as share,
         (('0x' || substr(md5('mix|' || coalesce(doc_id, -1)::varchar), 1, 12))::bigint::double + 0.5) / 281474976710656.0::double as u
  from d
), k as (
  select doc_id, source, size, -ln(u) / round(0.1::double + 0.9::double * share * share, 6) as key from z
), s as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as turn from k group by source
), c as (
  select *, case turn % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight, source_size * 2.0::double as cap from s
), l as (
  select *, (sum(source_size) over () * 1.5::double
             - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from c
), f as (
  select source, source_size, coalesce(least(weight * (select arg_min(level, cap / weight) from l where level < cap / weight), cap), cap) as target from l
), e as (
  select *, case when source_size > 0 then floor(target / source_size)::bigint else 0 end as epochs from f
), g as (
  select k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::bigint as open,
         coalesce(sum(k.size) over (partition by k.source order by k.key, k.doc_id nulls last, k.size rows between unbounded preceding and 1 preceding), 0) as start
  from k join e on k.source is not distinct from e.source
)
select doc_id, size, source_size, target, (size * epochs + greatest(least(size, open - start), 0))::bigint as taken from g
"""

MAXSCORE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256.0::double * x::double)::bigint) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0
), r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""

NEAR_DEDUP = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), g as (
  select distinct doc_id, unnest(case when len(w) = 0 then []::varchar[] when len(w) < 5 then [array_to_string(w, ' ')]
    else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as shingle
  from w
), n as (
  select doc_id, count(*) as n from g group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 75 * (x.n + y.n - shared)
), e as (
  select a as u, b as v from l union all select b, a from l
), r(it, id, low) as (
  select 0, doc_id, doc_id from documents
  union all
  select it + 1, id, min(low) from (
    select it, id, low from r where it < 30 union all select r.it, e.v, r.low from r join e on e.u = r.id where r.it < 30) x group by it, id
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, r.low as component_id, d.doc_id = r.low as kept
from documents d left join n on n.doc_id = d.doc_id join r on r.id = d.doc_id and r.it = 30
"""

#: crc_bits(t): the 256 steps of CRC-32; ``_crc`` applies them to the hexadecimal digits of a value's bytes.
_CRC_TABLE = """crc_bits as (
  select list(v order by i) as t from (
    select i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, _: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v
    from (select unnest(range(256)) as i) r) z)"""


def _crc(digits: str) -> str:
    """CRC-32 of bytes given as hexadecimal digits, beside ``crc_bits``."""
    each = f"list_transform(range(length({digits}) // 2), lambda i: ('0x' || substr({digits}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {each}), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"


#: 10,000 buckets, single words, 10 % of the documents of 20 words or more, seed 2024.
RESAMPLING = f"""
with {_CRC_TABLE},
low as (
  select 0 as part, doc_id, row_number() over () as row, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents
  union all
  select 1, null, row_number() over (), translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark
),
split as (select part, doc_id, row, list_filter(string_split_regex(text, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words from low),
each as (select part, doc_id, row, unnest(words) as word from split),
coded as (select word, {_crc("digits")} % 10000 as bucket from (select word, hex(encode(word)) as digits from each group by word) w, crc_bits),
hits as (select part, doc_id, row, bucket from each join coded using (word)),
counts as (select bucket, count(*) filter (part = 0) as s, count(*) filter (part = 1) as t from hits group by bucket),
totals as (select sum(s)::double + 10000 as s_all, sum(t)::double + 10000 as t_all from counts),
gains as (select bucket, floor(1000 * ln(((t + 1)::double * s_all) / ((s + 1)::double * t_all)))::bigint as gain from counts, totals),
sums as (select row, count(*) as n, sum(gain)::bigint as gain from hits join gains using (bucket) where part = 0 group by row),
scored as (
  select doc_id, len(words) as n_words, coalesce(n, 0)::bigint as n_features,
         case when n > 0 then (gain - ((gain % n) + n) % n) // n else 0 end::bigint as weight,
         floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint::double + 0.5) / 4294967296.0::double)))::bigint as g
  from split left join sums using (row) where part = 0
),
ranked as (
  select *, row_number() over (partition by n_words >= 20 order by weight + g desc, doc_id nulls last, weight desc, n_features desc) as place,
         count(*) filter (n_words >= 20) over () as n_fit
  from scored
)
select doc_id, n_features, weight, (weight + g)::bigint as score, case when n_words >= 20 and place <= n_fit * 10 // 100 then place end as rank from ranked
"""


def _field(value: str) -> str:
    return f"coalesce(strlen({value}::varchar)::varchar || ':' || {value}::varchar, '-')"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(map(_field, ["doc_id", "source", "lang", "n_chars", text])) + ")"


def _levels(name: str, start: str) -> str:
    """name(lvl, tree, nth, digest, n): all levels above the nodes of ``start``, runs of 3 hashed into one while a tree has several."""
    return f"""{name}(lvl, tree, nth, digest, n) as (
  select 0, tree, nth, digest, count(*) over (partition by tree) from {start}
  union all
  select lvl, tree, nth, digest, count(*) over (partition by tree) from (
    select lvl + 1 as lvl, tree, nth // 3 as nth, sha256(string_agg(digest, '' order by nth)) as digest from {name} where n > 1 group by lvl, tree, nth // 3) x)"""


def _siblings(name: str) -> str:
    """One row for each node with siblings' texts to its left and right."""
    return f"""(select a.lvl, a.tree, a.nth, coalesce(string_agg(b.digest, '' order by b.nth) filter (b.nth < a.nth), '') as lft,
    coalesce(string_agg(b.digest, '' order by b.nth) filter (b.nth > a.nth), '') as rgt
  from {name} a join {name} b on a.lvl = b.lvl and a.tree = b.tree and a.nth // 3 = b.nth // 3 where a.n > 1 group by a.lvl, a.tree, a.nth)"""


MERKLE = f"""
with recursive {_CRC_TABLE},
docs as (
  select doc_id, coalesce('s' || source, '') as tree, {_leaf("text")} as leaf,
         case when {_crc("hex(encode(doc_id::varchar))")} % 2 = 0 and text is not null then {_leaf("replace(text, chr(10), '')")} end as tampered
  from documents, crc_bits
),
placed as (select *, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as nth from docs),
base as (select tree, nth, leaf as digest from placed),
{_levels("low", "base")},
subroots as (select tree as source, digest, row_number() over (order by encode(tree)) - 1 as nth from low where n = 1),
top_base as (select 'top' as tree, nth, digest from subroots),
{_levels("high", "top_base")},
low_sib as {_siblings("low")},
high_sib as {_siblings("high")},
high_height as (select max(lvl) as h from high),
heights as (select tree, max(lvl) as h from low group by tree),
walk(step, doc_id, tree, place, nth, digest, proof, h, top) as (
  select 0, doc_id, p.tree, p.nth, p.nth, coalesce(tampered, leaf), '', h, s.nth from placed p join heights using (tree) join subroots s on s.source = p.tree
  union all
  select step + 1, doc_id, w.tree, place, (case when step + 1 = h then top else w.nth // 3 end),
         sha256(coalesce(a.lft, b.lft) || w.digest || coalesce(a.rgt, b.rgt)), proof || coalesce(a.lft || a.rgt, b.lft || b.rgt), h, top
  from walk w left join low_sib a on step < h and a.lvl = step and a.tree = w.tree and a.nth = w.nth
  left join high_sib b on step >= h and b.lvl = step - h and b.nth = (case when h = 0 and step = 0 then top else w.nth end)
  where step < h + (select h from high_height)
)
select p.doc_id, p.leaf, s.digest as subroot, r.digest as root, sha256(w.proof) as proof_sha256, w.digest as folded_root, w.digest = r.digest as verified
from placed p join subroots s on s.source = p.tree join high r on r.n = 1
join walk w on w.tree = p.tree and w.place = p.nth and w.step = w.h + (select h from high_height)
"""

ORACLES: dict[str, str] = {
    "op3_exact_dedup": EXACT_DEDUP,
    "op4_near_dedup": NEAR_DEDUP,
    "op7_maxscore": MAXSCORE,
    "op9_line_dedup": LINE_DEDUP,
    "op10_mix_sources": MIX_SOURCES,
    "op11_importance_resampling": RESAMPLING,
    "op13_merkle": MERKLE,
}
