"""DuckDB SQL for the graph queries that SQL can express."""

from __future__ import annotations

CLICK = """e as (
  select distinct least(user_id, nx) as src, greatest(user_id, nx) as dst
  from (select user_id, lead(user_id) over (order by event_id) as nx from events where event_type = 'click') t
  where nx is not null and nx <> user_id)"""
FOLLOW = CLICK.replace(" where event_type = 'click'", "")
PARTS = """e as (
  select distinct a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
  where a.l_partkey < b.l_partkey)"""
PART2X = """e as (
  select a.l_partkey as src, b.l_partkey as dst from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey
  where a.l_partkey < b.l_partkey group by 1, 2 having count(distinct a.l_orderkey) >= 2)"""
ADJ = "adj as (select src as u, dst as v from e union all select dst, src from e)"
VERT = "vert as (select distinct u as id from adj)"
DEG = "deg as (select u as id, count(*) as degree from adj group by u)"
TRI = "tri as (select a.src as v0, a.dst as v1, b.dst as v2 from e a join e b on a.dst = b.src join e c on c.src = a.src and c.dst = b.dst)"
FOUR = """four as (
  select t.v0, t.v1, t.v2, c.dst as v3 from tri t join e a on a.src = t.v0 join e b on b.src = t.v1 and b.dst = a.dst
  join e c on c.src = t.v2 and c.dst = a.dst)"""
CO = """co as (
  select e.src, e.dst, count(t.v0) as codegree from e left join (
    select v0, v1 from tri union all select v0, v2 from tri union all select v1, v2 from tri) t on t.v0 = e.src and t.v1 = e.dst
  group by 1, 2)"""


def _with(*parts: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ", ".join(parts) + " "


def _instances(k: int) -> str:
    """inc(cid, id): vertex and instance pairs of the edges or triangles."""
    if k == 2:
        return "base as (select src as v0, dst as v1 from e), num as (select row_number() over (order by v0, v1) as cid, * from base), inc as (select cid, unnest([v0, v1]) as id from num)"
    return TRI + ", num as (select row_number() over (order by v0, v1, v2) as cid, * from tri), inc as (select cid, unnest([v0, v1, v2]) as id from num)"


def _cores(rounds: int) -> str:
    """core(id, core) by a fixed number of H-index rounds over inc."""
    return f"""h(it, id, c) as (
  select 0, id, count(*)::bigint from inc group by id
  union all
  select it + 1, id, max(least(w, r))::bigint from (
    select it, id, w, row_number() over (partition by id order by w desc) as r from (
      select h.it, i.id, min(h.c) over (partition by h.it, i.cid) as w from inc i join h on h.id = i.id where h.it < {rounds}) x) y
  group by it, id),
core as (select id, c as core from h where it = {rounds})"""


#: lev(level, n_vertices, n_instances) from inc and core.
_LEVELS = """left_at as (select cid, min(core) as level from inc join core using (id) group by cid),
lev as (select c.level, (select count(*) from core x where x.core >= c.level) as n_vertices,
  (select count(*) from left_at y where y.level >= c.level) as n_instances from (select distinct core as level from core) c)"""


_BEST = "select level, n_vertices, n_instances from lev order by n_instances / n_vertices desc, level limit 1"
_COMPONENTS = """reach(it, id, low) as (
  select 0, id, id from vert union all
  select it + 1, id, min(low) from (
    select it, id, low from reach where it < 40
    union all select r.it, a.v, r.low from reach r join adj a on a.u = r.id where r.it < 40) x group by it, id),
comp as (select id, low as component from reach where it = 40)"""
_TRI_EDGES = "te as (select v0 as src, v1 as dst from tri union select v0, v2 from tri union select v1, v2 from tri)"


def _loads(rounds: int) -> str:
    """l(it, id, load): in each round every instance of inc gives one unit to its least loaded member."""
    return f"""l(it, id, load) as (
  select 0, id, 0::bigint from inc group by id
  union all
  select it + 1, id, max(load) + count(*) filter (r = 1) from (
    select l.it, i.id, l.load, row_number() over (partition by l.it, i.cid order by l.load, i.id) as r
    from inc i join l on l.id = i.id where l.it < {rounds}) x
  group by it, id)"""


def _densest(rounds: int) -> str:
    """The densest prefix of vertices by load, the longest of equals. With enough rounds it is the maximal densest set."""
    return _loads(rounds) + f""",
ranked as (select id, row_number() over (order by load desc, id) as place from l where it = {rounds}),
ends as (select max(place) as place from inc join ranked using (id) group by cid),
pre as (select r.place as s, count(e.place) as t from ranked r left join ends e on e.place <= r.place group by r.place),
best as (select s, t from pre order by t / s desc, s desc limit 1)
select id, t as numer, s as denom, true as exact, 0.0::double as gap from ranked, best where place <= s"""


#: trace: removing the vertex of smallest (residual degree, id) again and again.
_TRACE = """start as (select 0 as it, cid::bigint as cid, id from inc union all select distinct 0, null::bigint, id from inc),
s(it, cid, id) as (
  select it, cid, id from start
  union all
  select it + 1, cid, id from (
    select it, cid, id, v, max(id = v) over (partition by cid) as hit from (
      select it, cid, id, first_value(id) over (order by d, id) as v from (select it, cid, id, count(cid) over (partition by id) as d from s) a) b) c
  where id <> v and (cid is null or not hit)),
deg as (select it, id, count(cid) as d from s group by it, id),
low as (select it, arg_min(id, (d, id)) as id, min(d) as residual_degree, count(*) - 1 as remaining_vertices from deg group by it),
held as (select it, count(distinct cid) as t from s group by it),
trace as (
  select l.it + 1 as step, l.id, residual_degree, max(residual_degree) over (order by l.it) as core, remaining_vertices,
         coalesce(h.t, 0) as remaining_instances
  from low l left join held h on h.it = l.it + 1)"""


def _choose(n: str, k: int) -> str:
    out = "1"
    for i in range(k):
        out = f"({out} * ({n} - {i})) // {i + 1}"
    return f"(case when {n} < {k} then 0 else {out} end)"


_STAR3 = _choose("degree", 3)
_BOUND_COLUMNS = """round(t / n, 6) as lower_density, round(k_max / 3, 6) as lower_core, round(k_max::double, 6) as upper_core,
  round(pow(t::double, 2.0::double / 3) / pow(6.0::double, 1.0::double / 3), 6) as upper_cliques, round(squares / (9 * t), 6) as spread,
  round(n::double * (n - 1) / 2 * (n - 2) / 3 / n, 6) as upper_choose, round(1.0::double / (n * greatest(n - 1, 1)), 6) as gap"""
_TAILED = "select coalesce(sum(d0.degree + d1.degree + d2.degree - 6), 0)::bigint as n_instances from tri join deg d0 on d0.id = v0 join deg d1 on d1.id = v1 join deg d2 on d2.id = v2"
_TAILED_DEGREES = """corner as (
  select unnest([v0, v1, v2]) as id, d0.degree + d1.degree + d2.degree - 6 as n
  from tri join deg d0 on d0.id = v0 join deg d1 on d1.id = v1 join deg d2 on d2.id = v2),
held as (select id, count(*) as n from corner group by id),
tailed as (
  select id, sum(n)::bigint as pattern_degree from (
    select id, n from corner union all select a.v, h.n from adj a join held h on h.id = a.u
    union all select src, -codegree from co union all select dst, -codegree from co) x group by id having sum(n) > 0)"""
_BASKET_DEGREES = """q as (select row_number() over (order by v0, v1, v2, v3) as q, * from four),
six as (
  select q, v0 as src, v1 as dst from q union all select q, v0, v2 from q union all select q, v0, v3 from q
  union all select q, v1, v2 from q union all select q, v1, v3 from q union all select q, v2, v3 from q),
inside as (select q, sum(codegree - 2) as n from six join co using (src, dst) group by q),
ek as (select src, dst, count(*) as n from six group by 1, 2),
tk as (
  select a, b, c, count(*) as n from (
    select v0 as a, v1 as b, v2 as c from four union all select v0, v1, v3 from four
    union all select v0, v2, v3 from four union all select v1, v2, v3 from four) x group by 1, 2, 3),
over_edge as (
  select v2 as id, n from tri join ek on src = v0 and dst = v1 union all select v1, n from tri join ek on src = v0 and dst = v2
  union all select v0, n from tri join ek on src = v1 and dst = v2),
basket as (
  select id, sum(n)::bigint as pattern_degree from (
    select unnest([v0, v1, v2, v3]) as id, n from q join inside using (q) union all select id, n from over_edge
    union all select unnest([a, b, c]), -n from tk) x group by id having sum(n) > 0)"""
_WEDGE = "wedge as (select a.v as x, b.v as y, count(*) as n from adj a join adj b on a.u = b.u where a.v < b.v group by 1, 2)"
_CYCLES = """cyc as (
  select a.u as x, a.v as p, c.v as y, b.v as q from adj a join adj b on a.u = b.u and a.v < b.v
  join adj c on c.u = a.v join adj d on d.u = b.v and d.v = c.v where c.v > a.u and a.v > a.u and b.v > a.u)"""
_SIDE = "side as (select v0 as a, v1 as b, v2 as x from tri union all select v0, v2, v1 from tri union all select v1, v2, v0 from tri)"
_INC_CYCLES = _CYCLES + ", num as (select row_number() over (order by x, p, y, q) as cid, * from cyc), inc as (select cid, unnest([x, p, y, q]) as id from num)"
_INC_STAR = (
    "num as (select row_number() over (order by a.u, a.v, b.v) as cid, a.u, a.v as x, b.v as y from adj a join adj b on a.u = b.u and a.v < b.v),"
    " inc as (select cid, unnest([u, x, y]) as id from num)"
)
_INC_TWO = (
    TRI + ", " + _SIDE + ", num as (select row_number() over (order by s.a, s.b, s.x, t.x) as cid, s.a, s.b, s.x as c, t.x as d"
    " from side s join side t on s.a = t.a and s.b = t.b and s.x < t.x), inc as (select cid, unnest([a, b, c, d]) as id from num)"
)

ORACLES: dict[str, str] = {
    "graph_click_edges": _with(CLICK) + "select src, dst from e",
    "graph_follow_edges": _with(FOLLOW) + "select src, dst from e",
    "graph_parts_edges": _with(PARTS) + "select src, dst from e",
    "graph_part2x_edges": _with(PART2X) + "select src, dst from e",
    "source_vertex_ids": _with(PARTS, ADJ, VERT) + "select id from vert",
    "source_dense_ids": _with(PART2X, ADJ, VERT) + "select id, row_number() over (order by id) - 1 as dense_id from vert",
    "source_dense_edges": _with(PART2X, ADJ, VERT, "d as (select id, row_number() over (order by id) - 1 as n from vert)")
    + "select a.n as src, b.n as dst from e join d a on a.id = src join d b on b.id = dst",
    "source_adjacency_lines": _with(CLICK, ADJ) + "select u as id, u || ' ' || string_agg(v::varchar, ' ' order by v) as value from adj group by u",
    "file_adjacency_edges": _with(CLICK) + "select src, dst from e",
    "file_adjacency_vertices": _with(CLICK) + "select unnest(range((select max(dst) + 1 from e))) as id",
    "file_adjacency_edges_parts": _with(PARTS) + "select src, dst from e",
    "file_adjacency_vertices_parts": _with(PARTS) + "select unnest(range((select max(dst) + 1 from e))) as id",
    "file_edge_list": _with(PART2X) + "select src, dst from e",
    "file_matrix_edges": "select a.n_nationkey::bigint as src, b.n_nationkey::bigint as dst from nation a join nation b"
    " on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "file_pattern_count": _with(CLICK, ADJ, _CYCLES) + "select count(*) as n_instances from cyc",
    "graph_counts": _with(PARTS, ADJ, DEG)
    + "select count(*) as n_vertices, (sum(degree) // 2)::bigint as n_edges, max(degree) as max_degree from deg",
    "degrees": _with(PARTS, ADJ, DEG) + "select id, degree from deg",
    "codegrees": _with(PARTS, TRI, CO) + "select src, dst, codegree from co",
    "binomials": _with(CLICK, ADJ, DEG)
    + "select id, degree * (degree - 1) // 2 as pairs, degree * (degree - 1) * (degree - 2) // 6 as triples from deg",
    "oriented_edges": _with(CLICK, ADJ, DEG)
    + """select case when (a.degree, src) < (b.degree, dst) then src else dst end as u, case when (a.degree, src) < (b.degree, dst) then dst else src end as v
  from e join deg a on a.id = src join deg b on b.id = dst""",
    "induced_edges": _with(CLICK, ADJ, DEG, "top as (select id from deg where degree >= (select avg(degree) from deg))")
    + "select src, dst from e where src in (select id from top) and dst in (select id from top)",
    "ego_edges": _with(CLICK, ADJ, VERT, "ego as (select min(id) as id from vert union select v from adj where u = (select min(id) from vert))")
    + "select src, dst from e where src in (select id from ego) and dst in (select id from ego)",
    "two_step_ball": _with(PARTS, ADJ, VERT, "one as (select min(id) as id from vert union select v from adj where u = (select min(id) from vert))")
    + "select id from one union select v from adj where u in (select id from one)",
    "set_neighbourhood": _with(CLICK, ADJ, VERT) + "select id from vert where id % 10 = 0 union select v from adj where u % 10 = 0",
    "pattern_ball": _with(PART2X, ADJ, VERT, "one as (select min(id) as id from vert union select v from adj where u = (select min(id) from vert))")
    + "select id from one union select v from adj where u in (select id from one)",
    "core_numbers": _with(CLICK, _instances(2), _cores(80), recursive=True) + "select id, core from core",
    "core_order": _with(CLICK, _instances(2), _cores(80), recursive=True)
    + "select id, core, row_number() over (order by core desc, id) - 1 as place from core",
    "core_histogram": _with(CLICK, _instances(2), _cores(80), recursive=True) + "select (core // 5)::bigint as bucket, count(*) as n_vertices from core group by 1",
    "fixed_core_16": _with(CLICK, _instances(2), _cores(80), recursive=True) + "select id from core where core >= 16",
    "edge_levels": _with(CLICK, _instances(2), _cores(80), recursive=True)
    + "select src, dst, least(a.core, b.core) as level from e join core a on a.id = src join core b on b.id = dst",
    "triangles": _with(PARTS, TRI) + "select v0, v1, v2 from tri",
    "four_cliques": _with(CLICK, TRI, FOUR) + "select v0, v1, v2, v3 from four",
    "five_clique_count": _with(CLICK, TRI, FOUR)
    + """select count(*) as n_cliques from four f join e a on a.src = f.v0 join e b on b.src = f.v1 and b.dst = a.dst
  join e c on c.src = f.v2 and c.dst = a.dst join e d on d.src = f.v3 and d.dst = a.dst""",
    "triangle_count": _with(PARTS, TRI) + "select count(*) as n_cliques from tri",
    "follow_triangle_count": _with(FOLLOW, TRI) + "select count(*) as n_cliques from tri",
    "follow_core_numbers": _with(FOLLOW, _instances(2), _cores(80), recursive=True) + "select id, core from core",
    "four_clique_count": _with(CLICK, TRI, FOUR) + "select count(*) as n_cliques from four",
    "triangle_degrees": _with(PARTS, TRI) + "select id, count(*) as clique_degree from (select unnest([v0, v1, v2]) as id from tri) group by id",
    "four_clique_degrees": _with(CLICK, TRI, FOUR) + "select id, count(*) as clique_degree from (select unnest([v0, v1, v2, v3]) as id from four) group by id",
    "triangles_touching": _with(CLICK, TRI) + "select v0, v1, v2 from tri where v0 % 10 = 0 or v1 % 10 = 0 or v2 % 10 = 0",
    "triangles_touching_parts": _with(PARTS, TRI) + "select v0, v1, v2 from tri where v0 % 10 = 0 or v1 % 10 = 0 or v2 % 10 = 0",
    "triangles_containing_parts": _with(PARTS, TRI) + "select v0, v1, v2 from tri where v0 = (select min(src) from e)",
    "triangles_inside": _with(CLICK, TRI) + "select v0, v1, v2 from tri where v0 % 2 = 0 and v1 % 2 = 0 and v2 % 2 = 0",
    "triangles_containing": _with(CLICK, TRI) + "select v0, v1, v2 from tri where v0 = (select min(src) from e)",
    "covered_edges": _with(PARTS, TRI, _TRI_EDGES) + "select src, dst from te",
    "triangle_degree_drop": _with(CLICK, TRI)
    + "select id, count(*) as pattern_degree from (select unnest([v0, v1, v2]) as id from tri where v0 = (select min(src) from e)) group by id",
    "pattern_tailed_triangle": _with(CLICK, ADJ, DEG, TRI) + _TAILED,
    "pattern_tailed_triangle_degrees": _with(CLICK, ADJ, DEG, TRI, CO, _TAILED_DEGREES) + "select id, pattern_degree from tailed",
    "pattern_tailed_triangle_at_smallest": _with(CLICK, ADJ, DEG, TRI, CO, _TAILED_DEGREES)
    + "select coalesce(sum(pattern_degree), 0)::bigint as n_instances from tailed where id = (select min(src) from e)",
    "pattern_basket_degrees": _with(CLICK, TRI, CO, FOUR, _BASKET_DEGREES) + "select id, pattern_degree from basket",
    "pattern_three_triangle_degrees": _with(CLICK, TRI, CO, _SIDE)
    + f"select id, sum(n)::bigint as pattern_degree from (select src as id, {_choose('codegree', 3)} as n from co union all select dst, {_choose('codegree', 3)} from co"
    + f" union all select x, {_choose('(codegree - 1)', 2)} from side join co on src = a and dst = b) y group by id having sum(n) > 0",
    "pattern_two_triangle": _with(CLICK, TRI, CO) + f"select coalesce(sum({_choose('codegree', 2)}), 0)::bigint as n_instances from co",
    "pattern_three_triangle": _with(CLICK, TRI, CO) + f"select coalesce(sum({_choose('codegree', 3)}), 0)::bigint as n_instances from co",
    "pattern_two_triangle_degrees": _with(CLICK, TRI, _SIDE)
    + """select id, count(*) as pattern_degree from (
  select unnest([s.a, s.b, s.x, t.x]) as id from side s join side t on s.a = t.a and s.b = t.b and s.x < t.x) group by id""",
    "pattern_basket": _with(CLICK, TRI, CO, FOUR)
    + """select coalesce(sum(codegree - 2), 0)::bigint as n_instances from (
  select unnest([[v0, v1], [v0, v2], [v0, v3], [v1, v2], [v1, v3], [v2, v3]]) as p from four) f join co on co.src = p[1] and co.dst = p[2]""",
    "pattern_star3_degrees": _with(PARTS, ADJ, DEG)
    + f"""select id, sum(n)::bigint as pattern_degree from (select id, {_STAR3} as n from deg
  union all select v, (degree - 1) * (degree - 2) // 2 from adj join deg on deg.id = u) group by id""",
    "pattern_star3": _with(PARTS, ADJ, DEG) + f"select sum({_STAR3})::bigint as n_instances from deg",
    "pattern_four_cycle": _with(CLICK, ADJ, _CYCLES) + "select count(*) as n_instances from cyc",
    "pattern_four_cycle_degrees": _with(CLICK, ADJ, _CYCLES) + "select id, count(*) as pattern_degree from (select unnest([x, p, y, q]) as id from cyc) group by id",
    "pattern_generic_tailed_triangle": _with(PART2X, ADJ, DEG, TRI) + _TAILED,
    "pattern_generic_four_cycle": _with(PART2X, ADJ, _WEDGE) + "select coalesce(sum(n * (n - 1) // 2), 0)::bigint // 2 as n_instances from wedge",
    "pattern_generic_tailed_triangle_parts": _with(PARTS, ADJ, DEG, TRI) + _TAILED,
    "pattern_generic_two_triangle_sets": _with(PART2X, TRI, _SIDE)
    + """select m[1] as v0, m[2] as v1, m[3] as v2, m[4] as v3, count(*) as mult from (
  select list_sort([s.a, s.b, s.x, t.x]) as m from side s join side t on s.a = t.a and s.b = t.b and s.x < t.x) group by m""",
    "triangle_core_numbers": _with(CLICK, _instances(3), _cores(60), recursive=True) + "select id, core from core",
    "triangle_core_batch": _with(CLICK, _instances(3), _cores(60), recursive=True) + "select id, core from core",
    "pattern_four_cycle_core_click": _with(CLICK, ADJ, _INC_CYCLES, _cores(60), recursive=True) + "select id, core from core",
    "pattern_star2_core": _with(PART2X, ADJ, _INC_STAR, _cores(60), recursive=True) + "select id, core from core",
    "pattern_star2_peel": _with(PART2X, ADJ, _INC_STAR, _cores(60), _LEVELS, recursive=True) + _BEST,
    "edge_level_table": _with(CLICK, _instances(2), _cores(80), _LEVELS, recursive=True) + "select level, n_vertices, n_instances from lev",
    "triangle_level_table": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True) + "select level, n_vertices, n_instances from lev",
    "peel_best_core_edges": _with(CLICK, _instances(2), _cores(80), _LEVELS, recursive=True) + _BEST,
    "peel_best_core_triangles": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True) + _BEST,
    "max_core_triangles": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True)
    + "select level as k_max, n_vertices, n_instances from lev order by level desc limit 1",
    "densest_triangles_peel": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True)
    + f", best as ({_BEST}) select id, n_instances as numer, n_vertices as denom, false as exact, null::double as gap from core, best where core >= level",
    "densest_triangles_max_core": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True)
    + ", best as (select * from lev order by level desc limit 1) select id, n_instances as numer, n_vertices as denom, false as exact, null::double as gap from core, best where core = level",
    "max_core_top_down": _with(CLICK, _instances(3), _cores(60), recursive=True) + "select id, core from core where core = (select max(core) from core)",
    "core_estimates": _with(CLICK, _instances(2), _cores(80), recursive=True) + "select id, core * (core - 1) // 2 as bound from core",
    "densest_core_edges": _with(CLICK, _instances(3), _cores(60), _LEVELS, recursive=True)
    + f""", best as ({_BEST}), kept as (select * from tri where
  (select min(core) from core where id in (v0, v1, v2)) >= (select (n_instances + n_vertices - 1) // n_vertices from best)), te as (
  select v0 as src, v1 as dst from kept union select v0, v2 from kept union select v1, v2 from kept) select src, dst from te""",
    "components": _with(PART2X, ADJ, VERT, _COMPONENTS, recursive=True) + "select id, component from comp",
    "triangle_components": _with(
        PART2X, TRI, _TRI_EDGES, "adj as (select src as u, dst as v from te union all select dst, src from te)", VERT, _COMPONENTS, recursive=True
    )
    + "select id, component from comp",
    "component_densities": _with(PART2X, ADJ, VERT, _COMPONENTS, recursive=True)
    + """select component, count(distinct id) as n_vertices, count(*) // 2 as n_instances from comp join adj on adj.u = comp.id group by component""",
    "bounds": _with(
        CLICK, _instances(3), _cores(60), _TRI_EDGES, "adj as (select src as u, dst as v from te union all select dst, src from te)", VERT, _COMPONENTS, recursive=True
    )
    + f""", d as (select id, count(*) as d from inc group by id),
s as (select component, count(*) as n, max(core) as k_max, sum(d::double * d) as squares, (sum(d) // 3)::bigint as t from comp join d using (id) join core using (id) group by component)
select component, n as n_vertices, t as n_instances, k_max, {_BOUND_COLUMNS} from s""",
    "pattern_four_cycle_core": _with(PART2X, ADJ, _INC_CYCLES, _cores(60), recursive=True) + "select id, core from core",
    "pattern_four_cycle_peel": _with(PART2X, ADJ, _INC_CYCLES, _cores(60), _LEVELS, recursive=True) + _BEST,
    "densest_edges": _with(PART2X, _instances(2), _densest(400), recursive=True),
    "densest_triangles": _with(CLICK, _instances(3), _densest(150), recursive=True),
    "densest_triangles_balanced": _with(CLICK, _instances(3), _densest(150), recursive=True),
    "densest_triangles_follow": _with(FOLLOW, _instances(3), _densest(40), recursive=True),
    "densest_edges_parts": _with(PARTS, _instances(2), _densest(60), recursive=True),
    "densest_triangles_unpruned": _with(PART2X, _instances(3), _densest(150), recursive=True),
    "densest_triangles_part2x": _with(PART2X, _instances(3), _densest(150), recursive=True),
    "densest_two_triangles": _with(PART2X, _INC_TWO, _densest(200), recursive=True),
    "densest_four_cycles": _with(PART2X, ADJ, _INC_CYCLES, _densest(200), recursive=True),
    "share_loads": _with(PART2X, _instances(2), _loads(8), recursive=True) + "select id, load from l where it = 8",
    "peel_trace": _with(CLICK, _instances(3), _TRACE, recursive=True)
    + "select step, id, residual_degree, core, remaining_vertices, remaining_instances from trace",
    "peel_best_state": _with(CLICK, _instances(3), _TRACE, recursive=True)
    + """select n_vertices, n_instances from (
  select remaining_vertices as n_vertices, remaining_instances as n_instances from trace where remaining_vertices > 0
  union all select count(distinct id), count(distinct cid) from inc) x order by n_instances / n_vertices desc, n_vertices desc limit 1""",
}
