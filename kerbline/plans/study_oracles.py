"""SQL of the queries in study_queries, for DuckDB."""

from __future__ import annotations

_HISTORY = """h as (select *, case event_id % 7 when 0 then 'survey' when 1 then 'City of Kitchener open data' when 2 then 'bulk import' when 3 then 'Bing' when 4 then 'Mapillary' end src from events),
e as (select *, case when src is distinct from lag(src) over w then src end own, row_number() over w i, lag(event_type) over w pt from h window w as (partition by user_id order by ts)),
s as (select user_id, max(ts) - interval 3 days since from events where user_id % 2 = 0 group by user_id)"""

_SOURCES = """r0 as (select l_orderkey seg, case when l_linenumber % 6 = 5 then 'Other' else 'OSM' end ds, case when l_suppkey % 9 = 0 then 'x' when l_suppkey % 5 = 0 then 'n' else 'w' end k, l_partkey way, l_suppkey % 2 + 1 ver,
  l_returnflag = 'A' prop, case when l_tax > 0.02 then l_tax * 5 end lo, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') t, l_linenumber ln from lineitem),
r1 as (select * from r0 union all select * from r0 where ln = 1),
r2 as (select *, row_number() over (partition by seg, ds, k, way, ver, prop, lo, t, ln) dup from r1),
src as (select *, case when dup > 1 then 'duplicate' when ds <> 'OSM' then 'other_dataset' when k = 'x' or way = 0 then 'malformed_id' when prop then 'property_only' when k = 'n' then 'other_element' when lo >= 0.3 then 'malformed_range' else 'way' end kind from r2)"""

_XY = "p as (select vec_id, label, round(embedding[1]::double, 4) x, round(embedding[2]::double, 4) y from embeddings)"

STUDY_ORACLES: dict[str, str] = {
    "attribute_lineage": f"""with {_HISTORY},
g as (select *, sum(case when i = 1 or event_type <> pt then 1 else 0 end) over (partition by user_id order by ts) run from e),
c as (select * from g qualify run = max(run) over (partition by user_id)),
n as (select *, row_number() over (partition by user_id order by ts) j, count(*) over (partition by user_id) - 1 later, count(*) filter (own = 'survey') over (partition by user_id) sv from c)
select n.user_id, event_type, event_id, sv - (case when own = 'survey' then 1 else 0 end) confirmations,
  case when own = 'City of Kitchener open data' then 'known' when own = 'bulk import' then 'possible' when ts < since or own in ('survey', 'Mapillary') then 'independent' else 'unknown' end lineage,
  case when coalesce(own, '') in ('City of Kitchener open data', 'bulk import') then null when own in ('survey', 'Mapillary') then 'declared' when ts < since then 'dates' end basis
from n left join s on n.user_id = s.user_id where j = 1""",
    "shape_lineage": f"""with {_HISTORY},
c as (select user_id, coalesce(bool_or(own = 'City of Kitchener open data'), false) a, coalesce(bool_or(own = 'bulk import'), false) b, bool_and(coalesce(own, '') in ('survey', 'Mapillary', 'Bing')) st, max(ts) t from e where event_id % 5 = 0 or event_type = 'signup' group by user_id),
d as (select c.user_id % 40 record, case when a then 1 when b then 2 when coalesce(t < since, false) or st then 4 else 3 end k from c left join s on c.user_id = s.user_id)
select record, ['known', 'possible', 'unknown', 'independent'][min(k)] lineage from d group by record""",
    "source_kinds": f"with {_SOURCES} select kind, count(*) n from src group by kind",
    "way_linkage": f"""with {_SOURCES},
l as (select * from src where kind = 'way'), c as (select seg, count(distinct way) c from l group by seg),
m as (select way, count(distinct l.seg) segments, max(c) cited from l join c on l.seg = c.seg group by way),
f as (select way, list_sort(list(distinct ver)) vs, list_sort(list(distinct t)) ts, count(*) filter (lo > 0 or lo is not null) partial_ranges from l group by way),
j as (select p_partkey way_id, p_size % 3 + 1 o, '199' || (p_size % 10) || '-06-01T00:00:00Z' ot, m.*, vs, ts, partial_ranges from part left join m on m.way = p_partkey left join f on f.way = p_partkey)
select way_id, case when segments is null then 'not_linked' else 'linked' end as match, case when segments > 1 and cited > 1 then 'N:M' when segments > 1 then '1:N' when cited > 1 then 'N:1' when segments is not null then '1:1' end cardinality, segments, partial_ranges,
  case when segments is null then null when len(vs) > 1 then 'ambiguous' when o < vs[1] then 'ours_older' when o > vs[1] then 'ours_newer' when len(ts) > 1 then 'time_unverified' when ts[1] = ot then 'exact'
    when ts[1] > ot and ts[1] > '1996-01-01T00:00:00Z' then 'edited_after_our_snapshot' when ts[1] > ot then 'time_inconsistent' when substr(ot, 1, 10) > '1998-01-01' then 'edited_after_their_snapshot' when ot <= '1994-01-01T00:00:00Z' then 'time_inconsistent' else 'time_unverified' end status
from j""",
    "point_linkage": """with c as (select l_partkey k, count(*) n from lineitem group by 1), p as (select p_partkey k from part where p_partkey % 3 <> 0), b as (select coalesce(c.k, p.k) k, coalesce(n, 0) n, p.k is not null known from c full join p on c.k = p.k)
select known, p_partkey is not null is_node, count(*) n, sum(n)::bigint cited from b left join (select p_partkey from part where p_size > 25) on p_partkey = k group by all""",
    "bridge_rows": """with b as (select s_suppkey k, unnest(['O', null, 'P']) status from supplier), s as (select l_suppkey k, nullif(l_linestatus, 'F') status, string_agg(distinct l_returnflag, ',' order by l_returnflag) properties from lineitem group by 1, 2)
select b.k, b.status, properties is not null found, properties from b left join s on b.k = s.k and b.status is not distinct from s.status""",
    "source_independence": "with g as (select l_orderkey, l_linestatus, count(distinct nullif(l_returnflag, 'A')) c from lineitem group by 1, 2) select l_linestatus, case c when 0 then 'none' when 1 then 'single' else 'several' end shape, count(*) n from g group by all",
    "route_totals": """select l_orderkey request, count(*) pieces, sum(l_quantity) distance_m, coalesce(sum(l_quantity) filter (l_returnflag = 'R'), 0) m_rough, round(coalesce(sum(l_quantity) filter (l_returnflag <> 'N'), 0) / sum(l_quantity), 6) share_surface,
  round(coalesce(sum(l_quantity) filter (l_linestatus = 'F'), 0) / sum(l_quantity), 6) share_grade, round(coalesce(sum(l_quantity) filter (l_returnflag = 'N' and l_linestatus <> 'F'), 0) / sum(l_quantity), 6) unknown_share from lineitem group by 1""",
    "route_gradients": """with p as (select l_orderkey request, l_linenumber ix, l_partkey s, l_quantity m, round(l_discount * 100 - 5) g, case when l_linestatus = 'F' then 'recorded' when l_returnflag = 'N' then 'derived' else 'unknown' end k from lineitem),
q as (select *, row_number() over (partition by request order by g desc, ix, s desc) u, row_number() over (partition by request order by g, ix, s) d from p)
select request, coalesce(sum(m) filter (k = 'recorded'), 0) m_recorded, coalesce(sum(m) filter (k = 'derived'), 0) m_derived, coalesce(sum(m) filter (k = 'unknown'), 0) m_unknown,
  max(g) filter (u = 1 and g > 0) steepest_up, max(s) filter (u = 1 and g > 0) up_segment, max(g) filter (d = 1 and g < 0) steepest_down, max(s) filter (d = 1 and g < 0) down_segment from q group by request""",
    "route_explanations": """with a as (select l_orderkey request, sum(l_quantity) distance, sum(l_linenumber * 2)::double steps, sum(case when l_returnflag = 'R' then 5 else 0 end)::double crossing from lineitem group by 1),
b as (select l_orderkey request, sum(l_quantity) distance, sum(l_linenumber * 2)::double steps, sum(case when l_returnflag = 'R' then 5 else 0 end)::double crossing from lineitem where l_linenumber <= 2 group by 1),
x as (select a.request, unnest(['distance', 'steps', 'crossing']) code, unnest([a.distance, a.steps, a.crossing]) theirs, unnest([b.distance, b.steps, b.crossing]) ours from a join b on a.request = b.request)
select request, code, theirs, ours, theirs - ours saved, row_number() over (partition by request order by theirs - ours desc, code) place from x where theirs - ours > 1""",
    "cited_segments": """with o as (select l_orderkey request, l_linenumber ix, min(l_partkey) s from lineitem group by 1, 2), c as (select l_orderkey r, l_partkey k from lineitem where l_linestatus = 'O' and l_returnflag = 'N'),
f as (select *, row_number() over (partition by request order by ix) i from o where ix <> 2 and not exists (select 1 from c where r = request and k = s))
select request, string_agg(s::varchar, ',' order by i) segments from f where i <= 3 group by request""",
    "route_findings": """with p as (select l_orderkey request, l_linenumber ix, sum(l_quantity) m, min(l_suppkey) a, max(l_suppkey % 3) b, max(round(l_discount * 100 - 5)) g, max(l_returnflag) f from lineitem group by 1, 2),
c as (select request, a <> lag(b) over (partition by request order by ix) bad from p), x as (
  select request, 'continuity' as check from c where bad union all select distinct request, 'distance' from p where request % 7 = 0 union all select distinct request, 'eta' from p where request % 10 = 0
  union all select request, 'rough' from p where f = 'R' union all select request, 'climb' from p where g > 3)
select request, "check", count(*) n from x group by all""",
    "path_digests": "select l_orderkey request, sha256(string_agg(l_partkey::varchar, '>' order by l_linenumber, l_partkey::varchar)) path_sha256 from lineitem group by 1",
    "route_changes": """with b as (select l_orderkey r, string_agg(l_partkey::varchar, '>' order by l_linenumber, l_partkey::varchar) p, sum(l_quantity) d from lineitem where l_linestatus = 'F' or l_linenumber > 1 group by 1),
a as (select l_orderkey r, string_agg(l_partkey::varchar, '>' order by l_linenumber, l_partkey::varchar) p, sum(l_quantity) d from lineitem where l_returnflag <> 'R' group by 1)
select case when b.p is null then 'opened' when a.p is null then 'closed' when a.p = b.p then 'same' else 'moved' end change, count(*) n, sum(a.d - b.d) detour_m from a full join b on a.r = b.r group by 1""",
    "recosted_paths": "select l_orderkey request, case when count(*) filter (p_size > 5) = count(*) then sum(p_size * 2.0::double) end path_cost, count(*) filter (p_size is null or p_size <= 5) newly_blocked from lineitem left join part on p_partkey = l_partkey group by 1",
    "majority_fill": """with s as (select l_orderkey, l_returnflag, sum(l_quantity) m from lineitem group by 1, 2), r as (select *, m / sum(m) over (partition by l_orderkey) share, row_number() over w i, lead(m) over w / sum(m) over (partition by l_orderkey) nxt from s window w as (partition by l_orderkey order by m desc, l_returnflag))
select l_orderkey, l_returnflag, round(share, 6) share from r where i = 1 and share >= 0.9 and coalesce(nxt, 0) <= 0.1""",
    "broad_journeys": f"""with {_XY}, o as (select vec_id o, x, y from p qualify row_number() over (partition by floor(x / 0.1), floor(y / 0.1) order by sha256('s:' || vec_id)) = 1),
d as (select o as origin, vec_id destination, sqrt((o.x - p.x) ** 2 + (o.y - p.y) ** 2) d from o join p on o <> vec_id),
b as (select *, case when d < 0.02 then 0 when d < 0.05 then 1 end band from d)
select origin, band, destination from b where band is not null qualify row_number() over (partition by origin, band order by sha256('s:' || origin || ':' || destination)) = 1""",
    "gate_funnel": """with f as (select p_size > 5 a, p_retailprice < 1500 b, p_type <> 'PROMO' c, p_brand like '%3' d from part)
select unnest([1, 2, 3, 4])::bigint stage, unnest(['sized', 'priced', 'typed', 'branded']) gate, unnest([count(*), count(*) filter (a), count(*) filter (a and b), count(*) filter (a and b and c)]) reached,
  unnest([count(*) filter (not a), count(*) filter (a and not b), count(*) filter (a and b and not c), count(*) filter (a and b and c and not d)]) dropped from f""",
    "record_comparison": """with a as (select c_custkey k, 'status' topic, case when c_nationkey % 2 = 0 then 'O' else 'F' end v from customer where c_custkey % 4 <> 0 union all select c_custkey, 'parity', (c_nationkey % 2)::varchar from customer),
b as (select o_custkey k, 'status' topic, o_orderstatus v from orders union all select o_custkey, 'parity', (o_orderkey % 2)::varchar from orders where o_orderkey % 3 = 0), c as (select k, topic, list(distinct v) vs from b group by 1, 2)
select coalesce(a.topic, c.topic) topic, case when vs is null then 'ours_only' when v is null then 'theirs_only' when not list_contains(vs, v) then 'conflict' when len(vs) > 1 then 'mixed' else 'consistent' end outcome, count(*) n from a full join c on a.k = c.k and a.topic = c.topic group by 1, 2""",
    "hard_records": """with r as (select *, row_number() over (order by p_size) i, row_number() over (order by p_retailprice) j, count(*) over () n from part), c as (select max(p_size) filter (i = ceil(n * 0.9)) a, max(p_retailprice) filter (j = ceil(n * 0.9)) b from r)
select p_partkey, p_size > a hard_p_size, p_retailprice > b hard_p_retailprice from part, c where p_size > a or p_retailprice > b""",
    "movable_journeys": """with s as (select distinct (s_suppkey * 7 % 60)::double x, s_nationkey * 3.0::double y from supplier), j as (select c_custkey journey, (c_custkey % 50)::double ox, c_nationkey * 2.0::double oy, (c_custkey % 31)::double dx, c_nationkey::double dy, c_custkey % 40 + 5.0::double cost from customer)
select distinct journey from j, s where sqrt((ox - x) ** 2 + (oy - y) ** 2) + sqrt((dx - x) ** 2 + (dy - y) ** 2) <= cost""",
    "located_points": f"""with {_XY}
select vec_id point_id, case when exists (select 1 from p b where b.label = 0 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.01) then 'accepted' when exists (select 1 from p b where b.label = 1 and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.02) then 'near'
  when exists (select 1 from p b where b.label in (2, 3) and sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 0.05) then 'covered' else 'outside' end place from p a where label > 3""",
    "contracted_chains": "select min(n_nationkey) chain_id, count(*) segments, sum(n_nationkey + 10.0)::double length_m, (n_nationkey // 5)::int surface from nation group by n_nationkey // 5",
    "relocated_ends": """with c as (select distinct l_orderkey request, case when l_linenumber % 2 = 0 then 'o' else 'd' end side, l_partkey node, l_quantity d, (l_suppkey % 40)::double far from lineitem),
r as (select *, row_number() over (partition by request, side order by d, node) i from c), k as (select r.*, p_size % 3 part from r join part on p_partkey = node where i = 1 or far > d),
b as (select * from k qualify row_number() over (partition by request, side, part order by d, node) = 1)
select a.request, a.node origin, b.node destination, a.part from b a join b on a.request = b.request and a.part = b.part and a.side = 'o' and b.side = 'd' where a.i = 1 or b.i = 1
qualify row_number() over (partition by a.request order by case when a.i = 1 and b.i = 1 then 0 else 1 end, a.part, a.d + b.d) = 1""",
    "named_stretches": """with recursive p as (select p_partkey k, p_name || ' ' || p_brand name, (p_partkey % 83)::double x, (p_partkey % 37)::double y, p_partkey % 211 a, p_partkey * 5 % 211 b from part),
l as materialized (select p.k u, q.k v from p join p q on p.name = q.name and p.k <> q.k and (sqrt((p.x - q.x) ** 2 + (p.y - q.y) ** 2) <= 3 or p.a in (q.a, q.b) or p.b in (q.a, q.b))),
r(piece_id, seen) as (select k, k from p union select piece_id, v from r join l on u = seen) select piece_id, min(seen) stretch from r group by 1""",
}
