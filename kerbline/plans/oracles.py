"""SQL of the named queries, written independently of the Spark code, for DuckDB."""

from __future__ import annotations

from .area_queries import AREA_ORACLES
from .extract_queries import EXTRACT_ORACLES
from .network_queries import NETWORK_ORACLES
from .profile_queries import PROFILE_ORACLES
from .rule_queries import RULE_ORACLES
from .study_oracles import STUDY_ORACLES


def _relaxed(name: str, edges: str, rounds: int = 24) -> str:
    """CTEs of all cheapest costs over an edge table (profile, s, d, c), a round of relaxation each."""
    out = [f"{name}0 as materialized (select distinct profile, n_nationkey o, n_nationkey n, 0.0::double c from nation, (select distinct profile from {edges}))"]
    for i in range(rounds):
        out.append(f"{name}{i + 1} as materialized (select profile, o, n, min(c) c from (select * from {name}{i} union all select b.profile, b.o, e.d, b.c + e.c from {name}{i} b join {edges} e on e.profile = b.profile and e.s = b.n) group by all)")
    return ",\n".join(out)


def _geodesic(source: str, keys: str, steps: int = 20) -> str:
    """CTEs up to geo ({keys}, m): metres on the WGS84 ellipsoid between (lon1, lat1) and (lon2, lat2) of source, by Vincenty's formula."""
    f, a = "(1 / 298.257223563::double)", 6378137.0
    angles = f"""(select *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) c from (select *, case when ca = 0 then 0 else cs - 2 * sin(u1) * sin(u2) / ca end cm
  from (select *, 1 - sa * sa ca, atan2(ss, cs) sg from (select *, case when ss = 0 then 0 else cos(u1) * cos(u2) * sin(lam) / ss end sa
  from (select *, sqrt((cos(u2) * sin(lam)) ** 2 + (cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam)) ** 2) ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) cs from it))))) x"""
    return f"""v as (select {keys}, radians(lon2 - lon1) d, atan((1 - {f}) * tan(radians(lat1))) u1, atan((1 - {f}) * tan(radians(lat2))) u2 from {source}),
it as (select {keys}, d, u1, u2, d lam, 0 step from v union all select {keys}, d, u1, u2, d + (1 - c) * {f} * sa * (sg + c * ss * (cm + c * cs * (2 * cm * cm - 1))), step + 1 from {angles} where step < {steps}),
w as (select *, ca * (1 / (1 - {f}) ** 2 - 1) uu from {angles} where step = {steps}),
z as (select *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) p, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) q from w),
geo as (select {keys}, {a} * (1 - {f}) * p * (sg - q * ss * (cm + q / 4 * (cs * (2 * cm * cm - 1) - q / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3)))) m from z)"""


def _edges(name: str, steps_block: str) -> str:
    """Both directions of the nation network under the two profiles."""
    return f"""{name}_seg as (
  select n_nationkey s, (n_nationkey + 1) % 25 d, 100.0::double + 10 * (n_nationkey % 7) l, false st, case when n_nationkey % 3 = 0 then 12.0 else 0.0 end sf, ((n_nationkey % 9) - 4)::double g, n_nationkey % 5 = 2 x from nation
  union all select n_nationkey, (n_nationkey + 5) % 25, 260.0::double + 15 * (n_nationkey % 5), n_nationkey % 4 = 0, case when n_nationkey % 2 = 1 then 0.8 else 0.0 end, 0.0, false from nation),
{name}_dir as (select s, d, l, st, sf, g, x from {name}_seg union all select d, s, l, st, sf, -g, x from {name}_seg),
{name} as materialized (
  select 'standard' profile, s, d, l c from {name}_dir
  union all select 'wheelchair', s, d, l + l * sf + l * greatest(abs(g) - 2.0, 0) * 0.55 * (case when g > 0 then 1.0 else 0.4 end) + (case when x then 400.0 + 25.0 else 0 end) from {name}_dir where {steps_block})"""


ORACLES: dict[str, str] = {
    "route_compare": f"""with {_edges("e", "not st")},
{_relaxed("b", "e")}
select s.o origin, s.n destination, round(s.c, 4) standard_cost, round(w.c, 4) wheelchair_cost, round(w.c - s.c, 4) extra
from b24 s join b24 w on s.o = w.o and s.n = w.n where s.profile = 'standard' and w.profile = 'wheelchair' and s.o < s.n""",
    "counterfactual_routes": f"""with {_edges("e", "not st")}, {_edges("f", "true")},
{_relaxed("b", "e")}, {_relaxed("a", "f")}
select x.o origin, x.n destination, x.profile, round(x.c - y.c, 4) saved from b24 x join a24 y on x.o = y.o and x.n = y.n and x.profile = y.profile where x.o < x.n and round(x.c - y.c, 4) > 0""",
    "itemised_cost": """with p(profile, no_steps, steep, narrow, rough, compacted, bad, incline, comfortable, base, each, kerb, crossing) as (values
  ('standard', false, null, null, 0.0, 0.0, 0.0, 0.0, 3.0, 0.0, 0.0, 0.0, 0.0), ('crutches', false, 15.0, null, 1.6, 0.4, 1.8, 0.5, 3.0, 60.0, 12.0, 40.0, 15.0), ('wheelchair', true, 8.0, 0.9, 12.0, 0.8, 12.0, 0.55, 2.0, 0.0, 0.0, 400.0, 25.0)),
r as (select p.*, l_quantity q, l_returnflag f, l_linestatus s, l_linenumber k, l_discount * 100 g, no_steps and l_returnflag = 'R' blocked from lineitem, p)
select profile, count(*) n, count(*) filter (blocked) blocked,
  round(sum(q) filter (not blocked), 2) distance, round(sum(q * case f when 'A' then rough when 'N' then compacted else 0 end) filter (not blocked), 2) surface,
  round(sum(q * case s when 'F' then bad else 0 end) filter (not blocked), 2) smoothness,
  round(sum(q * greatest(coalesce(g - steep, 0), 0) * 6 + q * greatest(abs(g) - comfortable, 0) * incline * case when g > 0 then 1.0 else 0.4 end) filter (not blocked), 2) incline,
  round(sum(q * greatest(coalesce(narrow - 0.8, 0) * 100, 0) * 0.1 * 6) filter (not blocked), 2) width,
  round(sum(case when f = 'R' then base + each * k else 0 end) filter (not blocked), 2) steps,
  round(sum(case when s = 'O' then kerb else 0 end) filter (not blocked), 2) kerb, round(sum(case when s = 'O' then crossing * 0.4 else 0 end) filter (not blocked), 2) crossing
from r group by profile""",
    "coverage_by_class": "select 'l_returnflag' attribute, l_returnflag as value, count(*) n, true known from lineitem group by all union all select 'l_linestatus', l_linestatus, count(*), true from lineitem group by all",
    "conditional_sums": "select l_returnflag, l_linestatus, count(*) n, count(*) filter (l_discount > 0.05) n_discounted, round(sum(l_quantity), 2) quantity, round(sum(l_quantity) filter (l_discount > 0.05), 2) quantity_discounted, count(distinct l_suppkey) suppliers from lineitem group by all",
    "plausibility_rules": "select 'large' rule, count(*) filter (l_quantity > 45) n from lineitem union all select 'free', count(*) filter (l_discount >= 0.1) from lineitem union all select 'untaxed', count(*) filter (l_tax = 0) from lineitem union all select 'odd_line', count(*) filter (l_linenumber % 2 = 1) from lineitem",
    "value_counts_topn": "with c as (select p_brand v, count(*) n, row_number() over (order by count(*) desc, p_brand) r from part group by p_brand) select case when r <= 5 then v else '(other)' end as value, sum(n)::bigint n, least(r, 6)::int rank from c group by all",
    "quantile_profile": "with r as (select *, row_number() over (partition by o_orderpriority order by o_totalprice) i, count(*) over (partition by o_orderpriority) n from orders) select o_orderpriority, round(max(o_totalprice) filter (i = greatest(1, ceil(n * 0.5))), 4) p50, round(max(o_totalprice) filter (i = greatest(1, ceil(n * 0.95))), 4) p95, round(quantile_cont(o_totalprice, 0.5), 4) median, round(avg(o_totalprice), 4) mean from r group by all",
    "modal_with_ties": "with c as (select c_mktsegment, c_nationkey, o_orderpriority, count(*) n from orders join customer on c_custkey = o_custkey group by all) select c_mktsegment, c_nationkey, o_orderpriority, n from (select *, row_number() over (partition by c_mktsegment, c_nationkey order by n desc, o_orderpriority) i from c) where i = 1",
    "multi_key_rollup": "select r_name, n_name, c_mktsegment, count(*) n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name, c_mktsegment)",
    "semi_anti_consistency": "select c_custkey - 20 id, 'first' only_in from customer where c_custkey - 20 not in (select o_custkey from orders) union select o_custkey, 'second' from orders where o_custkey not in (select c_custkey - 20 from customer)",
    "outer_publication_join": """with r as (select o_custkey id, o_orderkey v from orders where o_totalprice > 200000), bad as (select id from r group by id having count(*) > 1)
select coalesce(c_custkey, r.id) id, c_name left_value, v right_value, case when r.id is null then 'left' when c_custkey is null then 'right' else 'both' end side from (select * from customer where c_custkey not in (select id from bad)) full join (select * from r where id not in (select id from bad)) r on c_custkey = r.id
union all select c_custkey, c_name, null, 'left_unjoinable' from customer where c_custkey in (select id from bad)
union all select id, null, v, 'right_unjoinable' from r where id in (select id from bad)""",
    "outcome_differences": "select c_custkey, 'c_nationkey' field, null::varchar candidate, c_nationkey::varchar baseline from customer where c_custkey % 50 = 0 and c_nationkey is not null union all select c_custkey, 'c_mktsegment', 'OTHER', c_mktsegment from customer where c_custkey % 35 = 0 and c_mktsegment <> 'OTHER'",
    "link_cardinality": "with p as (select distinct l_orderkey a, l_partkey b from lineitem where l_quantity >= 49), c as (select *, count(*) over (partition by a) na, count(*) over (partition by b) nb from p) select case when na = 1 and nb = 1 then '1:1' when nb = 1 then '1:N' when na = 1 then 'N:1' else 'N:M' end cardinality, count(*) links from c group by all",
    "as_of_value": "with f as (select user_id, ts, max(event_type) event_type from events group by all), a as (select event_id, user_id, ts + interval 1 hour as at from events where event_id % 10 = 0) select event_id, event_type from a asof left join f on a.user_id = f.user_id and a.at >= f.ts",
    "first_rule_stratum": "select case when p_size > 40 then 'large' when p_retailprice > 1500 then 'dear' when p_size < 10 then 'small' else 'rest' end stratum, count(*) n, min(p_partkey) as first from part group by all",
    "field_states": "select lang, case when lang = 'es' then 'not_published' when quality is null then 'null' when quality = 0 then 'template_default' else 'non_default' end state, count(*) n from documents left join labels using (doc_id) group by all",
    "worst_of_rank": "select l_orderkey, case max(case l_returnflag when 'N' then 1 when 'A' then 2 when 'R' then 3 end) when 1 then 'n' when 2 then 'a' else 'r' end worst, count(distinct l_returnflag) > 1 conflicted from lineitem group by all",
    "text_normalise": r"""with t as (select doc_id, trim(regexp_replace(regexp_replace(replace(lower("text"), '&', ' and '), '[''’]', '', 'g'), '[^\p{L}\p{N}]+', ' ', 'g')) t from documents) select doc_id, md5(t) digest, len(string_split(t, ' '))::bigint words from t""",
    "trigram_similarity": """with p as (select p_partkey, lower(p_name) as name from part), g as (select p_partkey, list_distinct(flatten(list_transform(list_filter(string_split(name, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, (length(w) + 2)::bigint), lambda i: substr('  ' || w || ' ', i, 3))))) g from p),
s as (select q.p_partkey query, g.p_partkey, len(list_intersect(q.g, g.g)) / len(list_distinct(q.g || g.g)) s from g, g q where q.p_partkey <= 5 and q.p_partkey <> g.p_partkey)
select query, p_partkey, round(s, 6) similarity from (select *, row_number() over (partition by query order by s desc, p_partkey) i from s) where i = 1""",
    "dedupe_grid": "with p as (select vec_id, label, floor(round(embedding[1]::double, 4) / 0.05)::bigint cx, floor(round(embedding[2]::double, 4) / 0.05)::bigint cy from embeddings) select cx, cy, vec_id, label from (select *, row_number() over (partition by cx, cy order by label, vec_id) i from p) where i = 1",
    "grid_knn": "with p as (select vec_id, round(embedding[1]::double, 4) x, round(embedding[2]::double, 4) y from embeddings), d as (select a.vec_id, b.vec_id target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from p a, p b where a.vec_id % 10 = 0 and b.vec_id % 10 <> 0) select vec_id, target, round(d, 6) d, rank from (select *, row_number() over (partition by vec_id order by round(d, 12), target) rank from d where d <= 0.05) where rank <= 3",
    "dwithin_counts": "with p as (select vec_id, round(embedding[1]::double, 4) x, round(embedding[2]::double, 4) y from embeddings) select a.vec_id, count(*) - 1 n from p a, p b where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.03 group by all",
    "directed_hausdorff": "with p as (select vec_id, label, round(embedding[1]::double, 4) x, round(embedding[2]::double, 4) y from embeddings), d as (select a.vec_id, a.label, min(sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))) d from p a, p b where a.vec_id % 2 = 0 and b.vec_id % 2 = 1 group by all) select label, round(case when count(*) filter (d > 0.2) = 0 then max(d) end, 6) \"offset\" from d group by all",
    "interval_merge": "with i as (select user_id, floor(epoch(ts))::bigint lo, floor(epoch(ts))::bigint + event_id % 97 * 3600 hi from events), w as (select *, max(hi) over (partition by user_id order by lo, hi rows between unbounded preceding and 1 preceding) seen from i) select user_id, sum(greatest(0, hi - greatest(lo, coalesce(seen, lo))))::bigint covered, count(*) filter (seen is null or lo > seen) pieces from w group by all",
    "interval_overlap_share": "with o as (select o_orderkey, o_custkey, o_orderpriority p, date_diff('day', date '1970-01-01', o_orderdate::date) d from orders) select a.o_orderkey, b.o_orderkey other, (least(a.d + 90, b.d + 60) - greatest(a.d, b.d))::bigint overlap from o a join o b on a.o_custkey = b.o_custkey where a.p like '1%' and b.p not like '1%' and least(a.d + 90, b.d + 60) > greatest(a.d, b.d)",
    "island_traversals": "with m as (select *, case when lag(event_type) over w = event_type then 0 else 1 end t from events window w as (partition by user_id order by event_id)), s as (select *, sum(t) over (partition by user_id order by event_id)::bigint traversal from m) select user_id, traversal, event_type, min(event_id) as first, max(event_id) as last, count(*) n from s group by all",
    "cumulative_position": "select l_orderkey, l_linenumber, (sum(l_quantity::bigint) over w - l_quantity::bigint)::bigint from_m, (sum(l_quantity::bigint) over w)::bigint to_m from lineitem window w as (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding)",
    "value_introduced": "with m as (select *, coalesce(lag(event_type) over (partition by user_id order by event_id) <> event_type, true) c from events) select user_id, max_by(event_type, event_id) event_type, max(event_id) filter (c) introduced, count(*) filter (c) changes from m group by all",
    "unit_share": "select l_orderkey, l_linenumber, round(l_quantity / sum(l_quantity) over (partition by l_orderkey), 6) unit_share from lineitem",
    "way_segments": f"""with recursive r as (select l_orderkey w, l_partkey a, lead(l_partkey) over v b, row_number() over v - 1 i from lineitem window v as (partition by l_orderkey order by l_linenumber, l_partkey)), n as (select p_partkey k, p_partkey % 100 * 0.001::double lon, p_partkey % 37 * 0.001::double lat from part where p_size > 3),
g as (select w, i, x.lon lon1, x.lat lat1, y.lon lon2, y.lat lat2 from r join n x on x.k = a join n y on y.k = b),
{_geodesic("g", "w, i", 8)}
select w way_id, count(*) n, round(sum(m), 1) length_m, min(i) first_pair from geo where m > 0 group by all""",
    "connected_components": """with recursive t as (select max(p_partkey) top from part), e as (select p_partkey a, p_partkey * 7 % top + 1 b from part, t where p_size <= 20), u as (select a, b from e union select b, a from e), r(node, seen) as (select a, a from u union select r.node, u.b from r join u on u.a = r.seen)
select node, min(seen) root from r group by all""",
    "component_sizes": """with recursive t as (select max(p_partkey) top from part), e as (select p_partkey a, p_partkey * 7 % top + 1 b from part, t where p_size <= 20), u as (select a, b from e union select b, a from e), r(node, seen) as (select a, a from u union select r.node, u.b from r join u on u.a = r.seen), c as (select node, min(seen) root from r group by all)
select row_number() over (order by count(*) desc, root) - 1 part, count(*) size, min(node) first_node from c group by root""",
    "content_hash_rows": "select n_nationkey, sha256(n_nationkey || '|' || n_name || '|' || n_regionkey) row_sha256 from nation",
    "content_hash_table": """with h as (select sha256(concat_ws(chr(31), c_custkey, c_name, c_nationkey, c_mktsegment)) h from customer),
b as (select h, ('0x' || substr(h, 1, 8))::bigint % (select greatest(1, (count(*) + 49999) // 50000) from h) k from h),
p as (select k, count(*) n, sha256(string_agg(h, '' order by h)) h from b group by k) select sum(n)::bigint n, sha256(string_agg(h, '' order by k)) content_sha256 from p""",
    "stratified_hash_sample": "select lang, doc_id, draw from (select lang, doc_id, row_number() over (partition by lang order by sha256('s1:' || doc_id)) draw from documents) where draw <= 10",
    "sample_allocation": """with recursive z as (select source stratum, count(*) n from documents group by all),
s as (select list({'stratum': stratum, 'n': n, 'take': least(n, 2)} order by stratum) l, 0 step from z
  union all select list_transform(l, lambda x: {'stratum': x.stratum, 'n': x.n, 'take': x.take + case when given > 0 then case when x.n > x.take then least(floor(lo * x.n / weight)::bigint, x.n - x.take) else 0 end when x.stratum = best then 1 else 0 end}), step + 1
  from (select *, list_sum(list_transform(room, lambda x: least(floor(lo * x.n / weight)::bigint, x.n - x.take)))::bigint given,
      list_sort(list_transform(room, lambda x: {'f': floor(lo * x.n / weight) - lo * x.n / weight, 'n': -x.n, 's': x.stratum}))[1].s best
    from (select *, list_sum(list_transform(room, lambda x: x.n))::double weight, 60 - list_sum(list_transform(l, lambda x: x.take))::bigint lo
      from (select *, list_filter(l, lambda x: x.n > x.take) room from s)) where lo > 0 and len(room) > 0) where step < 60)
select x.stratum, x.n::bigint n, x.take::bigint take from (select unnest(l) x from (select l from s order by step desc limit 1))""",
    "wilson_prf": "with c as (select count(*) filter (quality = 1 and toxic = 1) tp, count(*) filter (quality = 1 and toxic = 0) fp, count(*) filter (quality = 0 and toxic = 1) fn from labels), d as (select *, (tp + fp)::double n, tp / (tp + fp)::double p, 1.959963984540054 z from c) select tp, fp, fn, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) low, round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) high, round(p, 6) \"precision\", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 from d",
    "confusion_agreement": "select quality, toxic, count(*) n from labels group by all",
    "grid_tune": "with g as (select unnest(range(1, 11)) * 200 least), s as (select g.least, count(*) filter (n_chars >= g.least and quality = 1) tp, count(*) filter (n_chars >= g.least and quality <> 1) fp, count(*) filter (n_chars < g.least and quality = 1) fn from documents join labels using (doc_id), g group by all), f as (select *, 2 * tp / (2 * tp + fp + fn) v from s) select least, tp, fp, fn, round(v, 6) f1, row_number() over (order by v desc nulls last, fp, least) = 1 best from f",
    "set_outcomes": """with o as (select l_orderkey, coalesce(list(distinct l_linenumber) filter (l_quantity > 25), []) t, coalesce(list(distinct l_linenumber) filter (l_discount > 0.04), []) g from lineitem group by all), c as (select t, g, len(list_intersect(t, g)) tp from o)
select case when list_sort(t) = list_sort(g) then 'exact' when tp > 0 then 'partial' when len(g) = 0 then 'missed' when len(t) = 0 then 'invented' else 'wrong' end outcome, count(*) n, sum(tp)::bigint tp, sum(len(g) - tp)::bigint fp, sum(len(t) - tp)::bigint fn from c group by all""",
    "table_rows": " union all ".join(f"select '{t}' as name, count(*) n from {t}" for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")),
    "geodesic_check": f"""with recursive g as (select n_nationkey, 0.0::double lon1, 0.0::double lat1, n_nationkey * 3.0::double - 40 lon2, n_nationkey * 2.0::double - 20 lat2 from nation),
{_geodesic("g", "n_nationkey, lon2, lat2")}
select n_nationkey, round(asin(sqrt(least(1.0, sin(radians(lat2) / 2) ** 2 + cos(radians(lat2)) * sin(radians(lon2) / 2) ** 2))) * 2 * 6371008.8, 2) haversine_m, round(m, 2) geodesic_m from geo""",
    "schema_contract": "select * from (values ('n_nationkey', 'mismatched', 'int, not bigint'), ('n_population', 'missing', 'bigint'), ('n_regionkey', 'additional', 'int')) v(\"column\", problem, detail)",
    "bootstrap_interval": """with r as (select doc_id, (toxic = 0 and quality = 1)::int tp, (toxic = 0 and quality <> 1)::int fp, (toxic <> 0 and quality = 1)::int fn from labels),
u as (select draw, tp, fp, fn, ('0x' || substr(md5(doc_id || ':' || draw), 1, 13))::bigint / 4503599627370496.0::double u from r, (select unnest(range(1, 2001)) draw)),
k as (select *, (u >= exp(-1))::int + (u >= exp(-1) * 2)::int + (u >= exp(-1) * 5 / 2)::int + (u >= exp(-1) * 8 / 3)::int + (u >= exp(-1) * 65 / 24)::int + (u >= exp(-1) * 163 / 60)::int + (u >= exp(-1) * 1957 / 720)::int + (u >= exp(-1) * 685 / 252)::int k from u),
s as (select draw, sum(k * tp)::double tp, sum(k * fp)::double fp, sum(k * fn)::double fn from k group by draw),
m as (select unnest([{'measure': 'precision', 'v': tp / nullif(tp + fp, 0)}, {'measure': 'recall', 'v': tp / nullif(tp + fn, 0)}, {'measure': 'f1', 'v': 2 * tp / nullif(2 * tp + fp + fn, 0)}], recursive := true) from s)
select measure, round(quantile_cont(v, 0.025), 6) low, round(quantile_cont(v, 0.975), 6) high from m group by measure""",
    "tumbling_events": "select time_bucket(interval 1 day, ts) as start, event_type, count(*) n, round(sum(value), 4) total from events group by all",
    "sliding_events": "select d as start, event_type, count(*) n from (select unnest([time_bucket(interval 1 day, ts), time_bucket(interval 1 day, ts) - interval 1 day]) d, event_type from events) group by all",
    "event_sessions": "with g as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end s from events window w as (partition by user_id order by ts)), h as (select *, sum(s) over (partition by user_id order by ts, event_id rows unbounded preceding) k from g) select user_id, min(ts) as start, count(*) n from h group by user_id, k",
    "token_bucket": """with recursive e as (select user_id u, epoch(ts) t, row_number() over (partition by user_id order by ts, event_id) i from events),
b as (select u, i, t, 1.0::double left_, true ok from e where i = 1
  union all select u, i, t, had - (had >= 1)::int, had >= 1 from (select e.u, e.i, e.t, least(2.0, b.left_ + greatest(0, e.t - b.t) / 86400) had from b join e on e.u = b.u and e.i = b.i + 1))
select ok admitted, count(*) n from b group by ok""",
} | STUDY_ORACLES | RULE_ORACLES | PROFILE_ORACLES | NETWORK_ORACLES | EXTRACT_ORACLES | AREA_ORACLES
