"""Named queries of routes between coordinates and of positions along lines, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cost, linear
from ..operators import graph, positions, routing
from ..sources import dumps, regions
from ..sources.tables import table
from ..storage import scratch_folder


def bent_grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(segments, points) of a street grid on the parts, whose side grows with their number: bent lines, stairs, one-way and rough ones by size."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), "p_size")
    side = math.isqrt(part.count())
    part = part.filter(F.col("n") < side * side).withColumns({"c": F.col("n") % side, "r": F.floor(F.col("n") / side)})
    x, y, bend = F.col("c") * 50.0, F.col("r") * 50.0, (F.col("p_size") % 7 - 3) * 2.0

    def line(across: bool):
        ends = [(x, y), (x + 25.0, y + bend), (x + 50.0, y)] if across else [(x, y), (x + bend, y + 25.0), (x, y + 50.0)]
        return F.array(*(F.struct(a.alias("x"), b.alias("y")) for a, b in ends)).alias("line")

    stairs = F.when((F.col("c") % 3 == 1) & (F.col("p_size") % 2 == 0), "yes").otherwise("no")
    across = part.filter(F.col("c") < side - 1).select(F.concat(F.lit("h"), "n").alias("segment_id"), F.col("n").alias("src"), (F.col("n") + 1).alias("dst"), line(True), F.lit("no").alias("steps"), (F.col("p_size") % 10 != 0).alias("foot_backward"), "p_size")
    down = part.filter(F.col("r") < side - 1).select(F.concat(F.lit("v"), "n").alias("segment_id"), F.col("n").alias("src"), (F.col("n") + side).alias("dst"), line(False), stairs.alias("steps"), F.lit(True).alias("foot_backward"), "p_size")
    rows = across.union(down).withColumns({"length_m": linear.line_length(F.col("line")), "surface_class": F.when(F.col("p_size") % 4 == 0, "rough").otherwise("paved")}).drop("p_size")
    same = {"foot_access": "yes", "general_access": "yes", "smoothness_class": "good", "kerb": "raised", "crossing_type": "unmarked", "conveying": "none"}
    facts = {"effective_grade": F.lit(0.0), "is_crossing": F.lit(False), "step_count": F.lit(None).cast("int"), "width_m": F.lit(1.5), "unit_share": F.lit(1.0), "foot_forward": F.lit(True)}
    return rows.withColumns({k: F.lit(v) for k, v in same.items()} | facts), part.select(F.col("n").alias("node"), x.alias("x"), y.alias("y"))


def grid_requests(spark: SparkSession, sf: str) -> DataFrame:
    """(request, profile, ox, oy, dx, dy): from a place near each node divisible by 100 to one near another; some off the network or too far apart."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("n"), "p_size")
    side = math.isqrt(part.count())
    n, to = F.col("n"), F.col("n") * 7 % (side * side)
    ox = F.when(F.col("p_size") % 17 == 0, -400.0).otherwise(n % side * 50.0 + F.col("p_size") % 11 * 4.0 - 20.5)
    dx = F.when(n % 1300 == 700, 20_000.0).otherwise(to % side * 50.0 + n / 100 % 9 * 5.0 - 20.25)
    return part.filter(f"n % 100 = 0 and n < {side * side}").select(
        F.concat(F.lit("q"), n).alias("request"), F.when(n / 100 % 2 == 0, "standard").otherwise("wheelchair").alias("profile"),
        ox.alias("ox"), (F.floor(n / side) * 50.0 + n % 13 * 3.0 - 18.75).alias("oy"), dx.alias("dx"), (F.floor(to / side) * 50.0 + n / 100 % 5 * 6.0 - 12.125).alias("dy"),
    )


def coordinate_routes(spark: SparkSession, sf: str) -> DataFrame:
    segments, points = bent_grid(spark, sf)
    directed = cost.with_cost(graph.directed(segments), cost.profiles(spark, ("standard", "wheelchair")))
    costed = directed.select("profile", "segment_id", "src", "dst", "reversed", "cost")
    found = routing.coordinate_routes(segments, costed, grid_requests(spark, sf), points=points, cells=graph.even_cells(points))
    return found.select("request", "profile", "outcome", *(F.round(c, 4).alias(c) for c in ("cost", "distance_m", "origin_d", "destination_d")))


def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(l_orderkey, line, m): an order's lines as the vertices of one line, and how many there are."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", F.struct("l_linenumber", F.col("l_quantity").alias("x"), (F.col("l_partkey") % 97).cast("double").alias("y")).alias("v"))
    lines = rows.groupBy("l_orderkey").agg(F.sort_array(F.collect_list("v")).alias("vs"), F.count("*").alias("m"))
    return lines.select("l_orderkey", F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y"))).alias("line"), "m")


def line_projections(spark: SparkSession, sf: str) -> DataFrame:
    """Where the point of each order's customer falls on the line of its lines."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_custkey") % 50 + 0.3).alias("px"), (F.col("o_custkey") % 83 + 0.7).alias("py"))
    rows = _order_lines(spark, sf).join(orders, "l_orderkey").withColumn("at", linear.project_on_line(F.col("px"), F.col("py"), F.col("line")))
    return rows.select("l_orderkey", F.round("at.d", 6).alias("d"), F.round("at.fraction", 6).alias("fraction"), F.round("at.x", 5).alias("x"), F.round("at.y", 5).alias("y"))


def line_cuts(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's line cut at two fractions of it, with a quantity of 100 shared out by length."""
    rows = _order_lines(spark, sf).filter(linear.line_length(F.col("line")) > 0)
    lo, hi = (F.col("l_orderkey") % 10) / 20, 0.5 + (F.col("l_orderkey") % 7) / 14
    pieces = rows.select("l_orderkey", linear.line_length(F.col("line")).alias("whole"), F.posexplode(linear.cut_at(F.col("line"), F.array(lo, hi))).alias("piece", "p"))
    length = linear.line_length(F.col("p.line"))
    return pieces.select("l_orderkey", F.col("piece").cast("long").alias("piece"), F.size("p.line").cast("long").alias("vertices"), F.round(length, 5).alias("length"), F.round(100 * length / F.col("whole"), 5).alias("share"), F.round(F.element_at("p.line", 1)["x"], 5).alias("x"), F.round(F.element_at("p.line", 1)["y"], 5).alias("y"))


def _event_dump(spark: SparkSession, sf: str) -> tuple[str, str]:
    """(dump, index): the events as a dump of changesets in the shared folder."""
    dumps.register(spark)
    e, none = table(spark, sf, "events"), F.lit(None).cast("double")
    rows = e.select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("closed_at"), F.col("user_id").alias("num_changes"),
        F.col("value").alias("min_lon"), none.alias("min_lat"), none.alias("max_lon"), none.alias("max_lat"), F.create_map(F.lit("comment"), F.col("event_type"), F.lit("source"), F.col("props"), F.lit("uid"), F.lit("x")).alias("tags"),
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = scratch_folder(spark)
    rows.repartitionByRange(parts, "id").sortWithinPartitions("id").write.format("changesets").mode("append").save(f"{path}/dump")
    dumps.write_index(spark, f"{path}/dump", f"{path}/index")
    return f"{path}/dump", f"{path}/index"


def changeset_dump(spark: SparkSession, sf: str) -> DataFrame:
    """Events written as a dump of many streams, and all of them read back."""
    dump, index = _event_dump(spark, sf)
    rows = spark.read.format("changesets").option("index", index).load(dump)
    return rows.select("id", "created_at", "num_changes", F.col("tags")["comment"].alias("comment"), F.col("tags")["source"].alias("source"), F.map_contains_key("tags", "uid").alias("named"))


def changeset_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The changesets that the orders' keys name, found through the index of streams."""
    dump, index = _event_dump(spark, sf)
    asked = table(spark, sf, "orders").select((F.col("o_orderkey") * 3).alias("id"))
    return dumps.lookup(spark, dump, index, asked).select("id", "num_changes", F.col("tags")["comment"].alias("comment"))


def vertex_agreements(spark: SparkSession, sf: str) -> DataFrame:
    """Each order's line against itself with shifted and moved vertices."""
    line, k = F.col("line"), F.col("l_orderkey")
    moved = F.transform(line, lambda v, i: F.struct((v["x"] + 0.5 + F.when((k + i) % 4 == 0, 1.75).otherwise(0.0)).alias("x"), (v["y"] - 0.25 + (k + i) % 3 * 0.125).alias("y")))
    rows = _order_lines(spark, sf).filter("m >= 2").withColumn("a", linear.vertex_agreement(line, moved))
    return rows.select("l_orderkey", F.col("a.near").cast("long").alias("near"), F.col("a.paired").cast("long").alias("paired"), F.round("a.median_m", 6).alias("median_m"), F.round("a.spread_m", 6).alias("spread_m"))


def segment_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of an order's lines as a way; a run from its second line, forwards or backwards, as a segment: where it lies."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda v: v["l_partkey"] % 5).alias("refs"))
    ways = lines.select(F.col("l_orderkey").alias("way_id"), "refs")
    run = F.slice("refs", 2, 3)
    segments = ways.filter("size(refs) >= 3").select(F.concat(F.lit("s"), "way_id").alias("segment_id"), "way_id", F.when(F.col("way_id") % 2 == 0, run).otherwise(F.reverse(run)).alias("refs"))
    return positions.located_runs(segments, ways).select("segment_id", "way_id", F.col("place").cast("long").alias("place"), "reversed")


def region_replacement(spark: SparkSession, sf: str) -> DataFrame:
    """Customers by nation, published; then the nations of one region replaced by changed rows, and a writer that fails."""
    root = scratch_folder(spark)
    customers = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("region"), F.lit("first").alias("edition"))
    regions.replace_regions(spark, root, customers)
    some = table(spark, sf, "nation").filter("n_regionkey = 2").select(F.col("n_nationkey").alias("region"))
    regions.replace_regions(spark, root, customers.join(F.broadcast(some), "region", "left_semi").filter("c_custkey % 3 != 0").withColumn("edition", F.lit("second")).select("c_custkey", "region", "edition"))
    return regions.read_regions(spark, root).select("c_custkey", "region", "edition")


NETWORK_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (coordinate_routes, line_projections, line_cuts, changeset_dump, changeset_lookup, vertex_agreements, segment_runs, region_replacement)}

_ORDER_STEPS = """v as (select l_orderkey, l_linenumber k, l_quantity::double x, (l_partkey % 97)::double y from lineitem),
w as (select *, lead(x) over o bx, lead(y) over o as by_, row_number() over o i from v window o as (partition by l_orderkey order by k, x, y)),
s as (select *, coalesce(sqrt((bx - x) * (bx - x) + (by_ - y) * (by_ - y)), 0) len from w),
t as (select *, sum(len) over (partition by l_orderkey order by i) - len as before, sum(len) over (partition by l_orderkey) as whole, count(*) over (partition by l_orderkey) as m from s)"""

NETWORK_ORACLES: dict[str, str] = {
    "equivalent_kerbs": """with p as (select o_orderpriority f, (o_custkey % 90)::varchar v, max(o_orderkey) % 2 c from orders group by all),
s as (select v, string_agg(f || ':' || c, ';' order by f) costs, count(*) n from p group by v)
select string_agg(v, ',' order by v) as values, any_value(n) as profiles from s group by costs""",
    "link_cardinality_whole": """with p as (select distinct l_orderkey a, l_partkey b from lineitem),
c as (select *, count(*) over (partition by a) na, count(*) over (partition by b) nb from p)
select case when na = 1 and nb = 1 then '1:1' when nb = 1 then '1:N' when na = 1 then 'N:1' else 'N:M' end cardinality, count(*) links from c group by all""",
    "as_of_value_whole": """with f as (select user_id, ts, max(event_type) event_type from events group by all), a as (select event_id, user_id, ts + interval 1 hour as at from events)
select event_id, event_type from a asof left join f on a.user_id = f.user_id and a.at >= f.ts""",
    "trigram_similarity_whole": """with p as (select p_partkey, lower(p_name) as name from part),
g as (select p_partkey, list_distinct(flatten(list_transform(list_filter(string_split(name, ' '), lambda w: w <> ''), lambda w: list_transform(range(1, (length(w) + 2)::bigint), lambda i: substr('  ' || w || ' ', i, 3))))) g from p),
s as (select q.p_partkey query, g.p_partkey, len(list_intersect(q.g, g.g)) / len(list_distinct(q.g || g.g)) s from g, g q where q.p_partkey % 100 = 0 and q.p_partkey <> g.p_partkey)
select query, p_partkey, round(s, 6) similarity from (select *, row_number() over (partition by query order by s desc, p_partkey) i from s) where i = 1""",
    "grid_knn_whole": """with p as (select vec_id, round(embedding[1]::double, 4) x, round(embedding[2]::double, 4) y from embeddings),
d as (select a.vec_id, b.vec_id target, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) d from p a, p b where a.vec_id <> b.vec_id)
select vec_id, target, round(d, 6) d, rank from (select *, row_number() over (partition by vec_id order by round(d, 12), target) rank from d where d <= 0.05) where rank <= 3""",
    "review_queue": """with recursive c as (
  select 'dear' stratum, 0 s, o_orderkey record, o_totalprice score from orders where o_totalprice > 300000
  union all select 'open', 1, o_orderkey, o_totalprice from orders where o_orderstatus = 'O'
  union all select 'urgent', 2, o_orderkey, o_totalprice from orders where o_orderpriority like '1%'
),
best as (select * from c qualify row_number() over (partition by s order by score desc, record) <= 40),
lists as (select s, any_value(stratum) stratum, list(record order by score desc, record) records from best group by s),
turn(step, taken, stratum, record) as (
  select 0, []::bigint[], null::varchar, null::bigint
  union all
  select step + 1, case when picked is null then taken else list_append(taken, picked) end, stratum_, picked from (
    select t.step, t.taken, l.stratum stratum_, list_filter(l.records, lambda r: not list_contains(t.taken, r))[1] picked from turn t join lists l on l.s = t.step % 3 where t.step < 24
  )
)
select row_number() over (order by step) as place, stratum, record from turn where record is not null""",
    "vertex_agreements": f"""with {_ORDER_STEPS},
mv as (select l_orderkey, i, x + 0.5 + case when (l_orderkey + i - 1) % 4 = 0 then 1.75 else 0 end x, y - 0.25 + (l_orderkey + i - 1) % 3 * 0.125 y from t where m >= 2),
ms as (select *, lead(x) over (partition by l_orderkey order by i) bx, lead(y) over (partition by l_orderkey order by i) as by_ from mv),
pr as (
  select t.l_orderkey, t.i, min(sqrt((t.x - ms.x - u * (ms.bx - ms.x)) ** 2 + (t.y - ms.y - u * (ms.by_ - ms.y)) ** 2)) d
  from (select l_orderkey, i, x, y from t where m >= 2) t join (select * from ms where bx is not null) ms on ms.l_orderkey = t.l_orderkey,
    lateral (select coalesce(least(1.0, greatest(0.0, ((t.x - ms.x) * (ms.bx - ms.x) + (t.y - ms.y) * (ms.by_ - ms.y)) / nullif((ms.bx - ms.x) ** 2 + (ms.by_ - ms.y) ** 2, 0))), 0.0) u)
  group by t.l_orderkey, t.i
),
near as (select t.l_orderkey, t.i, t.x, t.y from t join pr using (l_orderkey, i) where d <= 3),
off as (
  select near.l_orderkey, near.i, mv.x - near.x dx, mv.y - near.y dy, sqrt((mv.x - near.x) ** 2 + (mv.y - near.y) ** 2) d from near join mv using (l_orderkey)
  qualify row_number() over (partition by near.l_orderkey, near.i order by sqrt((mv.x - near.x) ** 2 + (mv.y - near.y) ** 2), mv.i) = 1
),
p as (select *, median(dx) over (partition by l_orderkey) mx, median(dy) over (partition by l_orderkey) my from off where d <= 2)
select o.l_orderkey, coalesce(n.near, 0) as near, coalesce(q.paired, 0) as paired, round(q.median_m, 6) as median_m, round(q.spread_m, 6) as spread_m
from (select distinct l_orderkey from t where m >= 2) o left join (select l_orderkey, count(*) near from near group by 1) n using (l_orderkey)
  left join (select l_orderkey, count(*) paired, median(d) median_m, median(sqrt((dx - mx) ** 2 + (dy - my) ** 2)) spread_m from p group by 1) q using (l_orderkey)""",
    "segment_runs": """with w as (select l_orderkey way_id, list(l_partkey % 5 order by l_linenumber, l_partkey) refs from lineitem group by 1),
s as (select way_id, refs, case when way_id % 2 = 0 then refs[2:4] else list_reverse(refs[2:4]) end seg from w where len(refs) >= 3),
r as (select way_id, refs, seg, false reversed from s union all select way_id, refs, list_reverse(seg), true from s where list_reverse(seg) <> seg)
select 's' || way_id as segment_id, way_id, place, reversed from r, unnest(range(len(refs))) as p(place) where place + len(seg) <= len(refs) and refs[place + 1:place + len(seg)] = seg""",
    "region_replacement": """select c_custkey, c_nationkey as region, case when n_regionkey = 2 then 'second' else 'first' end as edition
from customer join nation on n_nationkey = c_nationkey where n_regionkey <> 2 or c_custkey % 3 <> 0""",
    "changeset_dump": "select event_id as id, ts as created_at, user_id as num_changes, event_type as comment, props as source, false as named from events",
    "changeset_lookup": "select distinct event_id as id, user_id as num_changes, event_type as comment from events join orders on event_id = o_orderkey * 3",
    "part_routes": """with recursive side as (select floor(sqrt(count(*)))::bigint s from part),
p as (select p_partkey n, p_size from part, side where p_partkey < s * s),
f as (select n a, n + 1 b, 50.0 + p_size w from p, side where n % s < s - 1 union all select n, n + s, 50.0 + p_size from p, side where n < s * (s - 1)),
e as (select a, b, w::double w from f union all select b, a, w::double from f),
asked as (select 'r' || n request, n origin, n * 7 % (s * s) destination from p, side where n % 100 = 0),
best(request, node, cost, hops) using key (request, node) as (
  select request, origin, 0.0::double, 0 from asked
  union
  select x.request, x.node, x.cost, x.hops from (
    select b.request, e.b as node, b.cost + e.w as cost, b.hops + 1 as hops, row_number() over (partition by b.request, e.b order by b.cost + e.w, b.hops + 1) as nth
    from best b join e on e.a = b.node
  ) x left join recurring.best r on r.request = x.request and r.node = x.node
  where x.nth = 1 and (r.cost is null or x.cost < r.cost or (x.cost = r.cost and x.hops < r.hops))
)
select a.request, a.origin, a.destination, round(b.cost, 4) as cost, b.hops as segments from asked a left join best b on b.request = a.request and b.node = a.destination""",
    "coordinate_routes": """with recursive side as (select floor(sqrt(count(*)))::bigint s from part),
p as (select p_partkey n, p_size z, p_partkey % s c, p_partkey // s r, s, p_partkey % s * 50.0::double x, p_partkey // s * 50.0::double y, (p_size % 7 - 3) * 2.0::double bend from part, side where p_partkey < s * s),
g as (
  select 'h' || n id, n src, n + 1 dst, z % 10 <> 0 back, false stairs, z % 4 = 0 rough, x ax, y ay, x + 25 mx, y + bend my, x + 50 bx, y as by_, 2 * sqrt(625 + bend * bend) len from p where c < s - 1
  union all
  select 'v' || n, n, n + s, true, c % 3 = 1 and z % 2 = 0, z % 4 = 0, x, y, x + bend, y + 25, x, y + 50, 2 * sqrt(625 + bend * bend) from p where r < s - 1
),
k as (select profile, g.*, case when profile = 'standard' then len when not stairs then len * case when rough then 13 else 1 end end w from g, (values ('standard'), ('wheelchair')) f(profile)),
e as (select profile, src a, dst b, w, len from k where w is not null union all select profile, dst, src, w, len from k where w is not null and back),
q as (
  select 'q' || n request, case when n // 100 % 2 = 0 then 'standard' else 'wheelchair' end profile,
    case when z % 17 = 0 then -400 else c * 50.0 + z % 11 * 4.0 - 20.5 end::double ox, (r * 50.0 + n % 13 * 3.0 - 18.75)::double oy,
    case when n % 1300 = 700 then 20000 else n * 7 % (s * s) % s * 50.0 + n // 100 % 9 * 5.0 - 20.25 end::double dx, (n * 7 % (s * s) // s * 50.0 + n // 100 % 5 * 6.0 - 12.125)::double dy
  from p where n % 100 = 0
),
ends as (
  select request, profile, 'o' as side, ox x, oy y from q where sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) <= 15000
  union all select request, profile, 'd', dx, dy from q where sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) <= 15000
),
halves as (select profile, id, 0 as half, ax, ay, mx bx, my as by_ from k where w is not null union all select profile, id, 1, mx, my, bx, by_ from k where w is not null),
near as (
  select ends.request, ends.side, h.id, half, x, y, ax, ay, bx, by_,
    least(1.0, greatest(0.0, ((x - ax) * (bx - ax) + (y - ay) * (by_ - ay)) / ((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay)))) t
  from ends join halves h on h.profile = ends.profile and h.ax between x - 260 and x + 260 and h.ay between y - 260 and y + 260
),
dist as (select *, sqrt((x - ax - t * (bx - ax)) * (x - ax - t * (bx - ax)) + (y - ay - t * (by_ - ay)) * (y - ay - t * (by_ - ay))) d from near),
snap as (select request, side, id, (half + t) / 2 f, d from dist where d <= 150 qualify row_number() over (partition by request, side order by d, id, half) = 1),
j as (
  select q.request, q.profile, o.id oid, o.f fo, o.d od, d.id did, d.f fd, d.d dd, ko.src osrc, ko.dst odst, ko.w ow, ko.back oback, ko.len olen, kd.src dsrc, kd.dst ddst, kd.w dw, kd.back dback, kd.len dlen
  from q join snap o on o.request = q.request and o.side = 'o' join snap d on d.request = q.request and d.side = 'd'
    join k ko on ko.profile = q.profile and ko.id = o.id join k kd on kd.profile = q.profile and kd.id = d.id
),
starts as (
  select request, profile, osrc node, 0.0::double cost, 0.0::double len from j where fo <= 1e-9
  union all select request, profile, odst, 0, 0 from j where fo >= 1 - 1e-9
  union all select request, profile, odst, (1 - fo) * ow, (1 - fo) * olen from j where fo > 1e-9 and fo < 1 - 1e-9
  union all select request, profile, osrc, fo * ow, fo * olen from j where fo > 1e-9 and fo < 1 - 1e-9 and oback
),
goals as (
  select request, dsrc node, 0.0::double cost, 0.0::double len from j where fd <= 1e-9
  union all select request, ddst, 0, 0 from j where fd >= 1 - 1e-9
  union all select request, dsrc, fd * dw, fd * dlen from j where fd > 1e-9 and fd < 1 - 1e-9
  union all select request, ddst, (1 - fd) * dw, (1 - fd) * dlen from j where fd > 1e-9 and fd < 1 - 1e-9 and dback
),
best(request, profile, node, cost, len) using key (request, node) as (
  select request, profile, node, cost, len from starts
  union
  select x.request, x.profile, x.node, x.cost, x.len from (
    select b.request, b.profile, e.b as node, b.cost + e.w as cost, b.len + e.len as len, row_number() over (partition by b.request, e.b order by b.cost + e.w) as nth
    from best b join e on e.profile = b.profile and e.a = b.node
  ) x left join recurring.best r on r.request = x.request and r.node = x.node where x.nth = 1 and (r.cost is null or x.cost < r.cost)
),
ways as (
  select b.request, b.cost + g.cost as cost, b.len + g.len as len from best b join goals g on g.request = b.request and g.node = b.node
  union all select request, (fd - fo) * ow, (fd - fo) * olen from j where oid = did and fd > fo and fo > 1e-9 and fd < 1 - 1e-9
  union all select request, (fo - fd) * ow, (fo - fd) * olen from j where oid = did and fd < fo and oback and fd > 1e-9 and fo < 1 - 1e-9
),
won as (select request, min(cost) as cost, arg_min(len, cost) as len from ways group by request)
select q.request, q.profile,
  case when sqrt((ox - dx) * (ox - dx) + (oy - dy) * (oy - dy)) > 15000 then 'too_far' when j.request is null then 'off_network' when w.cost is not null then 'route' else 'no_route' end as outcome,
  round(w.cost, 4) as cost, round(w.len, 4) as distance_m, round(j.od, 4) as origin_d, round(j.dd, 4) as destination_d
from q left join j using (request) left join won w using (request)""",
    "line_projections": f"""with {_ORDER_STEPS},
o as (select o_orderkey, o_custkey % 50 + 0.3::double px, o_custkey % 83 + 0.7::double py from orders),
a as (
  select t.l_orderkey, i, x, y, bx, by_, before, whole, len, px, py,
    coalesce(least(1.0, greatest(0.0, ((px - x) * (bx - x) + (py - y) * (by_ - y)) / nullif((bx - x) * (bx - x) + (by_ - y) * (by_ - y), 0))), 0.0) u
  from t join o on o_orderkey = t.l_orderkey where bx is not null or m = 1
),
n as (
  select l_orderkey, i, sqrt((px - x - u * (coalesce(bx, x) - x)) ** 2 + (py - y - u * (coalesce(by_, y) - y)) ** 2) d, case when whole > 0 then least(1.0, (before + u * len) / whole) else 0.0 end fraction,
    x + u * (coalesce(bx, x) - x) fx, y + u * (coalesce(by_, y) - y) fy from a
)
select l_orderkey, round(d, 6) as d, round(fraction, 6) as fraction, round(fx, 5) as x, round(fy, 5) as y from n
qualify row_number() over (partition by l_orderkey order by round(d, 9), fraction) = 1""",
    "line_cuts": f"""with {_ORDER_STEPS},
c as (select distinct l_orderkey, whole, (l_orderkey % 10) / 20 lo, 0.5 + (l_orderkey % 7) / 14 hi from t where whole > 0),
p as (select l_orderkey, whole, unnest([0, 1, 2]) piece, unnest([0.0::double, lo, hi]) a, unnest([lo, hi, 1.0::double]) b from c),
inner_ as (select p.l_orderkey, piece, count(*) n from p join t on t.l_orderkey = p.l_orderkey and t.before > a * p.whole + 1e-9 * p.whole and t.before < b * p.whole - 1e-9 * p.whole group by all),
first_ as (
  select p.l_orderkey, piece, x + coalesce((a * p.whole - before) / nullif(len, 0), 0) * (bx - x) fx, y + coalesce((a * p.whole - before) / nullif(len, 0), 0) * (by_ - y) fy
  from p join t on t.l_orderkey = p.l_orderkey and t.bx is not null and (t.before <= a * p.whole or t.i = 1) qualify row_number() over (partition by p.l_orderkey, piece order by i desc) = 1
)
select p.l_orderkey, piece::bigint as piece, (2 + coalesce(n, 0))::bigint as vertices, round((b - a) * whole, 5) as length, round(100 * (b - a), 5) as share, round(fx, 5) as x, round(fy, 5) as y
from p left join inner_ using (l_orderkey, piece) join first_ using (l_orderkey, piece)""",
}
