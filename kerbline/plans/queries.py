"""Named queries over the test tables, one or more for each family of operators."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F, types as T

from .. import schemas
from ..functions import cost, fields, geo, tags, text
from ..operators import aggregates, conflate, graph, joins, places, spatial, stats, windows
from ..sources.network import segments
from ..sources.tables import TABLES, table
from ..streaming import events as streams
from .area_queries import AREA_QUERIES
from .extract_queries import EXTRACT_QUERIES
from .network_queries import NETWORK_QUERIES
from .profile_queries import PROFILE_QUERIES
from .rule_queries import RULE_QUERIES
from .study_queries import STUDY_QUERIES

Query = Callable[[SparkSession, str], DataFrame]


# A street network on the nations: a ring and chords of five, with attributes from the key.
def nation_segments(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    nation = table(spark, sf, "nation")
    ring = nation.select(F.concat(F.lit("r"), n).alias("segment_id"), n.alias("src"), ((n + 1) % 25).alias("dst"), (100.0 + 10 * (n % 7)).alias("length_m"), F.lit("no").alias("steps"), F.when(n % 3 == 0, "rough").otherwise("paved").alias("surface_class"), ((n % 9) - 4).cast("double").alias("effective_grade"), (n % 5 == 2).alias("is_crossing"))
    chord = nation.select(F.concat(F.lit("c"), n).alias("segment_id"), n.alias("src"), ((n + 5) % 25).alias("dst"), (260.0 + 15 * (n % 5)).alias("length_m"), F.when(n % 4 == 0, "yes").otherwise("no").alias("steps"), F.when(n % 2 == 1, "compacted").otherwise("paved").alias("surface_class"), F.lit(0.0).alias("effective_grade"), F.lit(False).alias("is_crossing"))
    same = {"foot_access": "yes", "general_access": "yes", "smoothness_class": "good", "kerb": "raised", "crossing_type": "unmarked"}
    rows = ring.unionByName(chord).withColumns({k: F.lit(v) for k, v in same.items()})
    return rows.withColumns({"step_count": F.lit(None).cast("int"), "width_m": F.lit(1.5), "unit_share": F.lit(1.0), "foot_forward": F.lit(True), "foot_backward": F.lit(True), "conveying": F.lit("none")})


def nation_edges(spark: SparkSession, rows: DataFrame) -> DataFrame:
    return cost.with_cost(graph.directed(rows), cost.profiles(spark, ("standard", "wheelchair")))


def nation_costs(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """(origin, destination, profile, cost) of all pairs: one request for each origin and profile."""
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("origin")).crossJoin(F.broadcast(cost.profiles(spark, ("standard", "wheelchair")).select("profile")))
    asked = asked.withColumn("request", F.concat_ws(":", "profile", "origin"))
    found = graph.shortest_paths(nation_edges(spark, rows), asked)
    return found.join(asked.select("request", "origin"), "request").select("origin", F.col("node").alias("destination"), "profile", "cost", "hops", "path")


def route_compare(spark: SparkSession, sf: str) -> DataFrame:
    found = nation_costs(spark, sf, nation_segments(spark, sf)).filter("origin < destination")
    return graph.compared(found).select("origin", "destination", F.round("base_cost", 4).alias("standard_cost"), F.round("cost", 4).alias("wheelchair_cost"), F.round(F.col("cost") - F.col("base_cost"), 4).alias("extra"))


def counterfactual_routes(spark: SparkSession, sf: str) -> DataFrame:
    rows = nation_segments(spark, sf)
    ramps = rows.filter("steps = 'yes'").select("segment_id", F.lit("no").alias("steps"))
    keys = ["origin", "destination", "profile"]
    before = nation_costs(spark, sf, rows).filter("origin < destination")
    after = nation_costs(spark, sf, graph.substituted(rows, ramps, ["steps"])).select(*keys, F.col("cost").alias("new_cost"))
    both = before.join(after, keys).withColumn("saved", F.round(F.col("cost") - F.col("new_cost"), 4))
    return both.filter("saved > 0").select(*keys, "saved")


def part_grid(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, points, requests) of a street grid on the parts, whose side grows with their number; sizes make the costs."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), "p_size")
    side = math.isqrt(part.count())
    part = part.filter(F.col("node") < side * side)
    points = part.select("node", (F.col("node") % side * 50.0).alias("x"), (F.floor(F.col("node") / side) * 50.0).alias("y"))
    n, ends = F.col("node"), F.explode(F.array(F.when(F.col("node") % side < side - 1, F.col("node") + 1), F.when(F.col("node") < side * (side - 1), F.col("node") + side))).alias("dst")
    ahead = part.select(n.alias("src"), ends, (50.0 + F.col("p_size")).alias("cost")).filter("dst is not null")
    both = ahead.union(ahead.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "cost"))
    edges = both.select(F.lit("standard").alias("profile"), "src", "dst", F.concat_ws("-", "src", "dst").alias("segment_id"), "cost")
    asked = part.filter("node % 100 = 0").select(F.concat(F.lit("r"), n).alias("request"), F.lit("standard").alias("profile"), n.alias("origin"), (n * 7 % (side * side)).alias("destination"))
    return edges, points, asked


def part_routes(spark: SparkSession, sf: str) -> DataFrame:
    edges, points, asked = part_grid(spark, sf)
    found = graph.routes(edges, asked, cells=graph.even_cells(points), points=points)
    return found.select("request", "origin", "destination", F.round("cost", 4).alias("cost"), F.size("path").alias("segments"))


def itemised_cost(spark: SparkSession, sf: str) -> DataFrame:
    flag = F.col("l_returnflag")
    rows = table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("length_m"), F.lit("yes").alias("foot_access"), F.lit("yes").alias("general_access"), F.when(flag == "R", "yes").otherwise("no").alias("steps"),
        F.col("l_linenumber").alias("step_count"), F.when(flag == "A", "rough").when(flag == "N", "compacted").otherwise("paved").alias("surface_class"), F.when(F.col("l_linestatus") == "F", "bad").otherwise("good").alias("smoothness_class"),
        (F.col("l_discount") * 100).alias("effective_grade"), F.lit(0.8).alias("width_m"), (F.col("l_linestatus") == "O").alias("is_crossing"), F.lit("raised").alias("kerb"), F.lit("marked").alias("crossing_type"), F.lit(1.0).alias("unit_share"),
    )
    costed = cost.with_cost(rows, cost.profiles(spark, ("standard", "crutches", "wheelchair")))
    parts = [F.round(F.sum(F.when(F.col("blocked").isNull(), F.col(f"cost_{k}"))), 2).alias(k) for k in ("distance", "surface", "smoothness", "incline", "width", "steps", "kerb", "crossing")]
    return costed.groupBy("profile").agg(F.count("*").alias("n"), F.count("blocked").alias("blocked"), *parts)


def coverage_by_class(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.class_coverage(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])


def conditional_sums(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem")
    late = F.col("l_discount") > 0.05
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_if(late).alias("n_discounted"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum(F.when(late, F.col("l_quantity"))), 2).alias("quantity_discounted"), F.count_distinct("l_suppkey").alias("suppliers"))


def plausibility_rules(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"large": F.col("l_quantity") > 45, "free": F.col("l_discount") >= 0.1, "untaxed": F.col("l_tax") == 0, "odd_line": F.col("l_linenumber") % 2 == 1}
    return aggregates.rule_counts(table(spark, sf, "lineitem"), rules)


def value_counts_topn(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.value_counts(table(spark, sf, "part"), "p_brand", top=5)


def quantile_profile(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders")
    ranks = aggregates.nearest_rank(rows, ["o_orderpriority"], "o_totalprice", [0.5, 0.95])
    smooth = rows.groupBy("o_orderpriority").agg(F.round(F.expr("percentile_cont(0.5) within group (order by o_totalprice)"), 4).alias("median"), F.round(F.avg("o_totalprice"), 4).alias("mean"))
    return ranks.join(smooth, "o_orderpriority").select("o_orderpriority", F.round("p50", 4).alias("p50"), F.round("p95", 4).alias("p95"), "median", "mean")


def modal_with_ties(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), "o_custkey")
    return aggregates.modal(rows, ["c_mktsegment", "c_nationkey"], "o_orderpriority")


def multi_key_rollup(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.rollup("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n"))


def semi_anti_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return joins.consistency(table(spark, sf, "customer").select((F.col("c_custkey") - 20).alias("id")), table(spark, sf, "orders").select(F.col("o_custkey").alias("id")), "id")


def outer_publication_join(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("left_value"))
    right = table(spark, sf, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("right_value"))
    return joins.publication_join(left, right, "id").select("id", "left_value", "right_value", "side")


def outcome_differences(spark: SparkSession, sf: str) -> DataFrame:
    before = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    after = before.withColumns({"c_nationkey": F.when(F.col("c_custkey") % 50 == 0, None).otherwise(F.col("c_nationkey")), "c_mktsegment": F.when(F.col("c_custkey") % 35 == 0, "OTHER").otherwise(F.col("c_mktsegment"))})
    return joins.differences(after, before, ["c_custkey"], ["c_mktsegment", "c_nationkey"])


def _cardinality(links: DataFrame) -> DataFrame:
    return joins.cardinality(links.select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey").groupBy("cardinality").agg(F.count("*").alias("links"))


def link_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    return _cardinality(table(spark, sf, "lineitem").filter("l_quantity >= 49"))


def link_cardinality_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _cardinality(table(spark, sf, "lineitem"))


def _as_of(spark: SparkSession, sf: str, asked: DataFrame) -> DataFrame:
    seen = table(spark, sf, "events").groupBy("user_id", "ts").agg(F.max("event_type").alias("event_type"))
    asked = asked.select("event_id", "user_id", (F.col("ts") + F.expr("interval 1 hour")).alias("at"))
    return joins.as_of(asked, seen, "user_id", "at", "event_type", "ts").select("event_id", "event_type")


def as_of_value(spark: SparkSession, sf: str) -> DataFrame:
    return _as_of(spark, sf, table(spark, sf, "events").filter("event_id % 10 = 0"))


def as_of_value_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _as_of(spark, sf, table(spark, sf, "events"))


def first_rule_stratum(spark: SparkSession, sf: str) -> DataFrame:
    rules = {"large": F.col("p_size") > 40, "dear": F.col("p_retailprice") > 1500, "small": F.col("p_size") < 10}
    return table(spark, sf, "part").withColumn("stratum", fields.first_rule(rules, "rest")).groupBy("stratum").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first"))


def field_states(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left")
    state = fields.field_state(F.col("quality"), F.col("lang") != "es", default="0", domain=("0", "1"))
    return rows.withColumn("state", state).groupBy("lang", "state").agg(F.count("*").alias("n"))


def worst_of_rank(spark: SparkSession, sf: str) -> DataFrame:
    flags = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("raw"))
    return flags.select("l_orderkey", tags.worst_of(F.col("raw"), ("n", "a", "r")).alias("worst"), tags.is_conflicted(F.col("raw")).alias("conflicted"))


def text_normalise(spark: SparkSession, sf: str) -> DataFrame:
    plain = text.plain_text(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", plain.alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.size(F.split("t", " ")).cast("long").alias("words"))


def _trigram_similarity(spark: SparkSession, sf: str, asked: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("place_id"), F.lower("p_name").alias("search_text"))
    best = places.most_similar(p.filter(asked).select(F.col("place_id").alias("query_id"), F.col("search_text").alias("text")), p)
    return best.select(F.col("query_id").alias("query"), F.col("place_id").alias("p_partkey"), F.round("similarity", 6).alias("similarity"))


def trigram_similarity(spark: SparkSession, sf: str) -> DataFrame:
    return _trigram_similarity(spark, sf, "place_id <= 5")


def trigram_similarity_whole(spark: SparkSession, sf: str) -> DataFrame:
    return _trigram_similarity(spark, sf, "place_id % 100 = 0")


def ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    index = p.select(F.col("p_partkey").alias("place_id"), F.lit("place").alias("kind"), F.col("p_name").alias("label"), F.col("p_type").alias("category"), text.normalise(F.col("p_name")).alias("search_text"), F.array(F.lower(F.regexp_replace("p_brand", "[^0-9A-Za-z]", ""))).alias("codes"), F.array().cast("array<string>").alias("initialisms"))
    asked = p.filter("p_partkey % 20 = 1 or p_partkey % 100 = 0").select(F.col("p_partkey").alias("query_id"), F.expr("case p_partkey % 3 when 0 then p_name when 1 then substr(p_name, 1, 6) else reverse(p_name) end").alias("q"))
    typed = text.compact(F.col("q"))
    return places.search(asked.select("query_id", text.normalise(F.col("q")).alias("text"), typed.alias("code")).filter("text != ''"), index)


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", F.round(F.col("embedding")[0].cast("double"), 4).alias("x"), F.round(F.col("embedding")[1].cast("double"), 4).alias("y"))


def dedupe_grid(spark: SparkSession, sf: str) -> DataFrame:
    rows = _points(spark, sf).withColumns({"cx": F.floor(F.col("x") / 0.05), "cy": F.floor(F.col("y") / 0.05)})
    return aggregates.best_of(rows, ["cx", "cy"], [F.col("label"), F.col("vec_id")]).select("cx", "cy", "vec_id", "label")


def grid_knn(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    near = spatial.nearest(p.filter("vec_id % 10 = 0").select("vec_id", "x", "y"), p.filter("vec_id % 10 != 0").select(F.col("vec_id").alias("target"), "x", "y"), 0.05, "vec_id", "target", k=3)
    return near.select("vec_id", "target", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


def grid_knn_whole(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf).select("vec_id", "x", "y")
    # A point is among its own nearest, or so many others are at no distance that it doesn't matter: one more is taken and it is left out.
    near = spatial.nearest(p, p.withColumnRenamed("vec_id", "target"), 0.05, "vec_id", "target", k=4).filter("vec_id != target")
    w = W.partitionBy("vec_id").orderBy("rank")
    near = near.withColumn("rank", F.row_number().over(w)).filter("rank <= 3")
    return near.select("vec_id", "target", F.round("d", 6).alias("d"), F.col("rank").cast("long").alias("rank"))


def dwithin_counts(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.density(_points(spark, sf).select("vec_id", "x", "y"), 0.03, "vec_id")


def directed_hausdorff(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    out = spatial.directed_hausdorff(p.filter("vec_id % 2 = 0").select("vec_id", "label", "x", "y"), p.filter("vec_id % 2 = 1").select(F.col("vec_id").alias("target"), "x", "y"), "label", 0.2, "vec_id", "target")
    return out.select("label", F.round("offset", 6).alias("offset"))


def interval_merge(spark: SparkSession, sf: str) -> DataFrame:
    lo = F.unix_timestamp("ts")
    rows = table(spark, sf, "events").select("user_id", lo.alias("lo"), (lo + F.col("event_id") % 97 * 3600).alias("hi"))
    return windows.merged_length(rows, "user_id", "lo", "hi").select("user_id", "covered", F.col("pieces").cast("long").alias("pieces"))


def interval_overlap_share(spark: SparkSession, sf: str) -> DataFrame:
    day = F.datediff("o_orderdate", F.lit("1970-01-01"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", day.alias("d"))
    urgent = F.col("o_orderpriority").startswith("1")
    left = rows.filter(urgent).select("o_custkey", "o_orderkey", F.col("d").alias("lo"), (F.col("d") + 90).alias("hi"))
    right = rows.filter(~urgent).select("o_custkey", F.col("o_orderkey").alias("other"), F.col("d").alias("rlo"), (F.col("d") + 60).alias("rhi"))
    return spatial.overlaps(left, right, ["o_custkey"], 128).select("o_orderkey", "other", F.col("overlap").cast("long").alias("overlap"))


def island_traversals(spark: SparkSession, sf: str) -> DataFrame:
    runs = windows.traversals(table(spark, sf, "events"), "user_id", ["event_id"], "event_type")
    return runs.select("user_id", F.col("traversal").cast("long").alias("traversal"), "event_type", "first", "last", "n")


def cumulative_position(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return windows.cumulative(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "q"], "q").select("l_orderkey", "l_linenumber", "from_m", "to_m")


def value_introduced(spark: SparkSession, sf: str) -> DataFrame:
    return windows.value_introduced(table(spark, sf, "events"), "user_id", "event_id", "event_type")


def unit_share(spark: SparkSession, sf: str) -> DataFrame:
    rows = aggregates.shares(table(spark, sf, "lineitem"), "l_orderkey", "l_quantity")
    return rows.select("l_orderkey", "l_linenumber", F.round("unit_share", 6).alias("unit_share"))


def way_segments(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "part").filter("p_size > 3").select(F.col("p_partkey").alias("node_id"), (F.col("p_partkey") % 100 * 0.001).alias("lon"), (F.col("p_partkey") % 37 * 0.001).alias("lat"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda r: r["l_partkey"])
    ways = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("way_id")).agg(lines.alias("refs")).withColumn("tags", F.create_map(F.lit("highway"), F.lit("path")))
    return segments(nodes, ways).groupBy("way_id").agg(F.count("*").alias("n"), F.round(F.sum("length_m"), 1).alias("length_m"), F.min("pair").cast("long").alias("first_pair"))


def _links(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    top = p.agg(F.max("p_partkey").alias("top"))
    return p.filter("p_size <= 20").crossJoin(F.broadcast(top)).select(F.col("p_partkey").alias("src"), (F.col("p_partkey") * 7 % F.col("top") + 1).alias("dst"))


def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return graph.connected_parts(_links(spark, sf)).select("node", "root")


def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    parts = graph.numbered_parts(graph.connected_parts(_links(spark, sf)))
    return parts.groupBy(F.col("part").cast("long").alias("part")).agg(F.max("size").alias("size"), F.min("node").alias("first_node"))


def content_hash_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").select("n_nationkey", F.sha2(F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey"), 256).alias("row_sha256"))


def content_hash_table(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.content_hash(table(spark, sf, "customer"), ["c_custkey"], ["c_name", "c_nationkey", "c_mktsegment"])


def stratified_hash_sample(spark: SparkSession, sf: str) -> DataFrame:
    return stats.hash_draw(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id", 10, "s1").select("lang", "doc_id", F.col("draw").cast("long").alias("draw"))


def sample_allocation(spark: SparkSession, sf: str) -> DataFrame:
    sizes = table(spark, sf, "documents").groupBy(F.col("source").alias("stratum")).agg(F.count("*").alias("n"))
    return stats.allocated(sizes, 60, 2).select("stratum", "n", F.col("take").cast("long").alias("take"))


def wilson_prf(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "labels").agg(*(F.count_if((F.col("quality") == q) & (F.col("toxic") == t)).alias(k) for k, q, t in (("tp", 1, 1), ("fp", 1, 0), ("fn", 0, 1))))
    w, p = stats.wilson(F.col("tp"), F.col("tp") + F.col("fp")), stats.precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))
    return c.withColumns({"w": w, "p": p}).select("tp", "fp", "fn", F.round("w.low", 6).alias("low"), F.round("w.high", 6).alias("high"), F.round("p.precision", 6).alias("precision"), F.round("p.recall", 6).alias("recall"), F.round("p.f1", 6).alias("f1"))


def confusion_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return stats.confusion(table(spark, sf, "labels"), "quality", "toxic")


def grid_tune(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")
    grid = spark.range(1, 11).select((F.col("id") * 200).alias("least"))
    out = stats.tuned(rows, grid, F.col("n_chars") >= F.col("least"), F.col("quality") == 1, ["least"])
    return out.select("least", "tp", "fp", "fn", F.round("f1", 6).alias("f1"), "best")


def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    guess, truth = F.col("toxic") == 0, F.col("quality") == 1
    rows = table(spark, sf, "labels").select("doc_id", *(c.cast("int").alias(k) for k, c in (("tp", guess & truth), ("fp", guess & ~truth), ("fn", ~guess & truth))))
    return stats.bootstrap(rows, "doc_id").select("measure", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))


def set_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("truth"), F.collect_set(F.when(F.col("l_discount") > 0.04, F.col("l_linenumber"))).alias("guess"))
    return rows.select(stats.pair_counts(F.col("truth"), F.col("guess")).alias("r")).groupBy("r.outcome").agg(F.count("*").alias("n"), F.sum("r.tp").alias("tp"), F.sum("r.fp").alias("fp"), F.sum("r.fn").alias("fn"))


def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    wanted = T.StructType([T.StructField("n_nationkey", T.LongType()), T.StructField("n_name", T.StringType()), T.StructField("n_population", T.LongType())])
    return schemas.check(spark, table(spark, sf, "nation"), wanted)


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    one = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in TABLES]
    out = one[0]
    for other in one[1:]:
        out = out.union(other)
    return out


def conflation(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"))

    def point(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))

    k = F.col("k")
    records = p.select(k.alias("record_id"), F.array(point(F.lit(0), k * 10), point(F.lit(40), k * 10 + k % 6)).alias("line"))
    pieces = p.select(k.alias("way_id"), F.lit(0.0).alias("ax"), (k * 10.0 + 1).alias("ay"), F.lit(40.0).alias("bx"), (k * 10.0 + 1).alias("by"), F.lit(90.0).alias("bearing"))
    points = conflate.samples(records)
    return conflate.decisions(points, conflate.claims(points, pieces))


def geodesic_check(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    rows = table(spark, sf, "nation").select(n, (n * 3.0 - 40).alias("lon"), (n * 2.0 - 20).alias("lat"))
    flat, true = (f(F.lit(0.0), F.lit(0.0), F.col("lon"), F.col("lat")) for f in (geo.haversine_m, geo.geodesic_m))
    return rows.select("n_nationkey", F.round(flat, 2).alias("haversine_m"), F.round(true, 2).alias("geodesic_m"))


def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windowed(table(spark, sf, "events"), "1 day").select("start", "event_type", "n", "total")


def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    return streams.windowed(table(spark, sf, "events"), "2 days", "1 day").select("start", "event_type", "n")


def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return streams.sessions(table(spark, sf, "events"), "6 hours").select("user_id", "start", "n")


def token_bucket(spark: SparkSession, sf: str) -> DataFrame:
    return streams.rate_limited_batch(table(spark, sf, "events"), 2.0, 1 / 86400).groupBy("admitted").agg(F.count("*").alias("n"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        route_compare, counterfactual_routes, itemised_cost, coverage_by_class, conditional_sums, plausibility_rules, value_counts_topn, quantile_profile, modal_with_ties, multi_key_rollup,
        semi_anti_consistency, outer_publication_join, outcome_differences, link_cardinality, as_of_value, first_rule_stratum, field_states, worst_of_rank, text_normalise, trigram_similarity,
        ranked_search, dedupe_grid, grid_knn, dwithin_counts, directed_hausdorff, interval_merge, interval_overlap_share, island_traversals, cumulative_position, value_introduced, unit_share,
        way_segments, connected_components, component_sizes, content_hash_rows, content_hash_table, stratified_hash_sample, sample_allocation, wilson_prf, confusion_agreement, grid_tune,
        bootstrap_interval, set_outcomes, schema_contract, table_rows, conflation, geodesic_check, tumbling_events, sliding_events, event_sessions, token_bucket,
        part_routes, link_cardinality_whole, as_of_value_whole, trigram_similarity_whole, grid_knn_whole,
    )
} | STUDY_QUERIES | RULE_QUERIES | PROFILE_QUERIES | NETWORK_QUERIES | EXTRACT_QUERIES | AREA_QUERIES
