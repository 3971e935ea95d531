"""Named queries of lineage, linkage, route audits and studies over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import cost
from ..operators import audit, conflate, graph, lineage, linkage, studies
from ..sources.tables import table

SOURCES = {0: "survey", 1: "City of Kitchener open data", 2: "bulk import", 3: "Bing", 4: "Mapillary"}


def _cased(column: Column, values: dict) -> Column:
    out = F.lit(None).cast("string")
    for k, v in values.items():
        out = F.when(column == k, v).otherwise(out)
    return out


def _history(spark: SparkSession, sf: str) -> DataFrame:
    """The events of each user as the edits of an element."""
    return table(spark, sf, "events").withColumn("source", _cased(F.col("event_id") % 7, SOURCES))


def _since(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").filter("user_id % 2 = 0").groupBy("user_id").agg((F.max("ts") - F.expr("interval 3 days")).alias("since"))


def attribute_lineage(spark: SparkSession, sf: str) -> DataFrame:
    edits = lineage.introducing_edits(_history(spark, sf), "user_id", "ts", "event_type", "source")
    found = lineage.decided(edits, "user_id", "ts", _since(spark, sf))
    return edits.select("user_id", "event_type", "event_id", "confirmations").join(found, "user_id")


def shape_lineage(spark: SparkSession, sf: str) -> DataFrame:
    created = (F.col("event_id") % 5 == 0) | (F.col("event_type") == "signup")
    edits = lineage.shaping_edits(_history(spark, sf), "user_id", "ts", created, "source")
    found = lineage.decided(edits, "user_id", "ts", _since(spark, sf), lineage.GEOMETRY_EVIDENCE)
    groups = lineage.least_independent(found.withColumn("record", F.col("user_id") % 40), "record")
    return groups.select("record", "lineage")


def _source_rows(spark: SparkSession, sf: str) -> DataFrame:
    col = F.col
    kind = F.when(col("l_suppkey") % 9 == 0, "x").when(col("l_suppkey") % 5 == 0, "n").otherwise("w")
    rows = table(spark, sf, "lineitem").select(
        col("l_orderkey").alias("segment_id"), F.when(col("l_linenumber") % 6 == 5, "Other").otherwise("OpenStreetMap").alias("dataset"),
        F.concat(kind, col("l_partkey"), F.lit("@"), col("l_suppkey") % 2 + 1).alias("record_id"), F.when(col("l_returnflag") == "A", "/surface").alias("property"),
        F.when(col("l_tax") > 0.02, F.array((col("l_tax") * 5), F.lit(0.3))).alias("between"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("update_time"), "l_linenumber",
    )
    return rows.union(rows.filter("l_linenumber = 1"))


def source_kinds(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.classified_sources(_source_rows(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))


def way_linkage(spark: SparkSession, sf: str) -> DataFrame:
    links = linkage.way_links(linkage.classified_sources(_source_rows(spark, sf)))
    ways = table(spark, sf, "part").select(F.col("p_partkey").alias("way_id"), (F.col("p_size") % 3 + 1).alias("ours"), F.concat(F.lit("199"), F.col("p_size") % 10, F.lit("-06-01T00:00:00Z")).alias("our_time"))
    found = linkage.linked_ways(ways, links)
    status = lineage.version_status(F.col("versions"), F.col("times"), F.col("ours"), F.col("our_time"), F.lit("1996-01-01T00:00:00Z"), F.lit("1998-01-01"), F.lit("1994-01-01T00:00:00Z"))
    status = F.when(F.col("match") == "linked", status)
    return found.select("way_id", "match", "cardinality", "segments", "partial_ranges", status.alias("status"))


def point_linkage(spark: SparkSession, sf: str) -> DataFrame:
    segments = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id")).agg(F.collect_list("l_partkey").alias("point_ids"))
    part = table(spark, sf, "part")
    points = part.filter("p_partkey % 3 != 0").select(F.col("p_partkey").alias("point_id"))
    found = linkage.endpoint_links(segments, points, part.filter("p_size > 25").select(F.col("p_partkey").alias("node_id")))
    return found.groupBy("known", "is_node").agg(F.count("*").alias("n"), F.sum("cited").alias("cited"))


def bridge_rows(spark: SparkSession, sf: str) -> DataFrame:
    status = F.explode(F.array(F.lit("O"), F.lit(None).cast("string"), F.lit("P"))).alias("status")
    bridge = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), status)
    sources = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.nullif(F.col("l_linestatus"), F.lit("F")).alias("status"), F.col("l_returnflag").alias("property"))
    return linkage.bridged(bridge, sources, ["k", "status"]).select("k", "status", "found", F.array_join("properties", ",").alias("properties"))


def source_independence(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linestatus", F.nullif(F.col("l_returnflag"), F.lit("A")).alias("dataset"))
    return linkage.independence(rows, ["l_orderkey", "l_linestatus"]).groupBy("l_linestatus", "shape").agg(F.count("*").alias("n"))


def _pieces(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as the pieces of a route."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("request"), F.lit("standard").alias("profile"), F.col("l_linenumber").alias("ix"), F.col("l_partkey").alias("segment_id"), F.col("l_quantity").alias("length_m"), F.col("l_suppkey").alias("src"),
        (F.col("l_suppkey") % 3).alias("dst"), F.round(F.col("l_discount") * 100 - 5).alias("effective_grade"), F.when(F.col("l_linestatus") == "F", "recorded").when(F.col("l_returnflag") == "N", "derived").otherwise("unknown").alias("grade_source"), "l_returnflag", "l_linestatus",
    )


def route_totals(spark: SparkSession, sf: str) -> DataFrame:
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    out = audit.totals(_pieces(spark, sf), {"rough": flag == "R"}, {"surface": flag != "N", "grade": status == "F"})
    return out.select("request", "pieces", "distance_m", "m_rough", *(F.round(c, 6).alias(c) for c in ("share_surface", "share_grade", "unknown_share")))


def route_gradients(spark: SparkSession, sf: str) -> DataFrame:
    return audit.gradients(_pieces(spark, sf)).drop("profile")


def route_explanations(spark: SparkSession, sf: str) -> DataFrame:
    codes = {"distance": F.col("length_m"), "steps": F.col("ix") * 2, "crossing": F.when(F.col("l_returnflag") == "R", 5).otherwise(0)}
    pieces = _pieces(spark, sf)
    found = audit.explanations(audit.spend(pieces, codes, ["request"]), audit.spend(pieces, codes, ["request"], F.col("ix") <= 2))
    return found.select("request", "code", "theirs", "ours", "saved", F.col("place").cast("long").alias("place"))


def cited_segments(spark: SparkSession, sf: str) -> DataFrame:
    other = _pieces(spark, sf).groupBy("request", "ix").agg(F.min("segment_id").alias("segment_id"))
    chosen = _pieces(spark, sf).filter("l_linestatus = 'O' and l_returnflag = 'N'")
    return audit.cited(other, chosen, F.col("ix") != 2, most=3).select("request", F.array_join("segments", ",").alias("segments"))


def route_findings(spark: SparkSession, sf: str) -> DataFrame:
    pieces = _pieces(spark, sf).groupBy("request", "profile", "ix").agg(F.min("segment_id").alias("segment_id"), F.sum("length_m").alias("length_m"), F.min("src").alias("src"), F.max("dst").alias("dst"), F.max("effective_grade").alias("grade"), F.max("l_returnflag").alias("flag"))
    sums = pieces.groupBy("request", "profile").agg(F.sum("length_m").alias("d"))
    distance = F.col("d") + F.when(F.col("request") % 7 == 0, 1).otherwise(0)
    routes = sums.select("request", "profile", distance.alias("distance_m"), (distance / 2 + F.when(F.col("request") % 10 == 0, 1).otherwise(0)).alias("fastest_s"), distance.alias("slowest_s"), F.lit(1.0).alias("pace_low"), F.lit(2.0).alias("pace_high"))
    return audit.findings(routes, pieces, {"rough": F.col("flag") == "R", "climb": F.col("grade") > 3}).select("request", "check", "n")


def path_digests(spark: SparkSession, sf: str) -> DataFrame:
    return audit.path_digests(_pieces(spark, sf)).select("request", "path_sha256")


def route_changes(spark: SparkSession, sf: str) -> DataFrame:
    def outcomes(pieces: DataFrame) -> DataFrame:
        return audit.path_digests(pieces).join(pieces.groupBy("request", "profile").agg(F.sum("length_m").alias("distance_m")), ["request", "profile"])

    pieces = _pieces(spark, sf)
    found = audit.changes(outcomes(pieces.filter("l_linestatus = 'F' or ix > 1")), outcomes(pieces.filter("l_returnflag != 'R'")))
    return found.groupBy("change").agg(F.count("*").alias("n"), F.sum("detour_m").alias("detour_m"))


def recosted_paths(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("request"), F.lit("p").alias("profile")).agg(F.collect_list(F.col("l_partkey").cast("string")).alias("path"))
    edges = table(spark, sf, "part").select(F.lit("p").alias("profile"), F.col("p_partkey").alias("segment_id"), F.when(F.col("p_size") > 5, F.col("p_size") * 2.0).alias("cost"))
    return graph.recosted(found, edges).select("request", "path_cost", "newly_blocked")


def majority_fill(spark: SparkSession, sf: str) -> DataFrame:
    # Whole quantities, so their sums don't depend on the order.
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.sum("l_quantity").alias("overlap"))
    rows = rows.withColumn("length_m", F.sum("overlap").over(W.partitionBy("l_orderkey")))
    return conflate.majority_value(rows, "l_orderkey", "l_returnflag").select("l_orderkey", "l_returnflag", F.round("share", 6).alias("share"))


def _points(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("point_id"), "label", F.round(F.col("embedding")[0].cast("double"), 4).alias("x"), F.round(F.col("embedding")[1].cast("double"), 4).alias("y"))


def broad_journeys(spark: SparkSession, sf: str) -> DataFrame:
    return studies.broad_journeys(_points(spark, sf).select("point_id", "x", "y"), ((0.0, 0.02), (0.02, 0.05)), 0.1, "s")


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    strata = {"dear": F.col("o_totalprice") > 300000, "open": F.col("o_orderstatus") == "O", "urgent": F.col("o_orderpriority").startswith("1")}
    rows = table(spark, sf, "orders").withColumn("stratum", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in strata.items())))))
    queue = studies.review_queue(rows.select("stratum", F.col("o_orderkey").alias("record"), F.col("o_totalprice").alias("score")), list(strata))
    return spark.createDataFrame(queue, "place long, stratum string, record long")


def gate_funnel(spark: SparkSession, sf: str) -> DataFrame:
    gates = {"sized": F.col("p_size") > 5, "priced": F.col("p_retailprice") < 1500, "typed": F.col("p_type") != "PROMO", "branded": F.col("p_brand").endswith("3")}
    return studies.funnel(table(spark, sf, "part"), gates).select(F.col("stage").cast("long").alias("stage"), "gate", "reached", "dropped")


def record_comparison(spark: SparkSession, sf: str) -> DataFrame:
    ours = studies.asserted(table(spark, sf, "customer"), ["c_custkey"], {"status": F.when(F.col("c_custkey") % 4 != 0, F.when(F.col("c_nationkey") % 2 == 0, "O").otherwise("F")), "parity": (F.col("c_nationkey") % 2)})
    theirs = studies.asserted(table(spark, sf, "orders").withColumn("c_custkey", F.col("o_custkey")), ["c_custkey"], {"status": F.col("o_orderstatus"), "parity": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderkey") % 2)})
    return studies.compared_records(ours, theirs, ["c_custkey"]).groupBy("topic", "outcome").agg(F.count("*").alias("n"))


def hard_records(spark: SparkSession, sf: str) -> DataFrame:
    rows = studies.top_decile(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), ["p_size", "p_retailprice"])
    return rows.filter("hard_p_size or hard_p_retailprice").select("p_partkey", "hard_p_size", "hard_p_retailprice")


def movable_journeys(spark: SparkSession, sf: str) -> DataFrame:
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    journeys = table(spark, sf, "customer").select(k.alias("journey"), (k % 50).cast("double").alias("ox"), (n * 2.0).alias("oy"), (k % 31).cast("double").alias("dx"), n.cast("double").alias("dy"), (k % 40 + 5.0).alias("cost"))
    places = table(spark, sf, "supplier").select((F.col("s_suppkey") * 7 % 60).cast("double").alias("x"), (F.col("s_nationkey") * 3.0).alias("y"))
    return studies.could_move(journeys, places)


def equivalent_kerbs(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of customers' remainders, as kerbs, whose penalty is the same under every priority, as profiles: all from the orders."""
    rows = table(spark, sf, "orders").groupBy("o_orderpriority", (F.col("o_custkey") % 90).cast("string").alias("value")).agg((F.max("o_orderkey") % 2).cast("double").alias("penalty"))
    penalties = rows.groupBy(F.col("o_orderpriority").alias("profile")).agg(F.map_from_entries(F.collect_list(F.struct("value", "penalty"))).alias("kerb_penalty"))
    found = studies.equivalent_values(penalties, ["profile"], "kerb_penalty")
    return found.select(F.array_join("values", ",").alias("values"), F.col("profiles").cast("long").alias("profiles"))


def located_points(spark: SparkSession, sf: str) -> DataFrame:
    p = _points(spark, sf)
    tiers = [("accepted", p.filter("label = 0"), 0.01), ("near", p.filter("label = 1"), 0.02), ("covered", p.filter("label in (2, 3)"), 0.05)]
    return studies.located(p.filter("label > 3"), tiers, "outside")


def contracted_chains(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    ring = table(spark, sf, "nation").select(n.alias("segment_id"), n.alias("src"), ((n + 1) % 25).alias("dst"), (n + 10.0).alias("length_m"), F.floor(n / 5).cast("int").alias("surface"))
    return graph.contracted(ring, ["surface"])


def relocated_ends(spark: SparkSession, sf: str) -> DataFrame:
    choices = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("request"), F.when(F.col("l_linenumber") % 2 == 0, "origin").otherwise("destination").alias("side"), F.col("l_partkey").alias("node"), F.col("l_quantity").alias("d"), (F.col("l_suppkey") % 40).cast("double").alias("far")).distinct()
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), (F.col("p_size") % 3).alias("part"))
    return graph.relocated(choices, parts)


def named_stretches(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    pieces = table(spark, sf, "part").select(k.alias("piece_id"), F.concat_ws(" ", "p_name", "p_brand").alias("name"), (k % 83).cast("double").alias("x"), (k % 37).cast("double").alias("y"), F.array(k % 211, (k * 5) % 211).alias("nodes"))
    return graph.named_stretches(pieces, 3.0)


STUDY_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        attribute_lineage, shape_lineage, source_kinds, way_linkage, point_linkage, bridge_rows, source_independence, route_totals, route_gradients, route_explanations, cited_segments, route_findings, path_digests,
        route_changes, recosted_paths, majority_fill, broad_journeys, review_queue, gate_funnel, record_comparison, hard_records, movable_journeys, equivalent_kerbs, located_points, contracted_chains, relocated_ends, named_stretches,
    )
}
