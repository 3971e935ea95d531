"""Links between the segments of one publication and the ways of another."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.fields import element_ref, linear_range


def classified_sources(rows: DataFrame, dataset: str = "OpenStreetMap") -> DataFrame:
    """rows (segment_id, dataset, record_id, property, between, update_time) with ref, range and kind.

    kind is the first that holds: duplicate of an equal row, other_dataset, malformed_id, property_only, other_element, malformed_range,
    way. Equal rows are told by their columns, so they meet in small windows.
    """
    ref, span = element_ref(F.col("record_id")), linear_range(F.col("between"))
    columns = [c for c in rows.columns]
    turn = F.row_number().over(W.partitionBy(*columns).orderBy(F.lit(0)))
    kind = (
        F.when(F.col("_turn") > 1, "duplicate").when(~F.col("dataset").eqNullSafe(F.lit(dataset)), "other_dataset").when(F.col("ref.problem").isNotNull(), "malformed_id")
        .when(F.coalesce(F.length("property"), F.lit(0)) > 0, "property_only").when(F.col("ref.kind") != "way", "other_element").when(F.col("range.malformed"), "malformed_range").otherwise("way")
    )
    return rows.withColumns({"ref": ref, "range": span, "_turn": turn}).withColumn("kind", kind).drop("_turn")


def way_links(classified: DataFrame) -> DataFrame:
    """(segment_id, way_id, version, update_time, partial) of the rows of kind way."""
    partial = F.coalesce((F.col("range.lo") > 0) | (F.col("range.hi") < 1), F.lit(False))  # no range: the whole
    return classified.filter("kind = 'way'").select("segment_id", F.col("ref.id").alias("way_id"), F.col("ref.version").alias("version"), "update_time", partial.alias("partial"))


def linked_ways(ways: DataFrame, links: DataFrame) -> DataFrame:
    """ways (way_id, ...) with match, cardinality, segments, versions, times and partial_ranges.

    A way is split if it lies in several segments and merged if one of them cites several ways; those two give 1:1, 1:N, N:1 and N:M.
    versions and times hold the least and the greatest, one entry if they are equal.
    """
    cited = links.groupBy("segment_id").agg(F.count_distinct("way_id").alias("cited"))
    merged = links.select("segment_id", "way_id").distinct().join(cited, "segment_id").groupBy("way_id").agg(F.count("*").alias("segments"), F.max("cited").alias("cited"))

    def ends(c: str) -> Column:
        return F.array_distinct(F.array_compact(F.array(F.min(c), F.max(c))))

    facts = links.groupBy("way_id").agg(ends("version").alias("versions"), ends("update_time").alias("times"), F.count_if("partial").alias("partial_ranges"))
    split, many = F.col("segments") > 1, F.col("cited") > 1
    kind = F.when(split & many, "N:M").when(split, "1:N").when(many, "N:1").when(F.col("segments").isNotNull(), "1:1")
    rows = ways.join(merged, "way_id", "left").join(facts, "way_id", "left")
    return rows.withColumns({"cardinality": kind, "match": F.when(F.col("segments").isNull(), "not_linked").otherwise("linked")}).drop("cited")


def endpoint_links(segments: DataFrame, points: DataFrame, nodes: DataFrame) -> DataFrame:
    """(point_id, cited, known, is_node): each point that segments (segment_id, point_ids) cite or that is published, with how often it is
    cited, whether it is published and whether it is a node on the other side."""
    cited = segments.select(F.explode("point_ids").alias("point_id")).groupBy("point_id").agg(F.count("*").alias("cited"))
    known = points.select("point_id").distinct().withColumn("known", F.lit(True))
    other = nodes.select(F.col("node_id").alias("point_id")).distinct().withColumn("is_node", F.lit(True))
    out = cited.join(known, "point_id", "full").join(other, "point_id", "left")
    return out.select("point_id", F.coalesce("cited", F.lit(0)).alias("cited"), F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("is_node", F.lit(False)).alias("is_node"))


def bridged(bridge: DataFrame, sources: DataFrame, keys: Sequence[str]) -> DataFrame:
    """bridge rows with found and properties: the properties of the source rows with the same keys, nulls equal to each other."""
    known = sources.groupBy(*keys).agg(F.array_sort(F.collect_set(F.coalesce("property", F.lit("")))).alias("properties")).withColumnsRenamed({k: f"_s_{k}" for k in keys})
    same = None
    for k in keys:
        fits = F.col(k).eqNullSafe(F.col(f"_s_{k}"))
        same = fits if same is None else same & fits
    return bridge.join(known, same, "left").withColumn("found", F.col("properties").isNotNull()).drop(*(f"_s_{k}" for k in keys))


def independence(sources: DataFrame, keys: Sequence[str], dataset: str = "dataset") -> DataFrame:
    """(keys, sources, shape): whether one, several or no datasets stand behind each attribute of a feature."""
    rows = sources.groupBy(*keys).agg(F.array_sort(F.collect_set(dataset)).alias("sources"))
    return rows.withColumn("shape", F.when(F.size("sources") == 0, "none").when(F.size("sources") == 1, "single").otherwise("several"))
