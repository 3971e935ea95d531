"""Places from staged relations, nodes and ways: rings assembled from member ways, and a point inside each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import place_tags
from ..functions.geo import in_box
from ..functions.linear import point_on_line
from ..storage import settled, stored
from .graph import connected_parts

Box = tuple[float, float, float, float]
MARGIN = 0.005
"""Degrees by which nodes around the box are read, so that what straddles its edge has its whole outline."""


def resolved_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """ways (way_id, refs, ...) with line, their known nodes in order, and complete, whether all are known; ways with fewer than two go.

    nodes: (node_id, lon, lat), of which the ones near the region are enough.
    """
    refs = ways.select("way_id", F.posexplode("refs").alias("i", "node_id"))
    known = refs.join(nodes.select("node_id", F.col("lon").cast("double").alias("x"), F.col("lat").cast("double").alias("y")), "node_id")
    lines = known.groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("i", "x", "y"))).alias("vs"))  # a way's own nodes: some 2,000 at most
    line = F.transform("vs", lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    out = ways.join(lines.select("way_id", line.alias("line")), "way_id")
    return out.filter("size(line) >= 2").withColumn("complete", F.size("line") == F.size("refs"))


def closed_rings(members: DataFrame, ways: DataFrame) -> DataFrame:
    """(area_id, ring, way_id): the member ways that chain into closed rings, whatever their order and direction.

    members: (area_id, way_id); ways: (way_id, refs), complete ones. Ways of an area that share end nodes are one ring, found as connected
    parts, so no area is gathered. A ring is closed if an even number of ends meets in each of its nodes; others go.
    """
    ends = members.distinct().join(ways.select("way_id", F.element_at("refs", 1).alias("a"), F.element_at("refs", -1).alias("b")), "way_id")
    ends = stored(ends.select("area_id", "way_id", *(F.concat_ws("|", F.col("area_id").cast("string"), F.col(c).cast("string")).alias(c) for c in ("a", "b"))))
    parts = stored(connected_parts(ends, "a", "b").withColumnRenamed("root", "ring"))
    placed = ends.join(parts.withColumnRenamed("node", "a"), "a")
    degrees = ends.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n")).join(parts, "node")
    open_ = degrees.groupBy("ring").agg(F.count_if(F.col("n") % 2 == 1).alias("odd")).filter("odd > 0")
    return placed.join(open_, "ring", "left_anti").select("area_id", "ring", "way_id")


def line_edges(lines: DataFrame, *keys: str) -> DataFrame:
    """(keys, ax, ay, bx, by) of the vertex pairs of lines."""
    n = F.size("line") - 1
    pairs = F.zip_with(F.slice("line", F.lit(1), n), F.slice("line", F.lit(2), n), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return lines.filter("size(line) >= 2").select(*keys, F.inline(pairs)).filter("ax != bx or ay != by")


def inner_points(edges: DataFrame, key: str = "area_id") -> DataFrame:
    """(key, x, y): a point inside each area (key, ax, ay, bx, by), all of whose rings are closed; areas without extent have none.

    The point is in the middle of the widest stretch inside the area (ties: the first) on the line y halfway between the vertices next to
    the middle of the area's height, where no vertex lies. Edges that cross that line are counted from the left by a window over them.
    """
    heights = edges.groupBy(key).agg(((F.min(F.least("ay", "by")) + F.max(F.greatest("ay", "by"))) / 2).alias("mid"))
    ends = edges.join(heights, key)
    near = ends.groupBy(key).agg(*(f(F.when(side, F.col(c))).alias(f"{n}_{c}") for n, f in (("low", F.max), ("high", F.min)) for c in ("ay", "by") for side in [F.col(c) <= F.col("mid") if n == "low" else F.col(c) > F.col("mid")]))
    scan = near.select(key, ((F.greatest("low_ay", "low_by") + F.least("high_ay", "high_by")) / 2).alias("y"))
    crossed = edges.join(scan, key).filter("(ay > y) != (by > y)").withColumn("x", F.col("ax") + (F.col("y") - F.col("ay")) * (F.col("bx") - F.col("ax")) / (F.col("by") - F.col("ay")))
    along = W.partitionBy(key).orderBy("x")
    spans = crossed.withColumns({"nth": F.row_number().over(along), "to": F.lead("x").over(along)}).filter("nth % 2 = 1")
    widest = spans.groupBy(key).agg(F.max_by(F.struct("x", "to", "y"), F.struct((F.col("to") - F.col("x")).alias("w"), (-F.col("x")).alias("x"))).alias("s"))
    return widest.select(key, ((F.col("s.x") + F.col("s.to")) / 2).alias("x"), F.col("s.y").alias("y"))


def way_points(ways: DataFrame) -> DataFrame:
    """(way_id, x, y) of ways (way_id, line): inside if the line is closed and has an extent, else halfway along; none without length."""
    first, last = F.element_at("line", 1), F.element_at("line", -1)
    known = stored(ways.select("way_id", "line", ((F.size("line") >= 4) & (first == last)).alias("closed")))
    inside = inner_points(line_edges(known.filter("closed"), "way_id"), "way_id")
    half = point_on_line(F.col("line"), F.lit(0.5))
    edges = line_edges(known, "way_id").select("way_id").distinct()
    other = known.join(edges, "way_id", "left_semi").join(inside.select("way_id"), "way_id", "left_anti").select("way_id", half["x"].alias("x"), half["y"].alias("y"))
    return inside.unionByName(other)


def _entries(found: DataFrame, osm_type: str, key: str, box: Box) -> DataFrame:
    """Entries of features (key, tags, version, x, y) whose point is in the box."""
    e: Column = place_tags.entry(F.col("tags"))
    rows = found.filter(in_box(F.col("x"), F.col("y"), box)).withColumn("e", e).filter("e is not null")
    named = F.col("e.kind") == "place"
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("e.kind").alias("kind"), F.col("e.label").alias("label"), F.col("e.category").alias("category"), place_tags.search_text(F.col("e.searched")).alias("search_text"),
        F.col("x").alias("lon"), F.col("y").alias("lat"), F.lit(osm_type).alias("osm_type"), F.col(key).alias("osm_id"), "version",
        F.when(named, place_tags.place_codes(F.col("tags"))).otherwise(none).alias("codes"), F.when(named, place_tags.place_initialisms(F.col("tags"))).otherwise(none).alias("initialisms"),
    )


def read_places(relations: DataFrame, nodes: DataFrame, ways: DataFrame, box: Box, margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(entries, streets) of a region.

    relations: (relation_id, tags, version, members array<struct<type, ref, role>>); nodes: (node_id, tags, version, lon, lat); ways:
    (way_id, tags, version, refs). entries: (kind, label, category, search_text, lon, lat, osm_type, osm_id, version, codes,
    initialisms) of named places and addresses whose point is in the box. streets: (way_id, name, category, version, refs, line).

    Three passes that depend on each other: multipolygons that are candidates name the ways to keep besides those that are candidates or
    streets; these name the nodes. Of a relation the outer members count, as far as they are known whole and close to rings. Outlines of
    ways with an unknown node have no point. Null tags are none; repeated features are features of their own; empty tables give none.
    """

    def build() -> DataFrame:
        areas = relations.filter((F.col("tags")["type"] == "multipolygon") & place_tags.is_candidate(F.col("tags")))
        outer = stored(areas.select(F.col("relation_id").alias("area_id"), F.explode("members").alias("m")).filter("m.type = 'w' and m.role in ('outer', '')").select("area_id", F.col("m.ref").alias("way_id")).distinct())
        wanted = ways.filter(place_tags.is_candidate(F.col("tags"))).select("way_id").union(outer.select("way_id")).distinct()
        known = stored(resolved_ways(ways.join(wanted, "way_id", "left_semi"), near(nodes)).filter("complete"))
        rings = stored(closed_rings(outer, known))
        of_areas = line_edges(rings.join(known.select("way_id", "line"), "way_id"), "area_id")
        points = inner_points(of_areas).withColumnRenamed("area_id", "relation_id")
        own = known.filter(place_tags.is_candidate(F.col("tags")))
        found = [
            _entries(nodes.filter(place_tags.is_candidate(F.col("tags"))).withColumns({"x": F.col("lon"), "y": F.col("lat")}), "node", "node_id", box),
            _entries(own.join(way_points(own), "way_id"), "way", "way_id", box),
            _entries(areas.join(points, "relation_id"), "relation", "relation_id", box),
        ]
        return found[0].unionByName(found[1]).unionByName(found[2])

    def near(all_nodes: DataFrame) -> DataFrame:
        return all_nodes.filter(in_box(F.col("lon"), F.col("lat"), (box[0] - margin, box[1] - margin, box[2] + margin, box[3] + margin)))

    named = ways.filter(~F.coalesce(place_tags.is_candidate(F.col("tags")), F.lit(False)) & place_tags.name(F.col("tags")).isNotNull() & place_tags.street_category(F.col("tags")).isNotNull())
    streets = resolved_ways(named, near(nodes)).select("way_id", place_tags.name(F.col("tags")).alias("name"), place_tags.street_category(F.col("tags")).alias("category"), "version", "refs", "line")
    return settled(build), streets
