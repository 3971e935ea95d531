"""Street networks from staged map tables, and a synthetic lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.geo import geodesic_m, in_box
from ..functions.tags import WALKABLE, edge_features, first_value


def walkable_ways(ways: DataFrame) -> DataFrame:
    """Ways of a walkable kind that aren't areas. tags: map<string, string>."""
    tags = F.col("tags")
    return ways.filter(first_value(tags["highway"]).isin(*WALKABLE) & ~F.coalesce(first_value(tags["area"]) == "yes", F.lit(False)))


def segments(nodes: DataFrame, ways: DataFrame, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(segment_id, way_id, pair, src, dst, ax, ay, bx, by, length_m, tags): the consecutive pairs of each way's refs.

    nodes: node_id, lon, lat; ways: way_id, refs, tags. Both ends must exist (and lie in box); pairs without length (on the ellipsoid) go. Two equi-joins on the
    node id; the box reaches the scan of nodes.
    """
    known = nodes.select("node_id", "lon", "lat")
    if box:
        known = known.filter(in_box(F.col("lon"), F.col("lat"), box))
    pairs = F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(F.get("refs", i).alias("src"), F.get("refs", i + 1).alias("dst")))
    rows = ways.filter(F.size("refs") >= 2).select("way_id", "tags", F.posexplode(pairs).alias("pair", "p")).select("way_id", "tags", "pair", "p.src", "p.dst")
    a = known.toDF("src", "ax", "ay")
    b = known.toDF("dst", "bx", "by")
    rows = rows.join(a, "src").join(b, "dst").withColumn("length_m", geodesic_m(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))).filter("length_m > 0")
    return rows.withColumn("segment_id", F.concat_ws(":", "way_id", "pair"))


def with_features(rows: DataFrame) -> DataFrame:
    """segments with normalised attributes in place of tags."""
    features = edge_features(F.col("tags"))
    return rows.withColumns(features).withColumn("effective_grade", F.col("incline_percent")).withColumn("unit_share", F.lit(1.0)).drop("tags")


def latest_edit(ways: DataFrame, node_edits: DataFrame) -> DataFrame:
    """(way_id, latest): the last edit of a way and all its nodes; null if one of them is unknown."""
    members = ways.select("way_id", "edited_at", F.explode("refs").alias("node_id")).join(node_edits.select("node_id", F.col("edited_at").alias("node_edit")), "node_id", "left")
    known = (F.count("*") == F.count("node_edit")) & F.max("edited_at").isNotNull()
    return members.groupBy("way_id").agg(F.when(known, F.greatest(F.max("edited_at"), F.max("node_edit"))).alias("latest"))


def without_reverse_twins(edges: DataFrame) -> DataFrame:
    """edges without generated reverse copies: of (u, v) and (v, u) of one way and pair, the generated one goes."""
    twin = edges.filter("not generated").select(F.col("way_id"), F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("generated"))
    return edges.join(twin, ["way_id", "src", "dst", "generated"], "left_anti")


def region_scan(spark: SparkSession, path: str, box: tuple[float, float, float, float], columns: list[str]) -> DataFrame:
    """Columns of features whose bbox struct meets box; the four comparisons are pushed to row-group statistics."""
    rows = spark.read.parquet(path)
    return rows.filter((F.col("bbox.xmin") <= box[2]) & (F.col("bbox.xmax") >= box[0]) & (F.col("bbox.ymin") <= box[3]) & (F.col("bbox.ymax") >= box[1])).select(*columns)


def source_rows(features: DataFrame) -> DataFrame:
    """(id, property, dataset, record_id, ...): the structs of sources as rows."""
    return features.select("id", F.inline("sources"))


def elevations(points: DataFrame, grid: DataFrame, origin: tuple[float, float], size: float) -> DataFrame:
    """points (x, y) with elevation_m of their raster cell, null outside or without data. grid: col, row, elevation_m; an equi-join."""
    at = points.withColumns({"col": F.floor((F.col("x") - origin[0]) / size).cast("int"), "row": F.floor((F.col("y") - origin[1]) / size).cast("int")})
    return at.join(grid, ["col", "row"], "left").drop("col", "row")


def lattice(spark: SparkSession, n: int, spacing: float = 0.00045) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of an n x n street grid: every 4th way is stairs, every 3rd other one has no surface."""
    nodes = spark.range(n * n).select(F.col("id").cast("string").alias("node_id"), ((F.col("id") % n) * spacing).alias("lon"), (F.floor(F.col("id") / n) * spacing).alias("lat"))
    ends = spark.range(n * n).select("id", F.explode(F.array(F.when(F.col("id") % n < n - 1, F.col("id") + 1), F.when(F.col("id") < n * (n - 1), F.col("id") + n))).alias("to")).filter("`to` is not null")
    i = F.col("id") * 2 + (F.col("to") - F.col("id") == n).cast("int")
    tags = F.when(i % 4 == 3, F.create_map(F.lit("highway"), F.lit("steps"))).when(i % 3 == 0, F.create_map(F.lit("highway"), F.lit("footway"))).otherwise(F.create_map(F.lit("highway"), F.lit("footway"), F.lit("surface"), F.lit("asphalt")))
    ways = ends.select(F.concat_ws("-", "id", "to").alias("way_id"), F.array(F.col("id").cast("string"), F.col("to").cast("string")).alias("refs"), tags.alias("tags"))
    return nodes, ways
