"""Matching inventory records to ways by claims of sample points."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geo import densified, on_segment, undirected_angle
from .spatial import cell, segment_cells

NEAR_M, ANGLE_DEG, CARRIER_M, MARGIN_M = 3.0, 45.0, 5.0, 1.5
COVERAGE, CONTESTED = 0.75, 0.2


def samples(records: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(record_id, sample, x, y, bearing): points along each record's line."""
    return records.select("record_id", F.posexplode(densified(F.col("line"), spacing)).alias("sample", "p")).select("record_id", "sample", "p.x", "p.y", "p.bearing")


def claims(points: DataFrame, pieces: DataFrame, near: float = NEAR_M) -> DataFrame:
    """(record_id, sample, way_id, d, rival_d): each sample's nearest aligned way within near, and the next way's distance.

    pieces: (way_id, ax, ay, bx, by, bearing), vertex pairs of ways. A sample looks into one grid cell.
    """
    asked = points.withColumns({"cx": cell(F.col("x"), near * 4), "cy": cell(F.col("y"), near * 4)})
    found = asked.join(segment_cells(pieces.withColumnRenamed("bearing", "way_bearing"), near * 4, near), ["cx", "cy"])
    found = found.withColumn("d", on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))["d"])
    found = found.filter((F.col("d") <= near) & (undirected_angle(F.col("bearing"), F.col("way_bearing")) <= ANGLE_DEG))
    ways = found.groupBy("record_id", "sample", "way_id").agg(F.min("d").alias("d"))
    w = W.partitionBy("record_id", "sample").orderBy("d", "way_id")
    return ways.withColumn("rival_d", F.lead("d").over(w)).withColumn("_i", F.row_number().over(w)).filter("_i = 1").drop("_i")


def decisions(points: DataFrame, claimed: DataFrame, spacing: float = 1.0) -> DataFrame:
    """(record_id, outcome, rule, coverage, contested, ways): matched, ambiguous or unmatched.

    A way carries a record if it claims CARRIER_M of it. Coverage is the share of samples on carriers; a sample is contested if another way is
    within MARGIN_M of the winner's distance.
    """
    total = points.groupBy("record_id").agg(F.count("*").alias("samples"))
    per_way = claimed.groupBy("record_id", "way_id").agg(F.count("*").alias("n"), F.count_if(F.col("rival_d") - F.col("d") <= MARGIN_M).alias("c"))
    carriers = per_way.filter(F.col("n") * spacing >= CARRIER_M)
    sums = carriers.groupBy("record_id").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.array_sort(F.collect_set("way_id")).alias("ways"))
    rows = total.join(sums, "record_id", "left").withColumn("coverage", F.coalesce(F.col("n") / F.col("samples"), F.lit(0.0))).withColumn("contested", F.coalesce(F.try_divide("c", "n"), F.lit(0.0)))
    rule = F.when(F.col("n").isNull(), "no_carrier").when(F.col("coverage") < COVERAGE, "low_coverage").when(F.col("contested") > CONTESTED, "contested").otherwise("covered")
    rows = rows.withColumn("rule", rule).withColumn("outcome", F.when(rule == "covered", "matched").when(rule == "no_carrier", "unmatched").otherwise("ambiguous"))
    return rows.select("record_id", "outcome", "rule", F.round("coverage", 4).alias("coverage"), F.round("contested", 4).alias("contested"), "ways")


def majority_value(overlaps: DataFrame, key: str, value: str, least: float = 0.9, other: float = 0.1, length: str = "length_m") -> DataFrame:
    """(key, value, share): the value that covers at least `least` of a segment while no other covers more than `other`."""
    sums = overlaps.groupBy(key, value, length).agg(F.sum("overlap").alias("m"))
    w = W.partitionBy(key).orderBy(F.col("m").desc(), value)
    ranked = sums.withColumn("_i", F.row_number().over(w)).withColumn("_next", F.lead("m").over(w))
    share = F.least(F.lit(1.0), F.try_divide("m", length))
    return ranked.filter("_i = 1").withColumn("share", share).filter((share >= least) & (F.coalesce(F.try_divide("_next", length), F.lit(0.0)) <= other)).select(key, value, "share")
