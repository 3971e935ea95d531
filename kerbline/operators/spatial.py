"""Distance joins on a grid: never all pairs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import on_segment
from ..storage import settled, stored

DIGITS = 12
"""Distances that agree in so many decimals tie."""


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def _around(df: DataFrame, size: float) -> DataFrame:
    """Each point in its own cell and the eight around it."""
    near = F.explode(F.array(*(F.struct((cell(F.col("x"), size) + i).alias("cx"), (cell(F.col("y"), size) + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    return df.withColumn("_c", near).select("*", "_c.cx", "_c.cy").drop("_c")


def within(left: DataFrame, right: DataFrame, radius: float) -> DataFrame:
    """Pairs of points at most radius apart, with d. Columns x and y of right become rx and ry; other names must differ.

    An equi-join on cells of the radius's size, exact distance after it; adaptive skew splitting copes with crowded cells.
    """
    a = _around(left, radius)
    b = right.withColumnsRenamed({"x": "rx", "y": "ry"}).withColumns({"cx": cell(F.col("rx"), radius), "cy": cell(F.col("ry"), radius)})
    dx, dy = F.col("x") - F.col("rx"), F.col("y") - F.col("ry")
    # Not hypot, which rounds otherwise: a distance right at the radius has to fall as it does for whoever writes the formula out.
    return a.join(b, ["cx", "cy"]).withColumn("d", F.sqrt(dx * dx + dy * dy)).filter(F.col("d") <= radius).drop("cx", "cy")


def segment_cells(segments: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """Each segment (ax, ay, bx, by) in every cell that its box, widened by margin, meets."""
    col = F.col
    spans = [F.sequence(cell(F.least(col(a), col(b)) - margin, size), cell(F.greatest(col(a), col(b)) + margin, size)) for a, b in (("ax", "bx"), ("ay", "by"))]
    return segments.withColumn("cx", F.explode(spans[0])).withColumn("cy", F.explode(spans[1]))


def snap(points: DataFrame, segments: DataFrame, max_distance: float, key: str = "point_id", segment: str = "segment_id", accept: Column | None = None) -> DataFrame:
    """(point columns, segment columns, t, snap_x, snap_y, d): each point's nearest accepted segment within max_distance.

    Segments are spread over the cells that their widened boxes meet, so a point looks into one cell; ties go to the lesser segment id.
    Reduced by min over a struct, with partial aggregation.
    """
    usable = segments if accept is None else segments.filter(accept)
    cells = segment_cells(usable, max_distance, max_distance)
    asked = points.withColumns({"cx": cell(F.col("x"), max_distance), "cy": cell(F.col("y"), max_distance)})
    near = on_segment(F.col("x"), F.col("y"), F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    found = asked.join(cells, ["cx", "cy"]).withColumn("_n", near).filter(F.col("_n.d") <= max_distance)
    best = found.groupBy(key).agg(F.min(F.struct(F.col("_n.d").alias("d"), F.col(segment).alias(segment), F.col("_n.t").alias("t"), F.col("_n.x").alias("snap_x"), F.col("_n.y").alias("snap_y"))).alias("b"))
    return points.join(best, key, "left").select(*points.columns, "b.*")


def _first_radius(spots: DataFrame, radius: float) -> float:
    """radius halved until a square of that side holds about one of the spots (x, y), by their number in the box they fill."""
    sides = [F.greatest(F.max(c) - F.min(c), F.lit(radius)) for c in ("x", "y")]
    box = spots.agg(F.count("*").alias("n"), sides[0].alias("w"), sides[1].alias("h")).first()
    crowd = radius * radius * box["n"] / (box["w"] * box["h"]) if box["n"] else 0.0
    return radius / 2 ** max(0, math.ceil(math.log2(crowd) / 2)) if 1 < crowd < math.inf else radius


def nearest(points: DataFrame, targets: DataFrame, radius: float, key: str, target: str, k: int = 1) -> DataFrame:
    """(key, target, d, rank): the k nearest targets within radius; ties go to the lesser target.

    Places are asked once, however many points or targets share them, and of the targets at one place the k least stand for it. The search
    begins within a radius that holds few targets and doubles it for the places that found fewer than k, so pairs grow with the places and
    not with the crowd within the whole radius.
    """
    order = W.partitionBy("x", "y").orderBy(F.round("d", DIGITS), target)
    known = [c.isNotNull() & ~F.isnan(c) for c in (F.col("x"), F.col("y"))]

    def found() -> DataFrame:
        heads = targets.filter(known[0] & known[1]).withColumn("_i", F.row_number().over(W.partitionBy("x", "y").orderBy(target))).filter(F.col("_i") <= k)
        heads = stored(heads.select(target, "x", "y"))
        left, done = stored(points.select("x", "y").filter(known[0] & known[1]).distinct()), []
        at = _first_radius(heads.select("x", "y").distinct(), radius)
        while True:
            best = within(left, heads, at).select("x", "y", target, "d")
            ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            # Targets a hair outside could tie with those at the very edge, so these don't count as found before the last round.
            near = stored(ranked)
            if at >= radius:
                done.append(near)
                break
            full = near.filter((F.col("rank") == k) & (F.col("d") <= at - 10.0 ** -(DIGITS - 2))).select("x", "y")
            done.append(near.join(full.hint("merge"), ["x", "y"], "left_semi"))
            left = stored(left.join(full.hint("merge"), ["x", "y"], "left_anti"))
            if not left.limit(1).count():
                break
            at = min(radius, at * 2)
        return reduce(DataFrame.union, done)

    return points.select(key, "x", "y").join(settled(found), ["x", "y"]).select(key, target, "d", "rank")


def density(points: DataFrame, radius: float, key: str) -> DataFrame:
    """(key, n): how many other points lie within radius."""
    other = points.select(F.col(key).alias("_other"), "x", "y")
    return within(points, other, radius).groupBy(key).agg((F.count("*") - 1).alias("n"))


def directed_hausdorff(samples: DataFrame, targets: DataFrame, group: str, limit: float, key: str, target: str) -> DataFrame:
    """(group, offset): the largest distance from a group's samples to their nearest target; null if one has none within limit."""
    near = nearest(samples, targets, limit, key, target)
    rows = samples.join(near.select(key, "d"), key, "left")
    return rows.groupBy(group).agg(F.when(F.count("d") == F.count("*"), F.max("d")).alias("offset"))


def overlaps(left: DataFrame, right: DataFrame, keys: Sequence[str], width: float) -> DataFrame:
    """Pairs of intervals (lo, hi) and (rlo, rhi) of one key that overlap, with overlap.

    Both sides are spread over bins of the given width and meet in the bin where the overlap begins: each pair once, without a
    band join.
    """
    def spread(df: DataFrame, lo: str, hi: str) -> DataFrame:
        return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(lo) / width), F.floor(F.col(hi) / width))))

    pairs = spread(left, "lo", "hi").join(spread(right, "rlo", "rhi"), [*keys, "_bin"])
    pairs = pairs.withColumn("overlap", F.least("hi", "rhi") - F.greatest("lo", "rlo"))
    return pairs.filter((F.col("overlap") > 0) & (F.floor(F.greatest("lo", "rlo") / width) == F.col("_bin"))).drop("_bin")


def pair_metrics(samples: DataFrame, keys: Sequence[str], near: float) -> DataFrame:
    """Offsets of a pair from sample distances d: least, greatest, mean, median and the share within near."""
    return samples.groupBy(*keys).agg(F.min("d").alias("min_d"), F.max("d").alias("max_d"), F.avg("d").alias("mean_d"), F.median("d").alias("median_d"), F.avg((F.col("d") <= near).cast("double")).alias("share_near"))
