"""Totals, explanations and checks of computed routes, all over a table of route pieces.

pieces: (request, profile, ix, segment_id, length_m, ...): a row for each segment of each route, in order of ix.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

ROUTE = ("request", "profile")


def totals(pieces: DataFrame, classes: Mapping[str, Column], known: Mapping[str, Column], keys: Sequence[str] = ROUTE) -> DataFrame:
    """(keys, pieces, distance_m, m_<class>, share_<attribute>, unknown_share) of each route.

    m_: metres where a class holds; share_: share of the distance on which an attribute is known; unknown_share: on which none is.
    """
    length, out = F.col("length_m"), [F.count("*").alias("pieces"), F.sum("length_m").alias("distance_m")]
    out += [F.coalesce(F.sum(F.when(c, length)), F.lit(0.0)).alias(f"m_{k}") for k, c in classes.items()]

    def share(c: Column) -> Column:
        return F.least(F.lit(1.0), F.try_divide(F.coalesce(F.sum(F.when(c, length)), F.lit(0.0)), F.sum(length)))

    out += [share(c).alias(f"share_{k}") for k, c in known.items()]
    nothing = F.lit(True)
    for c in known.values():
        nothing = nothing & ~F.coalesce(c, F.lit(False))
    return pieces.groupBy(*keys).agg(*out, share(nothing).alias("unknown_share"))


def gradients(pieces: DataFrame, keys: Sequence[str] = ROUTE, grade: str = "effective_grade", source: str = "grade_source") -> DataFrame:
    """(keys, m_recorded, m_derived, m_unknown, steepest_up, up_segment, steepest_down, down_segment): on ties the first piece."""
    def metres(kind: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col(source).eqNullSafe(F.lit(kind)), F.col("length_m"))), F.lit(0.0)).alias(f"m_{kind}")

    g = F.col(grade)
    up = F.max(F.when(g > 0, F.struct(g.alias("g"), (-F.col("ix")).alias("i"), F.col("segment_id").alias("s"))))
    down = F.min(F.when(g < 0, F.struct(g.alias("g"), F.col("ix").alias("i"), F.col("segment_id").alias("s"))))
    rows = pieces.groupBy(*keys).agg(*map(metres, ("recorded", "derived", "unknown")), up.alias("up"), down.alias("down"))
    return rows.select(*keys, "m_recorded", "m_derived", "m_unknown", F.col("up.g").alias("steepest_up"), F.col("up.s").alias("up_segment"), F.col("down.g").alias("steepest_down"), F.col("down.s").alias("down_segment"))


def spend(pieces: DataFrame, codes: Mapping[str, Column], keys: Sequence[str] = ROUTE, where: Column | None = None) -> DataFrame:
    """(keys, code, spent): effective metres that each route spends on each cost code, in long form."""
    rows = pieces if where is None else pieces.filter(where)
    sums = rows.groupBy(*keys).agg(*(F.sum(c).alias(k) for k, c in codes.items()))
    return sums.select(*keys, F.inline(F.array(*(F.struct(F.lit(k).alias("code"), F.col(k).cast("double").alias("spent")) for k in codes))))


def explanations(theirs: DataFrame, ours: DataFrame, keys: Sequence[str] = ("request",), least: float = 1.0) -> DataFrame:
    """(keys, code, theirs, ours, saved, place): what the chosen route saves over the other one, largest first, then by code.

    theirs and ours: (keys, code, spent). Savings of no more than least effective metres aren't told.
    """
    rows = theirs.select(*keys, "code", F.col("spent").alias("theirs")).join(ours.select(*keys, "code", F.col("spent").alias("ours")), [*keys, "code"])
    rows = rows.withColumn("saved", F.col("theirs") - F.col("ours")).filter(F.col("saved") > least)
    return rows.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.col("saved").desc(), "code")))


def cited(pieces: DataFrame, chosen: DataFrame, predicate: Column, key: str = "request", most: int = 10) -> DataFrame:
    """(key, segments): the first pieces of the other route that a predicate holds for and the chosen route doesn't use."""
    left = pieces.filter(predicate).join(chosen.select(key, "segment_id").distinct(), [key, "segment_id"], "left_anti")
    rows = left.withColumn("_i", F.row_number().over(W.partitionBy(key).orderBy("ix"))).filter(F.col("_i") <= most)
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "segment_id"))), lambda s: s["segment_id"]).alias("segments"))


def broken_seams(pieces: DataFrame, start: str, end: str, keys: Sequence[str] = ROUTE) -> DataFrame:
    before = F.lag(end).over(W.partitionBy(*keys).orderBy("ix"))
    return pieces.withColumn("_before", before).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col(start))).select(*keys, F.lit("continuity").alias("check"))


def findings(routes: DataFrame, pieces: DataFrame, limits: Mapping[str, Column], start: str = "src", end: str = "dst", keys: Sequence[str] = ROUTE) -> DataFrame:
    """(keys, check, n): what is wrong with each route.

    continuity: consecutive pieces don't meet; distance: the route's distance_m isn't the sum of its pieces'; eta: its times aren't its distance
    over the profile's paces; and a check for each limit that a piece breaks. routes: keys, distance_m, fastest_s, slowest_s, pace_low, pace_high.
    """
    summed = pieces.groupBy(*keys).agg(F.sum("length_m").alias("_sum"))
    joined = routes.join(summed, list(keys), "left")
    far = F.abs(F.coalesce("_sum", F.lit(0.0)) - F.col("distance_m")) > 0.01
    late = (F.abs(F.col("fastest_s") - F.col("distance_m") / F.col("pace_high")) > 0.01) | (F.abs(F.col("slowest_s") - F.col("distance_m") / F.col("pace_low")) > 0.01)
    out = broken_seams(pieces, start, end, keys)
    for name, rule in {"distance": far, "eta": late}.items():
        out = out.unionByName(joined.filter(rule).select(*keys, F.lit(name).alias("check")))
    broken = F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in limits.items()))))
    out = out.unionByName(pieces.select(*keys, broken.alias("check")))
    return out.groupBy(*keys, "check").agg(F.count("*").alias("n"))


def path_digests(pieces: DataFrame, keys: Sequence[str] = ROUTE) -> DataFrame:
    """(keys, path_sha256): a digest of each route's segments in order. A route is bounded by the graph's expansion limit, so its list is too."""
    order = F.array_sort(F.collect_list(F.struct("ix", F.col("segment_id").cast("string").alias("s"))))
    return pieces.groupBy(*keys).agg(F.sha2(F.array_join(F.transform(order, lambda p: p["s"]), ">"), 256).alias("path_sha256"))


def changes(before: DataFrame, after: DataFrame, keys: Sequence[str] = ROUTE) -> DataFrame:
    """(keys, change, detour_m): routes of two graphs compared. before and after: keys, path_sha256, distance_m; null where there is no route."""
    b = before.select(*keys, F.col("path_sha256").alias("_p"), F.col("distance_m").alias("_d"), F.lit(True).alias("_b"))
    rows = after.join(b, list(keys), "full")
    kind = F.when(F.col("_p").isNull() & F.col("path_sha256").isNull(), "no_route").when(F.col("_p").isNull(), "opened").when(F.col("path_sha256").isNull(), "closed").when(F.col("_p") == F.col("path_sha256"), "same").otherwise("moved")
    return rows.select(*keys, kind.alias("change"), (F.col("distance_m") - F.col("_d")).alias("detour_m"))
