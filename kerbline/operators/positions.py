"""Where segments lie along their ways, found and verified by the ways' own node order."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def numbered_segments(sources: DataFrame, ways: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((segment_id, way_id, start_m, end_m), (problem, n)): segments that name their place on a way, checked against its nodes.

    sources: (segment_id, way_id, place, src, dst), place counting vertex pairs from 0; ways: (way_id, refs, positions), positions in metres
    from the start. A segment without a way, of a way that isn't there, or whose nodes aren't the way's at that place is a problem.
    """
    known = sources.join(ways.select("way_id", "refs", "positions"), "way_id", "left")
    fits = (F.col("place") >= 0) & (F.col("place") + 1 < F.size("refs")) & F.get("refs", F.col("place")).eqNullSafe(F.col("src")) & F.get("refs", F.col("place") + 1).eqNullSafe(F.col("dst"))
    problem = F.when(F.col("way_id").isNull(), "no_source_way").when(F.col("refs").isNull(), "way_not_in_extract").when(~F.coalesce(fits, F.lit(False)), "nodes_do_not_match_the_way")
    told = known.withColumn("problem", problem)
    placed = told.filter("problem is null").select("segment_id", "way_id", F.get("positions", F.col("place")).alias("start_m"), F.get("positions", F.col("place") + 1).alias("end_m"))
    return placed, told.filter("problem is not null").groupBy("problem").agg(F.count("*").alias("n"))


def located_runs(segments: DataFrame, ways: DataFrame) -> DataFrame:
    """(segment_id, way_id, place, reversed): every place at which a segment's refs are a contiguous run of its way's, in either direction.

    segments: (segment_id, way_id, refs), two refs or more; ways: (way_id, refs). The first pair of refs and the number of refs to come
    are a key that a segment shares with the places where it may begin: an equi-join, after which the run is compared as a whole. A
    run that reads the same backwards is placed once, forwards.
    """
    pairs = F.transform(F.sequence(F.lit(0), F.size("refs") - 2), lambda i: F.struct(i.alias("place"), F.get("refs", i).alias("a"), F.get("refs", i + 1).alias("b")))
    starts = ways.filter("size(refs) >= 2").select("way_id", F.col("refs").alias("way_refs"), F.explode(pairs).alias("p")).select("way_id", "way_refs", "p.*")
    turned = F.reverse("refs")
    both = F.explode(F.array(F.struct(F.lit(False).alias("reversed"), F.col("refs").alias("run")), F.struct(F.lit(True).alias("reversed"), turned.alias("run"))))
    asked = segments.filter("size(refs) >= 2").select("segment_id", "way_id", "refs", both.alias("r")).filter("not r.reversed or r.run != refs")
    asked = asked.select("segment_id", "way_id", "r.reversed", "r.run", F.get("r.run", 0).alias("a"), F.get("r.run", 1).alias("b"))
    met = asked.join(starts, ["way_id", "a", "b"]).filter(F.col("place") + F.size("run") <= F.size("way_refs"))
    return met.filter(F.slice("way_refs", F.col("place") + 1, F.size("run")) == F.col("run")).select("segment_id", "way_id", "place", "reversed")
