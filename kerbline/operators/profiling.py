"""Profiles of an inventory's fields, search and matcher quality, and small facts of edges."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import geodesic_m
from ..functions.tags import derived_grade
from .stats import pair_counts, precision_recall

MAX_SPAN_M = 15_000.0


def year_histogram(rows: DataFrame, column: str) -> DataFrame:
    """(year, n), with a null year for rows without a date."""
    return rows.groupBy(F.year(column).alias("year")).agg(F.count("*").alias("n"))


def signature_counts(rows: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """(signature, n): how many rows hold how many of the flags, such as fields at their template's default; a null flag isn't held."""
    held = sum((F.when(c, 1).otherwise(0) for c in flags.values()), F.lit(0))
    return rows.groupBy(held.alias("signature")).agg(F.count("*").alias("n"))


def agreement(rows: DataFrame, stated: Column, expected: Column, empty: Sequence[str] = ("None",)) -> DataFrame:
    """(compared, agree, empty): rows with both a stated value and the one that another field implies, those that agree, and those whose stated
    value only looks like one."""
    hollow = F.coalesce(stated.isin(*empty), F.lit(False))
    both = stated.isNotNull() & expected.isNotNull() & ~hollow
    return rows.agg(F.count_if(both).alias("compared"), F.count_if(both & (stated == expected)).alias("agree"), F.count_if(hollow).alias("empty"))


def evidence_counts(rows: DataFrame, facts: Mapping[str, Column]) -> DataFrame:
    """(fact, n): rows with each fact, with any of them, and all rows; one pass."""
    known = {k: F.coalesce(c, F.lit(False)) for k, c in facts.items()}
    some = F.lit(False)
    for c in known.values():
        some = some | c
    one = rows.agg(F.count("*").alias("records"), *(F.count_if(c).alias(k) for k, c in known.items()), F.count_if(some).alias("with_any"))
    return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("fact"), F.col(c).alias("n")) for c in one.columns))).alias("r")).select("r.*")


def band(distance: Column, bounds: Sequence[float], limit: float) -> Column:
    """The label of the band that a distance lies in: [lower, upper), the last up to the limit; null is beyond it."""
    out, lower = F.when(distance.isNull(), f">{limit:g}m_or_none"), 0.0
    for upper in bounds:
        out, lower = out.when(distance < upper, f"{lower:g}-{upper:g}m"), upper
    return out.otherwise(f"{lower:g}-{limit:g}m")


def search_quality(hits: DataFrame, cases: DataFrame) -> DataFrame:
    """(query_id, category, rank, passed): where the first expected place stands among a query's hits, and whether that is soon enough.

    hits: (query_id, rank, place_id); cases: (query_id, category, expected, within), expected an array of places.
    """
    wanted = cases.select("query_id", F.explode("expected").alias("place_id")).distinct()
    first = hits.join(wanted, ["query_id", "place_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    out = cases.join(first, "query_id", "left")
    return out.select("query_id", "category", "rank", F.coalesce(F.col("rank") <= F.col("within"), F.lit(False)).alias("passed"))


def candidate_recall(truth: DataFrame, candidates: DataFrame, record: str, element: str) -> DataFrame:
    """(labelled, among_candidates, recall): whether labelled elements are among the candidates; both are pairs (record, element)."""
    found = truth.select(record, element).distinct().join(candidates.select(record, element).distinct().withColumn("_f", F.lit(1)), [record, element], "left")
    return found.agg(F.count("*").alias("labelled"), F.count("_f").alias("among_candidates"), F.try_divide(F.count("_f"), F.count("*")).alias("recall"))


def metrics_by_group(records: DataFrame, truth: Column, predicted: Column, groups: Column) -> DataFrame:
    """(group, records, exact, tp, fp, fn, precision, recall, f1) for each of the groups (an array) that a record belongs to."""
    rows = records.select(pair_counts(truth, predicted).alias("p"), groups.alias("g")).select("p", F.explode("g").alias("group"))
    sums = rows.groupBy("group").agg(F.count("*").alias("records"), F.count_if(F.col("p.outcome") == "exact").alias("exact"), *(F.sum(f"p.{c}").alias(c) for c in ("tp", "fp", "fn")))
    return sums.withColumn("m", precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))).select("group", "records", "exact", "tp", "fp", "fn", "m.precision", "m.recall", "m.f1")


def representative(pieces: DataFrame, group: str, is_path: Column, length: str, inside: Column, key: str) -> DataFrame:
    """(group, key): the piece that stands for a stretch: of those whose middle is inside the region a road before a path, the longest first."""
    best = F.min(F.struct(is_path.alias("path"), (-F.col(length)).alias("neg"), F.col(key).alias("key")))
    return pieces.filter(inside).groupBy(group).agg(best.alias("b")).select(group, F.col("b.key").alias(key))


def updated(rows: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """rows with the columns of the changes' rows of the same key, nulls included; others stay. changes has one row a key."""
    new = changes.select(F.col(key).alias("_k"), *(F.col(c).alias(f"_{c}") for c in columns), F.lit(True).alias("_hit"))
    out = rows.join(new, F.col(key) == F.col("_k"), "left")
    return out.withColumns({c: F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)) for c in columns}).drop("_k", "_hit", *(f"_{c}" for c in columns))


def with_derived_grade(edges: DataFrame, heights: DataFrame) -> DataFrame:
    """edges (src, dst, length_m, ...) with derived_grade from the heights (node_id, elevation_m, resolution_m) of both ends, null where one is unknown."""
    out = edges
    for end in ("src", "dst"):
        out = out.join(heights.select(F.col("node_id").alias(end), F.col("elevation_m").alias(f"_{end}_m"), F.col("resolution_m").alias(f"_{end}_r")), end, "left")
    return out.withColumn("derived_grade", derived_grade(F.col("_src_m"), F.col("_dst_m"), F.col("length_m"), F.col("_src_r"))).drop("_src_m", "_src_r", "_dst_m", "_dst_r")


def within_span(requests: DataFrame, limit_m: float = MAX_SPAN_M) -> DataFrame:
    """requests (o_lon, o_lat, d_lon, d_lat, ...) with span_m and whether it is no longer than the limit."""
    span = geodesic_m(F.col("o_lon"), F.col("o_lat"), F.col("d_lon"), F.col("d_lat"))
    return requests.withColumn("span_m", span).withColumn("within_span", F.col("span_m") <= limit_m)


def grade_beyond(value: Column, threshold: Column) -> Column:
    """The number with as few decimals, one or two, as show that it is above the threshold; else in full."""
    one, two = F.format_string("%.1f", value), F.format_string("%.2f", value)
    return F.when(one.cast("double") > threshold, one).when(two.cast("double") > threshold, two).otherwise(value.cast("string"))


def publication_sequence(rows: DataFrame, key: str, at: str) -> DataFrame:
    """(key, first, last, n): the first and last publication of each key, ties within a day being one."""
    day = F.to_date(at)
    return rows.groupBy(key).agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count_distinct(day).alias("n"))


def nth_of_order(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group in an order, numbered."""
    return rows.withColumn("nth", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col("nth") <= n)
