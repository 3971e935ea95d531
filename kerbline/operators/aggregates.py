"""Coverage, counts, quantiles, modes and content hashes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..storage import stored
from .windows import global_rank

RANK_BINS = 4096
BUCKET_ROWS = 50_000


def class_coverage(rows: DataFrame, columns: Sequence[str], unknown: str = "unknown") -> DataFrame:
    """(attribute, value, n, known) for several categorical columns in one pass: rows are unpivoted, then counted with partial sums."""
    long = rows.select(F.explode(F.array(*(F.struct(F.lit(c).alias("attribute"), F.coalesce(F.col(c).cast("string"), F.lit(unknown)).alias("value")) for c in columns))).alias("r")).select("r.*")
    return long.groupBy("attribute", "value").agg(F.count("*").alias("n")).withColumn("known", F.col("value") != unknown)


def rule_counts(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, n): how many rows break each named rule; one pass, a row a rule."""
    one = rows.agg(*(F.count_if(c).alias(k) for k, c in rules.items()))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules))).alias("r")).select("r.*")


def value_counts(rows: DataFrame, column: str, top: int | None = None, rest: str = "(other)") -> DataFrame:
    """(value, n, rank) by falling count, then value; beyond top, one row sums the rest.

    Ranks are over distinct values, which are counted before they are sorted.
    """
    counts = rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    ranked = global_rank(counts, [F.col("n").desc(), F.col("value").asc_nulls_last()]).withColumn("rank", F.col("rank").cast("int"))
    if top is None:
        return ranked
    kept = F.col("rank") <= top
    return ranked.groupBy(F.when(kept, F.col("value")).otherwise(rest).alias("value"), F.when(kept, F.col("rank")).otherwise(top + 1).alias("rank")).agg(F.sum("n").alias("n")).select("value", "n", "rank")


def modal(rows: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """The commonest value of a column in each group; ties go to the least value."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col(column).alias("value"))).alias("best")
    return counts.groupBy(*keys).agg(best).select(*keys, F.col("best.value").alias(column), (-F.col("best.neg")).alias("n"))


def nearest_rank(rows: DataFrame, keys: Sequence[str], column: str, quantiles: Sequence[float]) -> DataFrame:
    """Values at rank ceil(q * n), at least 1, of each group.

    Distinct values are counted first. Their range in a group is cut into RANK_BINS bins of equal width, whose counts tell the bin of each
    rank; only the values of those bins meet in a window, with their counts.
    """
    counts = stored(rows.filter(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c")))
    number = F.col("_v").cast("double")
    span = counts.groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.sum("_c").alias("_n"))
    width = (number - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    binned = counts.join(span, list(keys)).withColumn("_bin", F.coalesce(F.least(F.floor(width * RANK_BINS), F.lit(RANK_BINS - 1)), F.lit(0)))
    bins = binned.groupBy(*keys, "_bin", "_n").agg(F.sum("_c").alias("_b"))
    upto = F.sum("_b").over(W.partitionBy(*keys).orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
    wanted = F.explode(F.array(*(F.struct(F.lit(i).alias("_q"), F.greatest(F.lit(1), F.ceil(F.col("_n") * q)).cast("long").alias("_r")) for i, q in enumerate(quantiles)))).alias("_w")
    hit = bins.withColumns({"_upto": upto}).withColumn("_before", F.col("_upto") - F.col("_b")).select(*keys, "_bin", "_before", "_upto", wanted).select("*", "_w.*").filter("_r > _before and _r <= _upto")
    inside = W.partitionBy(*keys, "_bin", "_q").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    near = binned.select(*keys, "_bin", "_v", "_c").join(hit.select(*keys, "_bin", "_before", "_q", "_r"), [*keys, "_bin"]).withColumn("_at", F.col("_before") + F.sum("_c").over(inside))
    found = near.filter("_at >= _r").groupBy(*keys, "_q").agg(F.min("_v").alias("_v"))
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("_q") == i, F.col("_v"))).alias(f"p{round(q * 100)}") for i, q in enumerate(quantiles)))


def content_hash(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row: n and a hash of the rows that doesn't depend on their order.

    Rows are hashed one by one; hashes are sorted and hashed again in buckets by their first digits, then the buckets' hashes. There is a
    bucket for each BUCKET_ROWS rows, so what a task sorts doesn't grow; the number of rows, and with it of buckets, is part of the content.
    """
    null = F.lit("\u0000")
    row = F.sha2(F.concat_ws("\u001f", *(F.coalesce(F.col(c).cast("string"), null) for c in (*keys, *columns))), 256)
    hashed = stored(rows.select(row.alias("h")))
    buckets = max(1, -(-hashed.count() // BUCKET_ROWS))
    part = hashed.withColumn("bucket", F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("long"), F.lit(buckets)))
    part = part.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("h"))
    return part.agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "h"))), lambda p: p["h"]), ""), 256).alias("content_sha256"))


def shares(rows: DataFrame, unit: str, length: str = "length_m") -> DataFrame:
    """rows with unit_share: a piece's part of its unit's length; rows without a unit have 1.

    Units' lengths are summed map-side and joined back; rows without a unit, which may be most, stay where they are.
    """
    named = rows.filter(F.col(unit).isNotNull())
    totals = named.groupBy(unit).agg(F.sum(length).alias("_total"))
    share = F.coalesce(F.try_divide(F.col(length), F.col("_total")), F.lit(1.0))
    known = named.join(totals, unit).withColumn("unit_share", share)
    columns = [*(c for c in rows.columns if c != "unit_share"), "unit_share"]
    return known.select(*columns).unionByName(rows.filter(F.col(unit).isNull()).withColumn("unit_share", F.lit(1.0)).select(*columns))


def best_of(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_i", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_i = 1").drop("_i")
