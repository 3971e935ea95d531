"""Evaluation statistics, sampling and tuning."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

Z95 = 1.959963984540054
MAX_SETTINGS = 10_000


def wilson(successes: Column, trials: Column, z: float = Z95) -> Column:
    """struct(low, high): Wilson's interval of a share; null without trials."""
    n, p = trials.cast("double"), F.try_divide(successes.cast("double"), trials.cast("double"))
    middle = p + z * z / (2 * n)
    half = F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) * z
    scale = 1 + z * z / n
    return F.when(trials > 0, F.struct(((middle - half) / scale).alias("low"), ((middle + half) / scale).alias("high")))


def precision_recall(tp: Column, fp: Column, fn: Column) -> Column:
    """struct(precision, recall, f1), each null where its denominator is 0."""
    return F.struct(F.try_divide(tp, tp + fp).alias("precision"), F.try_divide(tp, tp + fn).alias("recall"), F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"))


def pair_counts(truth: Column, predicted: Column) -> Column:
    """struct(tp, fp, fn, outcome) of two arrays taken as sets."""
    a, b = F.array_distinct(truth), F.array_distinct(predicted)
    tp = F.size(F.array_intersect(a, b))
    kind = F.when(F.array_sort(a) == F.array_sort(b), "exact").when(F.arrays_overlap(a, b), "partial").when(F.size(b) == 0, "missed").when(F.size(a) == 0, "invented").otherwise("wrong")
    return F.struct(tp.alias("tp"), (F.size(b) - tp).alias("fp"), (F.size(a) - tp).alias("fn"), kind.alias("outcome"))


def confusion(pairs: DataFrame, first: str, second: str) -> DataFrame:
    return pairs.groupBy(first, second).agg(F.count("*").alias("n"))


def _draw_weight(key: Column, draw: Column) -> Column:
    """A Poisson(1) count from the md5 of key:draw: 52 bits of it as a number in [0, 1), met with the cumulated probabilities.

    Small hexadecimal digits sort as the numbers do, so the digest is met with the probabilities' own 13 digits.
    """
    u = F.md5(F.concat_ws(":", key.cast("string"), draw.cast("string")).cast("binary"))
    cuts, p, total = [], math.exp(-1), 0.0
    for k in range(8):
        total += p
        cuts.append(f"{math.ceil(total * (1 << 52)):013x}")
        p /= k + 1
    return sum((F.when(u >= c, 1).otherwise(0) for c in cuts), F.lit(0))


def bootstrap(records: DataFrame, key: str, draws: int = 2000, level: float = 0.95) -> DataFrame:
    """(measure, low, high): percentile intervals of precision, recall and F1 under resampling of records (key, tp, fp, fn).

    Each record gets its own count in each draw (see _draw_weight), so no draw needs the number of records and all draws are one grouped
    sum over draws keys with partial aggregation. A draw without a measure's denominator doesn't count for it. Records that add nothing to
    any sum aren't drawn. Counts of 0 stay in, as a filter would hash each record once more for every probability.
    """
    # A few records are much work: small files would all be one task.
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = records.filter("tp != 0 or fp != 0 or fn != 0").repartition(parts, key).select(key, "tp", "fp", "fn", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("k", _draw_weight(F.col(key), F.col("draw")))
    sums = drawn.groupBy("draw").agg(*(F.sum(F.col(c) * F.col("k")).alias(c) for c in ("tp", "fp", "fn"))).select(precision_recall(F.col("tp"), F.col("fp"), F.col("fn")).alias("m"))
    measures = sums.select(F.explode(F.array(*(F.struct(F.lit(n).alias("measure"), F.col(f"m.{n}").alias("v")) for n in ("precision", "recall", "f1")))).alias("e")).select("e.*")
    return measures.groupBy("measure").agg(F.expr(f"percentile(v, {(1 - level) / 2})").alias("low"), F.expr(f"percentile(v, {(1 + level) / 2})").alias("high"))


def allocated(sizes: DataFrame, target: int, minimum: int = 1) -> DataFrame:
    """sizes (stratum, n) with take: min(n, minimum) first, then rounds that share what is left of target by size among strata with room.

    A round grants the whole part of each share; if no share is whole, one row goes to the largest fraction, the larger stratum, the lesser
    name. Strata are a few named classes: they meet in one row, on which the rounds run.
    """
    one = sizes.groupBy().agg(F.array_sort(F.collect_list(F.struct("stratum", F.col("n").cast("long").alias("n"), F.least(F.col("n"), F.lit(minimum)).cast("long").alias("take")))).alias("s"))

    def total(s: Column, of) -> Column:
        return F.aggregate(s, F.lit(0).cast("long"), lambda a, x: a + of(x))

    def round_(s: Column, _: Column) -> Column:
        left = F.lit(target) - total(s, lambda x: x["take"])
        weight = total(s, lambda x: F.when(x["n"] > x["take"], x["n"]).otherwise(F.lit(0).cast("long")))
        share = lambda x: F.when(x["n"] > x["take"], F.try_divide(left * x["n"], weight)).otherwise(0.0)
        grant = lambda x: F.least(F.floor(share(x)), x["n"] - x["take"]).cast("long")
        given = total(s, grant)
        fraction = F.transform(F.filter(s, lambda x: x["n"] > x["take"]), lambda x: F.struct((F.floor(share(x)) - share(x)).alias("f"), (-x["n"]).alias("n"), x["stratum"].alias("stratum")))
        best = F.array_min(fraction)["stratum"]
        add = lambda x: F.when(given > 0, grant(x)).when(x["stratum"].eqNullSafe(best), F.lit(1).cast("long")).otherwise(F.lit(0).cast("long"))
        grown = F.transform(s, lambda x: F.struct(x["stratum"].alias("stratum"), x["n"].alias("n"), (x["take"] + add(x)).alias("take")))
        return F.when((left > 0) & (weight > 0), grown).otherwise(s)

    return one.select(F.explode(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, target))), F.col("s"), round_)).alias("s")).select("s.*")


def hash_draw(rows: DataFrame, stratum: str, key: str, take: int, seed: str) -> DataFrame:
    """take rows of each stratum by the order of sha256(seed:key): the same rows on every run."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")), 256)
    return rows.withColumn("draw_key", order).withColumn("draw", F.row_number().over(W.partitionBy(stratum).orderBy("draw_key"))).filter(F.col("draw") <= take)


def tuned(rows: DataFrame, grid: DataFrame, predicted: Column, truth: Column, parameters: Sequence[str]) -> DataFrame:
    """grid with tp, fp, fn and f1 of each setting, and best: highest f1, then fewest false positives, then least parameters.

    The grid (MAX_SETTINGS rows at most, which is checked) is broadcast; every row meets every setting, with partial sums before the shuffle.
    """
    if grid.limit(MAX_SETTINGS + 1).count() > MAX_SETTINGS:
        raise ValueError(f"more than {MAX_SETTINGS} settings")
    hits = rows.crossJoin(F.broadcast(grid)).groupBy(*parameters).agg(F.count_if(predicted & truth).alias("tp"), F.count_if(predicted & ~truth).alias("fp"), F.count_if(~predicted & truth).alias("fn"))
    scored = hits.withColumn("f1", precision_recall(F.col("tp"), F.col("fp"), F.col("fn"))["f1"])
    order = W.orderBy(F.col("f1").desc_nulls_last(), "fp", *parameters)
    return scored.withColumn("best", F.row_number().over(order) == 1)
