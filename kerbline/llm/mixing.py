"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import stored

MAX_REPEATS = 3
ROWS_PER_BUCKET = 1_000
"""Aimed-at rows in a bucket of a source: a hot source gets more buckets, not larger ones."""

CURRICULUM: dict[int, Sequence[tuple[float, float]]] = {
    1: ((0.0, 1.5), (1.0, 0.5)),
    2: ((0.0, 1.0), (1.0, 1.0)),
    3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)),
}
"""Weight of a source through training, by its weight class: (time, factor) knots, linear between them."""


def word_count(text: Column) -> Column:
    """Runs of characters other than space and \\t to \\r; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_size(docs: DataFrame, seed: int) -> DataFrame:
    """docs with mix_size, and mix_key: 60 bits of a hash of doc_id that order a source's stream."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return docs.withColumns({"mix_size": word_count(F.col("text")), "mix_key": F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")})


def targets(sized: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """A row for each source: weight class, size, rows and target.

    Sources in code point order, null last, weigh 1, 2, 3, 1, ... and share all words by weight. A target stops at
    max_repeats times its source's size and the excess is reshared by weight: with sources in order of
    cap / weight, the capped ones are a prefix, so running sums find the common level without a loop.
    """
    n = sized.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count("*").alias("source_rows"))
    n = n.withColumn("weight", ((F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1).cast("int"))
    n = n.withColumns({"cap": max_repeats * F.col("source_size"), "total": F.sum("source_size").over(W.partitionBy())})
    by = W.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    n = n.withColumns({
        "nth": F.row_number().over(by),
        "capped": F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
        "weight_left": F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)),
    })
    n = n.withColumn("level", (F.col("total") - F.col("capped")) / F.col("weight_left"))
    n = n.withColumn("open", F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("nth", "level")))
    n = n.withColumn("first_open", F.min("open").over(W.partitionBy()))
    share = F.col("first_open.level") * F.col("weight")
    n = n.withColumn("target", F.when(F.col("nth") < F.col("first_open.nth"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.col("cap").cast("double"))))
    return n.select("source", "weight", "source_size", "source_rows", "target")


def training_time(fraction: Column, weight: Column, curriculum: Mapping[int, Sequence[tuple[float, float]]] = CURRICULUM) -> Column:
    """The time in [0, 1] by which a source of that weight class has supplied that fraction of its words.

    The schedule is integrated piece by piece (a quadratic in each) and the integral is inverted in closed form.
    """
    out = F.lit(None).cast("double")
    for w, knots in curriculum.items():
        pieces, done = [], 0.0
        for (t0, f0), (t1, f1) in zip(knots, knots[1:], strict=False):
            pieces.append((t0, f0, (f1 - f0) / (t1 - t0), done))
            done += (f0 + f1) / 2 * (t1 - t0)
        inverse = F.lit(None).cast("double")
        for t0, f0, slope, start in pieces:  # later pieces come to stand in front
            y = fraction * F.lit(done) - F.lit(start)
            step = y / F.lit(f0) if slope == 0 else (F.sqrt(F.lit(f0 * f0) + F.lit(2 * slope) * y) - F.lit(f0)) / F.lit(slope)
            inverse = F.when(fraction * F.lit(done) >= F.lit(start), F.lit(t0) + step).otherwise(inverse)
        out = F.when(weight == w, inverse).otherwise(out)
    return out


def mix_plan(docs: DataFrame, seed: int = 17, max_repeats: int = MAX_REPEATS, carry: bool = False) -> DataFrame:
    """How many words of each document the mix takes, and when.

    Each source is a stream of its documents in hash order, repeated up to max_repeats times; the mix takes its
    first round(target) words, so the last document may be taken in part. Offsets in the stream are prefix
    sums in two levels: totals of hash-range buckets (about ROWS_PER_BUCKET rows each, whatever the source's
    size), then a running sum inside a bucket.

    Returns doc_id, size, source_size, target, taken, and mix_offset, mix_take, mix_weight for training_order;
    with carry also all columns of docs, which must then have none of these names.

    A null text has size 0. Null sources form one source, last in order. A null doc_id hashes like an empty
    one. Repeated ids are separate rows, ordered by size; rows equal in id and size are interchangeable. If
    all texts are empty every target is 0. An empty table gives no rows.
    """
    sized = with_size(docs.select(*(docs.columns if carry else ("doc_id", "source", "text"))), seed)
    small = stored(sized.select("doc_id", "source", "mix_size", "mix_key"))
    per_source = stored(targets(small, max_repeats))  # one row for each source

    def bucketed(rows: DataFrame) -> DataFrame:
        s = per_source.withColumnRenamed("source", "mix_source")
        spread = F.floor(F.col("mix_key") / F.lit(float(1 << 60)) * F.ceil(F.col("source_rows") / ROWS_PER_BUCKET))
        return rows.join(s, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source").withColumn("mix_bucket", spread)

    totals = bucketed(small).groupBy("source", "mix_bucket").agg(F.sum("mix_size").alias("mix_words"))
    before = W.partitionBy("source").orderBy("mix_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("s"), F.col("mix_bucket").alias("b"), F.coalesce(F.sum("mix_words").over(before), F.lit(0)).alias("mix_start"))
    rows = bucketed(sized if carry else small)
    rows = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("mix_bucket") == F.col("b")))
    inside = W.partitionBy("source", "mix_bucket").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("mix_offset", F.col("mix_start") + F.sum("mix_size").over(inside) - F.col("mix_size"))
    rows = rows.withColumn("mix_take", F.floor(F.col("target") + 0.5))
    taken = sum((words_of_copy(F.lit(k)) for k in range(max_repeats)), F.lit(0))
    keep = docs.columns if carry else ["doc_id"]
    return rows.withColumn("taken", taken).select(*keep, F.col("mix_size").alias("size"), "source_size", "target", "taken", "mix_offset", "mix_take", F.col("weight").alias("mix_weight"))


def words_of_copy(k: Column, size: str = "mix_size") -> Column:
    """Words that the mix takes from the k-th pass over a document."""
    left = F.col("mix_take") - k * F.col("source_size") - F.col("mix_offset")
    return F.greatest(F.lit(0), F.least(F.col(size), left))


def position(k: Column, curriculum: Mapping[int, Sequence[tuple[float, float]]] = CURRICULUM) -> Column:
    """Training time of the k-th copy's first word."""
    return training_time(F.try_divide(k * F.col("source_size") + F.col("mix_offset"), F.col("mix_take")), F.col("mix_weight"), curriculum)


def training_order(plan: DataFrame, max_repeats: int = MAX_REPEATS, curriculum: Mapping[int, Sequence[tuple[float, float]]] = CURRICULUM) -> DataFrame:
    """A row for each copy that the mix takes (with mix_copy, mix_words, mix_time), range-sorted by time."""
    copies = plan.filter("taken > 0").withColumn("mix_copy", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))))
    copies = copies.withColumn("mix_words", words_of_copy(F.col("mix_copy"), "size")).filter("mix_words > 0")
    return copies.withColumn("mix_time", position(F.col("mix_copy"), curriculum)).orderBy("mix_time", "doc_id", "mix_copy")


def mix_documents(docs: DataFrame, seed: int = 17, order_columns: bool = False) -> DataFrame:
    """The mixed corpus: the columns of docs, a row for each copy taken, in training order.

    With order_columns also mix_time, and mix_row, which increases along the training order and so keeps it through a table: see
    positions. Columns of docs with these names are replaced then; other columns may have any name.

    A document that the end of its source's budget cuts is kept whole. Null texts and texts without words are never taken; null ids and null
    sources are; of repeated rows each is a document of its own. An empty table gives no rows.
    """
    extra = ["mix_time", "mix_row"] if order_columns else []
    keep = [c for c in docs.columns if c not in extra]
    clash = {c: f"docs_{i}" for i, c in enumerate(keep) if c not in ("doc_id", "source", "text")}
    plan = mix_plan(docs.select(*keep).withColumnsRenamed(clash), seed, carry=True)
    ordered = training_order(plan)
    if order_columns:
        ordered = ordered.withColumn("mix_row", F.monotonically_increasing_id())
    return ordered.select(*(F.col(clash.get(c, c)).alias(c) for c in keep), *extra)


def positions(mixed: DataFrame) -> DataFrame:
    """mixed, a stored table with mix_row, with position: its rank, from 0 without gaps.

    mix_row holds the number of the partition that wrote a row, above 33 bits of the row's number there, so the rows of each partition
    are counted (one row each, which are broadcast) and their prefix sums make up the rank.
    """
    part = F.shiftright("mix_row", 33)
    counts = mixed.select(part.alias("mix_part")).groupBy("mix_part").agg(F.count("*").alias("n"))
    before = counts.select("mix_part", F.coalesce(F.sum("n").over(W.orderBy("mix_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("mix_before"))
    rows = mixed.withColumn("mix_part", part).join(F.broadcast(before), "mix_part")
    return rows.withColumn("position", F.col("mix_before") + F.col("mix_row").bitwiseAND((1 << 33) - 1)).drop("mix_part", "mix_before", "mix_row")
