"""Contiguous, byte-balanced shards from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import stored

ROW_OVERHEAD = 8
"""Bytes counted for a row besides its text."""


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32) of each row; a null text counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + ROW_OVERHEAD).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))


def balanced_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's shard, its slot there and its byte size.

    Rows are ordered by (doc_id, crc32 of the text, size). Ranges of that order become partitions; each
    partition's total and count are summed, and the prefix sums of those few totals turn a running sum inside
    a partition into a global byte offset. A row goes to the shard whose equal share of all bytes holds the
    row's middle byte, so shards are contiguous and miss their target by half a row at each end. Only
    (doc_id, size, crc) move between tasks, never texts.

    Null ids sort first; rows with the same id, size and crc32 are interchangeable. A null text has size
    8 and crc32 0. An empty table gives no rows. Other columns of docs are ignored.
    """
    spark = docs.sparkSession
    small = stored(sized(docs, id_col, text_col))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32").asc(), F.col("size").asc()]
    ranged = stored(small.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    # One row for each partition: the only data that a single task sees.
    starts = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(W.partitionBy()).alias("all_bytes"),
    )
    inside = W.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("run", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .withColumn("nth", F.row_number().over(inside))
        .join(starts, "part")
        .withColumn("middle2", 2 * (F.col("bytes_before") + F.col("run")) - F.col("size"))
        .withColumn("shard", F.expr(f"least({n_shards - 1}, middle2 * {n_shards} div (2 * all_bytes))").cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (F.col("rows_before") + F.col("nth") - 1).alias("row"))
    )
    placed = stored(placed)
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first"))  # n_shards rows at most
    return placed.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))
