"""Reading and writing tables with checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..schemas import differences

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def ndjson(spark: SparkSession, path: str, contract: T.StructType) -> DataFrame:
    """JSON lines of a declared schema; lines that don't parse are in _corrupt_record."""
    schema = T.StructType([*contract.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def checked(df: DataFrame, contract: T.StructType) -> DataFrame:
    """df, if it has every column of the contract with its type."""
    bad = [d for d in differences(df.schema, contract) if d[1] != "additional"]
    if bad:
        raise ValueError(f"the table breaks its contract: {bad}")
    return df


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def write_sorted(df: DataFrame, path: str, keys: list[str], partitions: int | None = None) -> None:
    """Parquet, zstd, range-partitioned and sorted by keys."""
    ranged = df.repartitionByRange(partitions, *keys) if partitions else df.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).write.option("compression", "zstd").parquet(path)


def write_canonical_json(df: DataFrame, path: str, keys: list[str]) -> None:
    """JSON lines with fields in name order, sorted by keys."""
    ordered = df.select(*sorted(df.columns))
    ordered.orderBy(*keys).select(F.to_json(F.struct(*ordered.columns)).alias("value")).write.text(path)
