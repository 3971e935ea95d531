"""Contracts of external tables: missing, additional and mismatched columns, through arrays and structs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T


def differences(found: T.DataType, wanted: T.DataType, path: str = "") -> list[tuple[str, str, str]]:
    """(path, problem, detail) of every difference between two types."""
    if isinstance(wanted, T.StructType) and isinstance(found, T.StructType):
        out = [(f"{path}{f.name}", "missing", f.dataType.simpleString()) for f in wanted if f.name not in found.names]
        out += [(f"{path}{f.name}", "additional", f.dataType.simpleString()) for f in found if f.name not in wanted.names]
        for f in wanted:
            if f.name in found.names:
                out += differences(found[f.name].dataType, f.dataType, f"{path}{f.name}.")
        return out
    if isinstance(wanted, T.ArrayType) and isinstance(found, T.ArrayType):
        return differences(found.elementType, wanted.elementType, f"{path}[].")
    if isinstance(wanted, T.MapType) and isinstance(found, T.MapType):
        return differences(found.valueType, wanted.valueType, f"{path}{{}}.")
    return [] if found == wanted else [(path.rstrip("."), "mismatched", f"{found.simpleString()}, not {wanted.simpleString()}")]


def check(spark: SparkSession, table: DataFrame, contract: T.StructType) -> DataFrame:
    """(column, problem, detail) of a table against its contract."""
    return spark.createDataFrame(sorted(differences(table.schema, contract)), "column string, problem string, detail string")
