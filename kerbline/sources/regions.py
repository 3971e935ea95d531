"""Tables replaced region by region behind a versioned pointer: a reader sees the old rows or the new ones, never some of each.

A version's rows lie in a folder of their own, by region. A pointer file names, for each region, the folder that serves it; pointers are
numbered, and the one with the highest number holds. Publishing is creating the next number, which only one writer can: another one reads
again what was published meanwhile, and tries the number after it. So a writer that fails, or loses, leaves nothing that a reader sees.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

ATTEMPTS = 100


class _Files:
    """The file system of a root."""

    def __init__(self, spark: SparkSession, root: str):
        self.hadoop = spark._jvm.org.apache.hadoop.fs
        self.root = self.hadoop.Path(root)
        self.system = self.root.getFileSystem(spark._jsc.hadoopConfiguration())
        self.context = self.hadoop.FileContext.getFileContext(self.system.getUri(), spark._jsc.hadoopConfiguration())
        self.no_options = spark._sc._gateway.new_array(getattr(spark._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)

    def names(self, folder: str) -> list[str]:
        where = self.hadoop.Path(self.root, folder)
        return sorted(s.getPath().getName() for s in self.system.listStatus(where)) if self.system.exists(where) else []

    def read(self, name: str) -> dict:
        stream = self.system.open(self.hadoop.Path(self.root, name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, name: str, content: dict) -> bool:
        """Makes a file that isn't there as a whole; False if it is."""
        hidden = self.hadoop.Path(self.root, f"_pointers/.{uuid.uuid4().hex}")
        out = self.system.create(hidden, True)
        out.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        out.close()
        where = self.hadoop.Path(self.root, name)
        try:
            if self.system.exists(where):
                return False
            self.context.rename(hidden, where, self.no_options)  # fails if another writer was faster
            return True
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        finally:
            self.system.delete(hidden, False)

    def delete(self, name: str) -> None:
        self.system.delete(self.hadoop.Path(self.root, name), True)


def _latest(files: _Files) -> int:
    return max((int(n.split(".")[0]) for n in files.names("_pointers") if n[0] != "." and n.endswith(".json")), default=0)


def pointer(spark: SparkSession, root: str, number: int | None = None) -> dict:
    """{"number", "regions": {region: {"version", "rows", ...}}}: the pointer that holds, or an earlier one."""
    files = _Files(spark, root)
    number = _latest(files) if number is None else number
    return files.read(f"_pointers/{number:012d}.json") if number else {"number": 0, "regions": {}}


def replace_regions(spark: SparkSession, root: str, rows: DataFrame, column: str = "region", facts: Mapping | None = None) -> int:
    """Replaces every region that rows name by its rows, all at once; others stay as they are. Returns the pointer's number.

    Rows are written first, by region, into a folder that no pointer names; one row a region is counted and goes to the pointer. Rows
    with a null region are refused. Rows of one region are spread, so a large region isn't one task.
    """
    files = _Files(spark, root)
    version = uuid.uuid4().hex
    path = f"{root}/versions/{version}"
    rows.withColumn("_region", F.when(F.col(column).isNull(), F.raise_error(F.lit("a row without region"))).otherwise(F.col(column).cast("string"))).write.partitionBy("_region").parquet(path)
    counts = spark.read.parquet(path).groupBy(column).agg(F.count("*").alias("n")).collect()
    own = {str(r[column]): {"version": version, "rows": r["n"], **(facts or {})} for r in counts}
    for _ in range(ATTEMPTS):
        last = pointer(spark, root)
        number = last["number"] + 1
        if files.create(f"_pointers/{number:012d}.json", {"number": number, "regions": last["regions"] | own}):
            return number
    raise RuntimeError(f"{root}: {ATTEMPTS} other writers were faster")


def read_regions(spark: SparkSession, root: str, regions: Sequence | None = None, number: int | None = None) -> DataFrame:
    """The rows of the regions (all), as one pointer names them: what is published later doesn't show in this table."""
    named = pointer(spark, root, number)["regions"]
    wanted = named if regions is None else {str(r): named[str(r)] for r in regions if str(r) in named}
    if not wanted:
        raise ValueError(f"{root} has no such region")
    by_version: dict[str, list[str]] = {}
    for region, of in wanted.items():
        by_version.setdefault(of["version"], []).append(region)
    out = None
    for version, names in sorted(by_version.items()):
        part = spark.read.parquet(f"{root}/versions/{version}").filter(F.col("_region").cast("string").isin(names)).drop("_region")
        out = part if out is None else out.unionByName(part)
    return out


def sweep(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes pointers but the last `keep`, and versions that those don't name; a version written for longer than it takes to publish isn't safe from it."""
    files = _Files(spark, root)
    numbers = sorted(int(n.split(".")[0]) for n in files.names("_pointers") if n[0] != "." and n.endswith(".json"))
    used = {of["version"] for n in numbers[-keep:] for of in files.read(f"_pointers/{n:012d}.json")["regions"].values()}
    gone = [v for v in files.names("versions") if v not in used]
    for n in numbers[:-keep]:
        files.delete(f"_pointers/{n:012d}.json")
    for v in gone:
        files.delete(f"versions/{v}")
    return gone
