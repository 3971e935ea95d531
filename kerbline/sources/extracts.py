"""Region extracts: partitioned change logs, row-group estimates from Parquet footers, and loads that verify their manifest."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .tables import checked

Box = tuple[float, float, float, float]
FORMAT = 1
PIECE_BYTES = 32 << 20
"""Bytes of a file that are hashed as one piece."""
VOLATILE = ("created_at", "host", "seconds", "content_sha256")
"""Keys of a manifest that its hash leaves out."""


def write_changelog(changes: DataFrame, path: str) -> None:
    """changes (id, type, change_type, columns_changed, bbox) as Parquet in folders by type and change type, sorted by id in each."""
    spread = changes.repartition("type", "change_type", F.pmod(F.xxhash64("id"), F.lit(8)))  # a hot type isn't one task
    spread.sortWithinPartitions("type", "change_type", "id").write.partitionBy("type", "change_type").parquet(path)


def changelog_scan(spark: SparkSession, path: str, box: Box, wanted: DataFrame | None = None) -> DataFrame:
    """(id, type, change_type, columns_changed, bbox) of the changes whose bbox meets the box.

    wanted: (type, change_type) to read, from any table: a small one becomes a dynamic filter on the folders, so that others aren't
    opened. The four comparisons of the box reach the row groups' statistics.
    """
    rows = spark.read.parquet(path).filter(_meets(box))
    if wanted is not None:
        rows = rows.join(wanted.select("type", "change_type").distinct(), ["type", "change_type"], "left_semi")
    return rows.select("id", "type", "change_type", "columns_changed", "bbox")


def _meets(box: Box) -> Column:
    return (F.col("bbox.xmin") <= box[2]) & (F.col("bbox.xmax") >= box[0]) & (F.col("bbox.ymin") <= box[3]) & (F.col("bbox.ymax") >= box[1])


def parquet_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of the Parquet files of a table, partitioned ones included; their content isn't read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path)
    return found.select("path", "length")


def row_groups(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_group, n, xmin, xmax, ymin, ymax): rows of each row group and the bounds of its bbox columns, null where the footer has none.

    Files' footers are read by tasks, a share of the files each; no row is.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                system, at = pafs.FileSystem.from_uri(path)
                with system.open_input_file(at) as f:
                    footer = pq.ParquetFile(f).metadata
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    bounds: dict[str, float | None] = {}
                    for c in range(group.num_columns):
                        column = group.column(c)
                        if column.path_in_schema.startswith("bbox."):
                            stats, axis = column.statistics, column.path_in_schema[5:]
                            known = stats is not None and stats.has_min_max
                            bounds[axis] = float(stats.min if axis.endswith("min") else stats.max) if known else None
                    rows.append((path, g, group.num_rows, *(bounds.get(k) for k in ("xmin", "xmax", "ymin", "ymax"))))
            kinds = (pa.string(), pa.int32(), pa.int64(), *[pa.float64()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["file", "row_group", "n", "xmin", "xmax", "ymin", "ymax"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return parquet_files(spark, path).repartition(parts, "path").mapInArrow(read, "file string, row_group int, n long, xmin double, xmax double, ymin double, ymax double")


def estimate(groups: DataFrame, boxes: DataFrame) -> DataFrame:
    """(box_id, candidate_rows, all_rows, unknown_groups): the rows of row groups that a box can't exclude, from row_groups().

    boxes: (box_id, x0, y0, x1, y1), a few, at most 10,000 (checked), so they go to every task. Groups without statistics can't be excluded.
    """
    if boxes.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 boxes")
    known = F.col("xmin").isNotNull() & F.col("xmax").isNotNull() & F.col("ymin").isNotNull() & F.col("ymax").isNotNull()
    meets = (F.col("xmin") <= F.col("x1")) & (F.col("xmax") >= F.col("x0")) & (F.col("ymin") <= F.col("y1")) & (F.col("ymax") >= F.col("y0"))
    pairs = groups.crossJoin(F.broadcast(boxes))
    return pairs.groupBy("box_id").agg(F.sum(F.when(~known | meets, F.col("n")).otherwise(0)).alias("candidate_rows"), F.sum("n").alias("all_rows"), F.count_if(~known).alias("unknown_groups"))


def piece_hashes(spark: SparkSession, path: str, piece: int = PIECE_BYTES) -> DataFrame:
    """(path, length, sha256): of each file, the SHA-256 of its pieces' SHA-256 in order, so that large files are hashed by many tasks.

    A row is a piece's place, never its content; a file has one list of 32 bytes for each 32 MB.
    """
    files = parquet_files(spark, path)
    places = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.col("length") - 1), F.lit(piece).cast("long"))).alias("start"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, at = pafs.FileSystem.from_uri(file)
                with system.open_input_file(at) as f:
                    out.append(hashlib.sha256(f.read_at(piece, start)).hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=["path", "length", "start", "digest"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashed = places.repartition(parts, "path", "start").mapInArrow(digest, "path string, length long, start long, digest string")
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("start", "digest"))), lambda p: p["digest"]), "")
    return hashed.groupBy("path", "length").agg(F.sha2(joined.cast("binary"), 256).alias("sha256"))


def content_sha256(manifest: Mapping) -> str:
    """The hash of a manifest's canonical JSON without its volatile keys."""
    kept = {k: v for k, v in manifest.items() if k not in VOLATILE}
    return hashlib.sha256(json.dumps(kept, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


@dataclass(frozen=True)
class Artifact:
    """A table of an extract: its folder, and the columns that whoever loads it depends on."""

    name: str
    contract: T.StructType


class ExtractMismatchError(ValueError):
    """An extract isn't what its manifest says."""


def _text(spark: SparkSession, path: str) -> str | None:
    found = spark.read.format("binaryFile").load(path).select("content").collect() if _exists(spark, path) else []
    return bytes(found[0]["content"]).decode() if found else None


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _relative(file: str, name: str) -> str:
    """The part of a file's path below the artifact's folder, so that manifests name no machine's paths."""
    return file.rsplit(f"/{name}/", 1)[-1]


def _listed(spark: SparkSession, folder: str, name: str) -> dict[str, str]:
    return {_relative(r["path"], name): r["sha256"] for r in piece_hashes(spark, f"{folder}/{name}").collect()}


def write_manifest(spark: SparkSession, folder: str, release: str, box: Box, artifacts: Sequence[str], facts: Mapping | None = None) -> dict:
    """Writes folder/extract-manifest.json: release, box, each artifact's files and their hashes, rows, and the hash of it all. One name and hash a file."""
    manifest = {
        "extract_version": FORMAT, "release": release, "bounds": list(box), **(facts or {}),
        "artifacts": {name: {"files": _listed(spark, folder, name), "rows": spark.read.parquet(f"{folder}/{name}").count()} for name in artifacts},
    }
    manifest["content_sha256"] = content_sha256(manifest)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/extract-manifest.json")
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(json.dumps(manifest, sort_keys=True, indent=1).encode()))
    finally:
        out.close()
    return manifest


def load_extract(spark: SparkSession, folder: str, artifacts: Sequence[Artifact]) -> tuple[dict, dict[str, DataFrame]]:
    """(manifest, name -> table): an extract, refused if its manifest was edited, a file is missing, new or changed, or a contract broken."""
    try:
        text = _text(spark, f"{folder}/extract-manifest.json")
    except Exception as e:  # a file system that keeps checksums finds a change itself
        raise ExtractMismatchError("the manifest can't be read whole") from e
    if text is None:
        raise ExtractMismatchError(f"{folder} has no manifest")
    manifest = json.loads(text)
    if manifest.get("extract_version") != FORMAT:
        raise ExtractMismatchError(f"format {manifest.get('extract_version')!r} isn't known")
    if manifest.get("content_sha256") != content_sha256(manifest):
        raise ExtractMismatchError("the manifest has been edited")
    tables = {}
    for artifact in artifacts:
        if artifact.name not in manifest["artifacts"]:
            raise ExtractMismatchError(f"the extract has no {artifact.name}")
        said, found = manifest["artifacts"][artifact.name]["files"], _listed(spark, folder, artifact.name) if _exists(spark, f"{folder}/{artifact.name}") else {}
        if said != found:
            raise ExtractMismatchError(f"{artifact.name}: files differ from the manifest: {sorted(k for k in said.keys() | found.keys() if said.get(k) != found.get(k))[:5]}")
        try:
            tables[artifact.name] = checked(spark.read.parquet(f"{folder}/{artifact.name}"), artifact.contract)
        except ValueError as e:
            raise ExtractMismatchError(str(e)) from e
    return manifest, tables


def consistency(features: DataFrame, changes: DataFrame, kind: str) -> DataFrame:
    """(unlogged, unreleased): features without a change that keeps them, and logged ones that the release doesn't hold."""
    logged = changes.filter((F.col("type") == kind) & (F.col("change_type") != "removed")).select("id").distinct()
    held = features.select("id").distinct()
    both = held.withColumn("held", F.lit(True)).join(logged.withColumn("logged", F.lit(True)), "id", "full")
    return both.agg(F.count_if(F.col("logged").isNull()).alias("unlogged"), F.count_if(F.col("held").isNull()).alias("unreleased"))


def first_files(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The rows of a table's first n files by name; only those are opened."""
    names = [r["path"] for r in parquet_files(spark, path).orderBy("path").limit(n).collect()]
    return spark.read.parquet(*names) if names else spark.read.parquet(path).limit(0)


def with_examined(segments: DataFrame, lists: Sequence[str]) -> DataFrame:
    """segments (id, class, subclass, bbox, list columns) with (xmin, ymin, xmax, ymax) and, for each list, whether it has an entry.

    Flags are of sizes alone, so that the scan reads no entry's fields but one.
    """
    flags = [F.coalesce(F.size(c) > 0, F.lit(False)).alias(f"has_{c}") for c in lists]
    return segments.select("id", "class", "subclass", *(F.col(f"bbox.{k}").cast("double").alias(k) for k in ("xmin", "ymin", "xmax", "ymax")), *flags)

