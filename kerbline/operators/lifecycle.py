"""Versions of a network: checks, content hashes, manifests and activation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .aggregates import content_hash
from .joins import missing_endpoints

MANIFEST = "dataset_id string, region string, status string, n_nodes long, n_edges long, content_sha256 string, reason string, at timestamp"


def findings(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(code, severity, n) of everything wrong with a network."""
    def found(rows: DataFrame, code: str, severity: str) -> DataFrame:
        return rows.agg(F.count("*").alias("n")).select(F.lit(code).alias("code"), F.lit(severity).alias("severity"), "n")

    checks = [
        found(nodes.groupBy("node_id").count().filter("count > 1"), "duplicate_node", "error"),
        found(edges.groupBy("segment_id").count().filter("count > 1"), "duplicate_segment", "error"),
        found(missing_endpoints(edges, nodes), "missing_endpoint", "error"),
        found(edges.filter("length_m is null or length_m <= 0"), "bad_length", "error"),
        found(edges.filter("src = dst"), "loop", "warning"),
        found(nodes.filter("not (lon between -180 and 180 and lat between -90 and 90)"), "implausible_position", "error"),
    ]
    return reduce(DataFrame.union, checks).filter("n > 0")


def network_hash(nodes: DataFrame, edges: DataFrame) -> str:
    """The content hash of both tables, whatever their row order."""
    a = content_hash(nodes, ["node_id"], sorted(set(nodes.columns) - {"node_id"})).first()["content_sha256"]
    b = content_hash(edges, ["segment_id"], sorted(set(edges.columns) - {"segment_id"})).first()["content_sha256"]
    return f"{a}{b}"


def record(spark: SparkSession, manifest: str, **row) -> None:
    """Appends one event to the manifest table; nothing in it is ever rewritten."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    one = spark.createDataFrame([tuple(row.get(n) for n in names)], MANIFEST)
    one.withColumn("at", F.coalesce("at", F.current_timestamp())).coalesce(1).write.mode("append").parquet(manifest)


def seal(spark: SparkSession, root: str, dataset_id: str, region: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Writes a version into a new folder of its own and records it as sealed, unless there are errors; returns the findings."""
    report = findings(nodes, edges).cache()
    if not report.filter("severity = 'error'").limit(1).count():
        nodes.write.mode("error").parquet(f"{root}/{dataset_id}/nodes")
        edges.write.mode("error").parquet(f"{root}/{dataset_id}/edges")
        kept = [spark.read.parquet(f"{root}/{dataset_id}/{t}") for t in ("nodes", "edges")]
        record(spark, f"{root}/manifest", dataset_id=dataset_id, region=region, status="sealed", n_nodes=kept[0].count(), n_edges=kept[1].count(), content_sha256=network_hash(*kept))
    return report


def active(spark: SparkSession, root: str, region: str) -> str | None:
    """The dataset that the region's last activation named."""
    last = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").filter((F.col("region") == region) & (F.col("status") == "active")).agg(F.max_by("dataset_id", "at").alias("d")).first()
    return last["d"]


def activate(spark: SparkSession, root: str, region: str, dataset_id: str, reason: str) -> None:
    """Makes a sealed version the region's active one, after its stored rows hash to what was sealed. Rolling back is activating an older one."""
    sealed = spark.read.schema(MANIFEST).parquet(f"{root}/manifest").filter((F.col("dataset_id") == dataset_id) & (F.col("region") == region) & (F.col("status") == "sealed")).first()
    if sealed is None:
        raise ValueError(f"{dataset_id} isn't a sealed version of {region}")
    now = network_hash(*(spark.read.parquet(f"{root}/{dataset_id}/{t}") for t in ("nodes", "edges")))
    if now != sealed["content_sha256"]:
        raise ValueError(f"{dataset_id} no longer has the content that was sealed")
    record(spark, f"{root}/manifest", dataset_id=dataset_id, region=region, status="active", content_sha256=now, reason=reason)


def regression(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str] = ("request", "profile"), tolerance: float = 0.01) -> DataFrame:
    """(keys, change) of routes whose outcome differs between two versions."""
    b = baseline.select(*keys, F.col("cost").alias("_cost"), F.col("path").alias("_path"))
    change = F.when(F.col("cost").isNull() & F.col("_cost").isNull(), None).when(F.col("_cost").isNull(), "new_route").when(F.col("cost").isNull(), "lost_route").when(F.abs(F.col("cost") - F.col("_cost")) > tolerance, "cost").when(~F.col("path").eqNullSafe(F.col("_path")), "path")
    return candidate.join(b, list(keys), "full_outer").withColumn("change", change).filter("change is not null").select(*keys, "change")
