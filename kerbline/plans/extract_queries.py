"""Named queries of change logs, footers and verified extracts over the test tables, with their SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..sources import extracts
from ..sources.tables import table
from ..storage import scratch_folder

BOXES = ((0, 10.0, 5.0, 30.0, 25.0), (1, 0.0, 0.0, 200.0, 200.0), (2, 500.0, 500.0, 600.0, 600.0))
PART_ROWS = 500_000
"""Rows that a task sorts and writes."""


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as changes: the priority is the type, the status the change, and customer and key make the box."""
    x, y = (F.col("o_custkey") % 100).cast("double"), (F.col("o_orderkey") % 80).cast("double")
    box = F.struct(x.alias("xmin"), (x + 1.5).alias("xmax"), y.alias("ymin"), (y + 0.5).alias("ymax")).alias("bbox")
    change = F.when(F.col("o_orderstatus") == "F", "removed").when(F.col("o_orderstatus") == "O", "added").otherwise("data_changed")
    return table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.lower(F.substring("o_orderpriority", 3, 6)).alias("type"), change.alias("change_type"), F.array("o_orderstatus").alias("columns_changed"), box)


def changelog_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Changes in a box, of the types that the orders' table names most: by folders that a dynamic filter picks."""
    path = scratch_folder(spark)
    extracts.write_changelog(_changes(spark, sf), path)
    kinds = spark.createDataFrame([("urgent", "added"), ("high", "removed"), ("medium", "data_changed")], "type string, change_type string").filter("type < 'v'")
    rows = extracts.changelog_scan(spark, path, (20.0, 10.0, 60.0, 50.0), kinds)
    return rows.select("id", "type", "change_type", F.col("columns_changed")[0].alias("changed"), "bbox.xmin", "bbox.ymin")


def row_group_estimate(spark: SparkSession, sf: str) -> DataFrame:
    """What footers say that three boxes may hold, beside what they do hold."""
    path = scratch_folder(spark)
    changes = _changes(spark, sf)
    parts = max(8, math.ceil(changes.count() / PART_ROWS))
    changes.repartitionByRange(parts, "bbox.xmin", "bbox.ymin", "id").sortWithinPartitions("bbox.xmin").write.option("parquet.block.size", 1 << 16).parquet(path)
    boxes = spark.createDataFrame(BOXES, "box_id int, x0 double, y0 double, x1 double, y1 double")
    found = extracts.estimate(extracts.row_groups(spark, path), boxes)
    held = spark.read.parquet(path).crossJoin(F.broadcast(boxes)).filter("bbox.xmin <= x1 and bbox.xmax >= x0 and bbox.ymin <= y1 and bbox.ymax >= y0").groupBy("box_id").agg(F.count("*").alias("held"))
    both = found.join(held, "box_id", "left").withColumn("held", F.coalesce("held", F.lit(0)))
    return both.select("box_id", "all_rows", "unknown_groups", "held", (F.col("candidate_rows") >= F.col("held")).alias("covers"), (F.col("candidate_rows") < F.col("all_rows")).alias("prunes"))


def verified_extract(spark: SparkSession, sf: str) -> DataFrame:
    """A region's features and change log written with a manifest, loaded against it, and held against each other, type by type."""
    folder, box = scratch_folder(spark), (0.0, 0.0, 50.0, 50.0)
    changes = _changes(spark, sf)
    region = changes.filter(extracts._meets(box))
    region.filter("change_type != 'removed' and cast(id as long) % 10 != 0").select("id", "type", "bbox").write.parquet(f"{folder}/segment")
    region.write.parquet(f"{folder}/changelog")
    extracts.write_manifest(spark, folder, "r1", box, ["segment", "changelog"])
    known = [extracts.Artifact("segment", T.StructType.fromDDL("id string, type string")), extracts.Artifact("changelog", T.StructType.fromDDL("id string, type string, change_type string"))]
    manifest, tables = extracts.load_extract(spark, folder, known)
    out = None
    for kind in ("high", "low", "medium", "not sp", "urgent"):
        one = extracts.consistency(tables["segment"].filter(F.col("type") == kind), tables["changelog"], kind).select(F.lit(kind).alias("type"), "unlogged", "unreleased", F.lit(manifest["artifacts"]["segment"]["rows"]).cast("long").alias("segments"))
        out = one if out is None else out.union(one)
    return out


EXTRACT_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (changelog_scan, row_group_estimate, verified_extract)}

_CHANGES = """c as (select o_orderkey::varchar as id, lower(substr(o_orderpriority, 3, 6)) as type, case o_orderstatus when 'F' then 'removed' when 'O' then 'added' else 'data_changed' end as change_type,
  o_orderstatus as changed, (o_custkey % 100)::double as xmin, o_custkey % 100 + 1.5::double as xmax, (o_orderkey % 80)::double as ymin, o_orderkey % 80 + 0.5::double as ymax from orders)"""

EXTRACT_ORACLES: dict[str, str] = {
    "changelog_scan": f"""with {_CHANGES}
select id, type, change_type, changed, xmin, ymin from c
where xmin <= 60 and xmax >= 20 and ymin <= 50 and ymax >= 10 and (type, change_type) in (('urgent', 'added'), ('high', 'removed'), ('medium', 'data_changed'))""",
    "row_group_estimate": f"""with {_CHANGES}, b(box_id, x0, y0, x1, y1) as (values (0, 10, 5, 30, 25), (1, 0, 0, 200, 200), (2, 500, 500, 600, 600))
select box_id, (select count(*) from c) as all_rows, 0::bigint as unknown_groups, count(*) filter (xmin <= x1 and xmax >= x0 and ymin <= y1 and ymax >= y0) as held, true as covers, box_id <> 1 as prunes
from b, c group by box_id""",
    "verified_extract": f"""with {_CHANGES}, r as (select * from c where xmin <= 50 and xmax >= 0 and ymin <= 50 and ymax >= 0 and change_type <> 'removed'),
t(type) as (values ('high'), ('low'), ('medium'), ('not sp'), ('urgent'))
select t.type, 0::bigint as unlogged, count(r.id) filter (r.id::bigint % 10 = 0) as unreleased, (select count(*) from r where id::bigint % 10 <> 0) as segments from t left join r on r.type = t.type group by t.type""",
}
