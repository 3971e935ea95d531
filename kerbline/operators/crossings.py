"""Crossings and stairways as units, with the evidence of the nodes at and along them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import tags


def with_node_evidence(segments: DataFrame, nodes: DataFrame) -> DataFrame:
    """segments (src, dst, is_crossing, kerb, tactile_paving, crossing_type, ...) with what the nodes (node_id, tags) at their ends add, and kerb_from_node.

    A crossing's own tags win; ends fill gaps: the severest recorded kerb, tactile paving where no end denies it, the first type. Other
    segments stay as they are. Two left joins on the node id.
    """
    said = nodes.select("node_id", *(c.alias(f"_{k}") for k, c in tags.node_evidence(F.col("tags")).items()))
    out = segments
    for end, key in (("a", "src"), ("b", "dst")):
        at = said.select(F.col("node_id").alias(f"_{end}"), *(F.col(f"_{k}").alias(f"_{end}_{k}") for k in ("kerb", "tactile_paving", "crossing_type")))
        out = out.join(at, F.col(key) == F.col(f"_{end}"), "left").drop(f"_{end}")

    def stated(k: str):
        return F.filter(F.array(F.col(f"_a_{k}"), F.col(f"_b_{k}")), lambda v: v.isNotNull() & (v != "unknown"))

    kerbs, paving = stated("kerb"), stated("tactile_paving")
    gap = F.col("is_crossing") & (F.col("kerb") == "unknown") & (F.size(kerbs) > 0)
    silent = F.col("is_crossing") & (F.col("tactile_paving") == "unknown") & (F.size(paving) > 0)
    kind = F.when(F.col("is_crossing"), F.coalesce("crossing_type", "_a_crossing_type", "_b_crossing_type")).otherwise(F.col("crossing_type"))
    out = out.withColumns({
        "kerb_from_node": gap,
        "kerb": F.when(gap, tags.worst_kerb(kerbs)).otherwise(F.col("kerb")),
        "tactile_paving": F.when(silent, F.when(F.forall(paving, lambda v: v == "yes"), "yes").otherwise("no")).otherwise(F.col("tactile_paving")),
        "crossing_type": kind,
    })
    return out.drop(*(f"_{e}_{k}" for e in "ab" for k in ("kerb", "tactile_paving", "crossing_type")))


def units(segments: DataFrame, node_kerbs: DataFrame) -> DataFrame:
    """segments (segment_id, way_id, src, dst, length_m, is_crossing, steps, kerb, kerb_from_node, ...) with unit_ref, unit_share, crossing_kerb, crossing_kerb_ends.

    The pieces of one way that are crossings, or stairs, are one unit; a piece without a way is its own. Shares go by length. A crossing's
    kerb is the severest on its way; else of node_kerbs (node_id, kerb) along it: two or more describe both ends, one leaves the other end
    unknown. A way's pieces are grouped and their sums joined back.
    """
    kind = F.when(F.col("is_crossing"), "crossing").when(F.col("steps") == "yes", "stairway")
    ref = F.concat(kind, F.coalesce(F.concat(F.lit(":way/"), F.col("way_id").cast("string")), F.concat(F.lit(":"), F.col("segment_id").cast("string"))))
    rows = segments.withColumn("unit_ref", ref)
    inside = rows.filter("unit_ref is not null")
    severity = {k: i for i, k in enumerate(tags.KERB_SEVERITY)}
    rank = F.create_map(*(F.lit(x) for kv in severity.items() for x in kv))
    own = F.when((F.col("kerb") != "unknown") & ~F.col("kerb_from_node"), F.element_at(rank, F.col("kerb")))
    sums = inside.groupBy("unit_ref").agg(F.sum("length_m").alias("_total"), F.count("*").alias("_n"), F.max(own).alias("_own"))
    ends = inside.filter("is_crossing").select("unit_ref", F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    known = node_kerbs.filter("kerb != 'unknown'").select("node_id", F.element_at(rank, F.col("kerb")).alias("_k"))
    along = ends.join(known, "node_id").groupBy("unit_ref").agg(F.count("*").alias("_ends"), F.max("_k").alias("_worst"))
    names = F.array(*map(F.lit, tags.KERB_SEVERITY))
    worst = F.when(F.col("_own").isNotNull(), F.col("_own")).when(F.col("_ends") == 1, F.greatest("_worst", F.lit(severity["unknown"]))).otherwise(F.coalesce("_worst", F.lit(severity["unknown"])))
    out = inside.join(sums, "unit_ref").join(along, "unit_ref", "left")
    # Pieces of no unit would all meet in one task of the joins.
    none = {c: F.lit(None).cast(out.schema[c].dataType) for c in ("_total", "_n", "_own", "_ends", "_worst")}
    out = out.unionByName(rows.filter("unit_ref is null").withColumns(none))
    return out.withColumns({
        "unit_share": F.when(F.col("unit_ref").isNull(), 1.0).when(F.col("_total") > 0, F.col("length_m") / F.col("_total")).otherwise(F.try_divide(F.lit(1.0), F.col("_n"))),
        "crossing_kerb": F.when(F.col("is_crossing"), F.get(names, worst)),
        "crossing_kerb_ends": F.when(F.col("is_crossing"), F.when(F.col("_own").isNotNull(), 2).otherwise(F.least(F.coalesce("_ends", F.lit(0)), F.lit(2)))).cast("int"),
    }).drop("_total", "_n", "_own", "_ends", "_worst")
