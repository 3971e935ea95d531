"""Equi-joins with the semantics of evidence: publications, as-of, differences, linkage."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.fields import changed


def unjoinable_ids(sides: Sequence[DataFrame], key: str) -> DataFrame:
    """Ids that occur twice in any of the sides."""
    repeated = [s.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key) for s in sides]
    return reduce(DataFrame.union, repeated).distinct()


def publication_join(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Full outer join of two publications of one inventory, with side (both, left, right, left_unjoinable, right_unjoinable).

    An id that any publication repeats joins in none; null ids never join. Columns other than key must differ.
    """
    bad = unjoinable_ids([left, right], key)

    def fit(side: DataFrame) -> DataFrame:
        return side.filter(F.col(key).isNotNull()).join(bad, key, "left_anti")

    def rest(side: DataFrame, name: str) -> DataFrame:
        return side.filter(F.col(key).isNull()).unionByName(side.join(bad, key, "left_semi")).withColumn("side", F.lit(name))

    a, b = fit(left).withColumn("in_left", F.lit(True)), fit(right).withColumn("in_right", F.lit(True))
    joined = a.join(b, key, "full_outer")
    joined = joined.withColumn("side", F.when(F.col("in_left") & F.col("in_right"), "both").when(F.col("in_left"), "left").otherwise("right")).drop("in_left", "in_right")
    return joined.unionByName(rest(left, "left_unjoinable"), allowMissingColumns=True).unionByName(rest(right, "right_unjoinable"), allowMissingColumns=True)


def consistency(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has, with the table's name: two anti-joins, each a shuffle on the key."""
    a, b = first.select(key).distinct(), second.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("only_in", F.lit("first")).union(b.join(a, key, "left_anti").withColumn("only_in", F.lit("second")))


def as_of(events: DataFrame, facts: DataFrame, key: str, at: str, value: str, since: str) -> DataFrame:
    """Each event with the last fact of its key at or before it: one union and one window, no band join.

    A key with many rows is one sorted, streamed window partition; it is never held in memory.
    """
    known = facts.select(F.col(key), F.col(since).alias(at), F.lit(0).alias("turn"), F.col(value))
    asked = events.withColumn("turn", F.lit(1))
    both = asked.unionByName(known, allowMissingColumns=True)
    order = W.partitionBy(key).orderBy(at, "turn").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("turn") == 0, F.struct(F.col(value))), ignorenulls=True).over(order)
    return both.withColumn("_fact", last).filter("turn = 1").withColumn(value, F.col(f"_fact.{value}")).drop("turn", "_fact")


def differences(candidate: DataFrame, baseline: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A row for each field that differs between candidate and baseline, nulls being equal; keys without baseline differ in all."""
    b = baseline.select(*keys, *(F.col(f).alias(f"_b_{f}") for f in fields))
    rows = candidate.join(b, list(keys), "left").withColumn("field", F.explode(changed({f: (F.col(f), F.col(f"_b_{f}")) for f in fields})))
    pick = {side: reduce(lambda out, f: out.when(F.col("field") == f, F.col(prefix + f).cast("string")), fields, F.when(F.lit(False), "")) for side, prefix in (("candidate", ""), ("baseline", "_b_"))}
    return rows.select(*keys, "field", pick["candidate"].alias("candidate"), pick["baseline"].alias("baseline"))


def cardinality(links: DataFrame, left: str, right: str) -> DataFrame:
    """Distinct links with their kind: 1:1, 1:N (left has several), N:1, N:M."""
    pairs = links.select(left, right).filter(F.col(left).isNotNull() & F.col(right).isNotNull()).distinct()
    n = pairs.groupBy(left).agg(F.count("*").alias("rights"))
    m = pairs.groupBy(right).agg(F.count("*").alias("lefts"))
    kind = F.when((F.col("rights") == 1) & (F.col("lefts") == 1), "1:1").when(F.col("lefts") == 1, "1:N").when(F.col("rights") == 1, "N:1").otherwise("N:M")
    return pairs.join(n, left).join(m, right).select(left, right, kind.alias("cardinality"))


def missing_endpoints(edges: DataFrame, nodes: DataFrame, source: str = "src", target: str = "dst", node: str = "node_id") -> DataFrame:
    """(edge columns, missing) for edges whose start or end isn't a node."""
    ids = nodes.select(F.col(node).alias("_n")).distinct()
    ends = edges.withColumn("missing", F.explode(F.array(source, target)))
    return ends.join(ids, ends["missing"] == ids["_n"], "left_anti")
