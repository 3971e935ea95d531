"""Named queries of field profiles, evaluation and edge facts over the test tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import profiling
from ..sources.tables import table


def order_years(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.year_histogram(table(spark, sf, "orders"), "o_orderdate").select(F.col("year").cast("long").alias("year"), "n")


def default_signatures(spark: SparkSession, sf: str) -> DataFrame:
    flags = {"tax": F.col("l_tax") == 0, "discount": F.col("l_discount") == 0, "one": F.col("l_quantity") == 1, "flag": F.col("l_returnflag") == "N"}
    return profiling.signature_counts(table(spark, sf, "lineitem"), flags).select(F.col("signature").cast("long").alias("signature"), "n")


def label_agreement(spark: SparkSession, sf: str) -> DataFrame:
    size, brand = F.col("p_size"), F.col("p_partkey") % 5
    stated = F.when(brand == 0, "None").when(brand == 1, None).when(brand == 2, "small").otherwise(F.when(size < 20, "small").otherwise("large"))
    return profiling.agreement(table(spark, sf, "part"), stated, F.when(size < 10, "small").when(size < 40, "large"))


def fact_counts(spark: SparkSession, sf: str) -> DataFrame:
    facts = {"dear": F.col("p_retailprice") > 1200, "tiny": F.col("p_size") < 3, "odd": F.when(F.col("p_size") > 10, F.col("p_partkey") % 97 == 0)}
    return profiling.evidence_counts(table(spark, sf, "part"), facts)


def distance_bands(spark: SparkSession, sf: str) -> DataFrame:
    distance = F.when(F.col("p_size") <= 45, F.col("p_size").cast("double"))
    return table(spark, sf, "part").groupBy(profiling.band(distance, (1, 3, 5, 10, 20), 200.0).alias("band")).agg(F.count("*").alias("n"))


def search_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as queries: their lines are the hits in order, and a part of each is what was meant."""
    lines = table(spark, sf, "lineitem")
    hits = lines.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("place_id"))
    cases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("category"), F.array(F.col("o_orderkey") % 200, F.col("o_custkey")).alias("expected"), F.lit(3).alias("within"))
    ranked = profiling.search_quality(hits, cases)
    return ranked.groupBy("category").agg(F.count("*").alias("queries"), F.count("rank").alias("found"), F.count_if("passed").alias("passed"), F.sum("rank").alias("ranks"))


def labelled_candidates(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("record"), F.col("l_suppkey").alias("element"), "l_quantity", "l_discount")
    out = profiling.candidate_recall(lines.filter("l_quantity > 30"), lines.filter("l_discount > 0.02"), "record", "element")
    return out.withColumn("recall", F.round("recall", 6))


def group_metrics(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_set(F.when(F.col("l_quantity") > 25, F.col("l_linenumber"))).alias("truth"), F.collect_set(F.when(F.col("l_discount") > 0.04, F.col("l_linenumber"))).alias("guess"), F.collect_set("l_returnflag").alias("flags"),
    )
    out = profiling.metrics_by_group(lines, F.col("truth"), F.col("guess"), F.col("flags"))
    return out.select("group", "records", "exact", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


def stretch_points(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return profiling.representative(part, "p_brand", F.col("p_size") > 25, "p_retailprice", F.col("p_partkey") % 4 != 0, "p_partkey")


def keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    changes = rows.filter("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, 99).alias("c_nationkey"))
    return profiling.updated(rows, changes, "c_custkey", ["c_nationkey"]).groupBy("c_nationkey").agg(F.count("*").alias("n"))


def end_grades(spark: SparkSession, sf: str) -> DataFrame:
    edges = table(spark, sf, "lineitem").select("l_linenumber", F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), (F.col("l_quantity") * 4).alias("length_m"))
    heights = table(spark, sf, "part").filter("p_size > 5").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") / 4.0).cast("double").alias("elevation_m"), F.lit(5.0).alias("resolution_m"))
    out = profiling.with_derived_grade(edges, heights)
    return out.groupBy("l_linenumber").agg(F.count("*").alias("n"), F.count("derived_grade").alias("known"), F.round(F.sum("derived_grade"), 1).alias("grades"))


def shown_grades(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("l_discount") * 100 + F.col("l_linenumber") * 0.0023
    return table(spark, sf, "lineitem").groupBy(profiling.grade_beyond(F.round(value, 4), F.round(F.col("l_discount") * 100, 4)).alias("shown")).agg(F.count("*").alias("n"))


def publication_days(spark: SparkSession, sf: str) -> DataFrame:
    return profiling.publication_sequence(table(spark, sf, "orders"), "o_custkey", "o_orderdate")


PROFILE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        order_years, default_signatures, label_agreement, fact_counts, distance_bands, search_ranks, labelled_candidates, group_metrics, stretch_points, keyed_update, end_grades, shown_grades, publication_days,
    )
}
PROFILE_ORACLES: dict[str, str] = {
    "order_years": "select year(o_orderdate) as year, count(*) n from orders group by 1",
    "default_signatures": "select (l_tax = 0)::int::bigint + (l_discount = 0)::int + (l_quantity = 1)::int + (l_returnflag = 'N')::int signature, count(*) n from lineitem group by 1",
    "label_agreement": """with p as (select case p_partkey % 5 when 0 then 'None' when 1 then null when 2 then 'small' else case when p_size < 20 then 'small' else 'large' end end s, case when p_size < 10 then 'small' when p_size < 40 then 'large' end e from part)
select count(*) filter (s <> 'None' and e is not null) compared, count(*) filter (s <> 'None' and s = e) agree, count(*) filter (s = 'None') empty from p""",
    "fact_counts": """with p as (select p_retailprice > 1200 d, p_size < 3 t, p_size > 10 and p_partkey % 97 = 0 o from part)
select 'records' fact, count(*) n from p union all select 'dear', count(*) from p where d union all select 'tiny', count(*) from p where t union all select 'odd', count(*) from p where o union all select 'with_any', count(*) from p where d or t or o""",
    "distance_bands": "select case when p_size > 45 then '>200m_or_none' when p_size < 1 then '0-1m' when p_size < 3 then '1-3m' when p_size < 5 then '3-5m' when p_size < 10 then '5-10m' when p_size < 20 then '10-20m' else '20-200m' end band, count(*) n from part group by 1",
    "search_ranks": """with r as (select o_orderkey, o_orderstatus c, min(l_linenumber) k from orders left join lineitem on l_orderkey = o_orderkey and l_partkey in (o_orderkey % 200, o_custkey) group by 1, 2)
select c category, count(*) queries, count(k) found, count(*) filter (k <= 3) passed, sum(k)::bigint ranks from r group by 1""",
    "labelled_candidates": """with t as (select distinct l_orderkey r, l_suppkey e from lineitem where l_quantity > 30), c as (select distinct l_orderkey r, l_suppkey e from lineitem where l_discount > 0.02)
select count(*) labelled, count(c.r) among_candidates, round(count(c.r) / count(*), 6) recall from t left join c on t.r = c.r and t.e = c.e""",
    "group_metrics": """with o as (select l_orderkey k, coalesce(list(distinct l_linenumber) filter (l_quantity > 25), []) t, coalesce(list(distinct l_linenumber) filter (l_discount > 0.04), []) g, list(distinct l_returnflag) f from lineitem group by 1),
p as (select unnest(f) "group", len(list_intersect(t, g)) tp, len(g) g, len(t) t, list_sort(t) = list_sort(g) e from o), s as (select "group", count(*) records, count(*) filter (e) exact, sum(tp)::bigint tp, sum(g - tp)::bigint fp, sum(t - tp)::bigint fn from p group by 1)
select *, round(tp / (tp + fp), 6) "precision", round(tp / (tp + fn), 6) recall, round(2 * tp / (2 * tp + fp + fn), 6) f1 from s""",
    "stretch_points": "select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_size > 25, p_retailprice desc, p_partkey) i from part where p_partkey % 4 <> 0) where i = 1",
    "keyed_update": "select case when c_custkey % 3 <> 0 then c_nationkey when c_custkey % 2 = 0 then 99 end c_nationkey, count(*) n from customer group by 1",
    "end_grades": """with h as (select p_partkey k, p_size / 4.0::double m from part where p_size > 5), g as (select l_linenumber, (b.m - a.m) * 100 / (l_quantity * 4) g, l_quantity * 4 >= 25 long from lineitem left join h a on a.k = l_partkey left join h b on b.k = l_suppkey)
select l_linenumber, count(*) n, count(*) filter (long and abs(g) <= 25) known, round(sum(round(g, 2)) filter (long and abs(g) <= 25), 1) grades from g group by 1""",
    "shown_grades": """with v as (select round(l_discount * 100 + l_linenumber * 0.0023::double, 4) v, round(l_discount * 100, 4) t from lineitem)
select case when printf('%.1f', v)::double > t then printf('%.1f', v) when printf('%.2f', v)::double > t then printf('%.2f', v) else v::varchar end shown, count(*) n from v group by 1""",
    "publication_days": "select o_custkey, min(o_orderdate::date) \"first\", max(o_orderdate::date) \"last\", count(distinct o_orderdate::date) n from orders group by 1",
}
