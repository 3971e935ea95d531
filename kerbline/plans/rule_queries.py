"""Named queries of tag, name and field rules: hand-made cases dealt over a whole table, and SQL with the outcome that each rule defines."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import fields, tags, text
from ..operators import crossings
from ..sources.tables import table

DIRECTIONS = (
    {"highway": "residential", "oneway": "yes"},
    {"highway": "steps", "oneway": "yes"},
    {"highway": "steps", "oneway": "-1"},
    {"highway": "footway", "oneway:foot": "-1"},
    {"highway": "footway", "foot:forward": "no", "foot:backward": "no"},
    {"highway": "steps", "conveying": "backward"},
    {"highway": "steps", "conveying": "forward", "foot:backward": "yes"},
    {"highway": "steps", "oneway": "yes", "oneway:foot": "odd"},
    {"highway": "steps", "conveying": "yes"},
    {"highway": "steps", "conveying": "forward", "oneway:foot": "no"},
    {"highway": "footway", "foot:backward": "maybe"},
    {"highway": "path"},
    {"highway": "footway", "oneway:foot": "yes", "foot:backward": "designated"},
)
VALUES = (
    {"highway": "footway", "curb": "lowered", "surface": "asphalt;gravel"},
    {"highway": "footway", "barrier": "kerb", "width": "1.5 metres"},
    {"highway": "steps", "step_count": "0", "incline": "up"},
    {"highway": "steps", "step_count": "12.0", "incline": "4%;6%"},
    {"highway": "footway", "step_count": "9", "incline": "0%", "footway": "crossing"},
    {"highway": "cycleway", "cycleway": "crossing", "kerb": "flush;raised", "incline": "-1/12"},
    {"highway": "path", "crossing": "no", "incline": "45°", "surface": "lava"},
    {"crossing": "marked", "step_count": "-3", "width": "2-3", "incline": "steep"},
    {"highway": "path", "path": "crossing", "kerb": "odd", "width": "0"},
    {"highway": "service", "crossing": "separate", "incline": "-3.5", "surface": "compacted"},
)
NAMES = (
    "Davis Center", "Engineering 5", "P.A.C.", "E 5", "12A", "St. Jacobs", "Café & Bar", "Children's Museum", "SLC", "Faculty of Mathematics", "A",
    "One Two Three Four Five Six Seven", "", "Theater on the Sq",
)
STATES = (
    (True, "CURBCUT", "U"), (True, "CURBCUT", "UNKNOWN"), (True, "SURFACE", "UNKNOWN"), (True, "SURFACE", "unknown"), (True, "SURFACE", "NA (VIRTUAL LINK)"),
    (True, "SURFACE", "CONCRETE"), (True, "SURFACE", "ASPHALT"), (True, "SURFACE", "BRICK"), (True, "SURFACE", " "), (True, "SURFACE", None), (False, "SURFACE", "ASPHALT"),
)
RECORDS = ("w123@4", "w12", "w12@0", "n0@1", "x1@2", "", None, "r9@10", "w01@2")
SIGNALS = ("City of Kitchener ortho 2014", "Kitchener_GIS", "Bing;survey", "Geobase_Import_2009", "Region of Waterloo 2024", "esri world imagery", "aerial", "Mapillary", "google; local knowledge", "", None)


def _dealt(spark: SparkSession, sf: str, cases: Sequence, kind: str) -> DataFrame:
    """Each row of part with one of the cases, by p_partkey."""
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], f"i int, c {kind}")
    return table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % len(cases)).cast("int").alias("i")).join(F.broadcast(rows), "i")


def foot_directions(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf, DIRECTIONS, "map<string,string>").withColumns({"d": tags.foot_direction(F.col("c")), "ignored": tags.vehicle_oneway_ignored(F.col("c"))})
    return d.select("p_partkey", "d.forward", "d.backward", "d.ambiguous", "ignored")


def tag_values(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf, VALUES, "map<string,string>")
    f = tags.edge_features(F.col("c"))
    names = ("kerb", "step_count", "width_m", "incline_direction", "is_crossing", "surface_class")
    return d.select("p_partkey", *(f[k].alias(k) for k in names), F.round(f["incline_percent"], 4).alias("incline_percent"))


def name_forms(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf, NAMES, "string")
    c = F.col("c")
    return d.select("p_partkey", text.normalise(c).alias("plain"), text.compact(c).alias("compact"), text.code_of(c).alias("code"), text.initialism(c).alias("initials"))


def field_codes(spark: SparkSession, sf: str) -> DataFrame:
    d = _dealt(spark, sf, STATES, "struct<published:boolean,field:string,value:string>")
    of = {k: fields.field_state(F.col("c.value"), F.col("c.published"), "CONCRETE", ("CONCRETE", "ASPHALT", "UNKNOWN"), k) for k in ("CURBCUT", "SURFACE")}
    return d.select("p_partkey", F.when(F.col("c.field") == "CURBCUT", of["CURBCUT"]).otherwise(of["SURFACE"]).alias("state"))


def record_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, RECORDS, "string").select("p_partkey", fields.element_ref(F.col("c")).alias("r")).select("p_partkey", "r.*")


def source_signals(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, SIGNALS, "string").select("p_partkey", F.array_join(fields.signals(F.col("c"), F.lit("2015-01-01")), ",").alias("signals"))


def age_buckets(spark: SparkSession, sf: str) -> DataFrame:
    days = F.datediff(F.lit("1998-08-02"), F.to_date("o_orderdate"))
    return table(spark, sf, "orders").groupBy(fields.age_bucket(days).alias("bucket")).agg(F.count("*").alias("n"))


def derived_grades(spark: SparkSession, sf: str) -> DataFrame:
    rise, length = F.col("l_discount") * F.col("l_quantity"), F.col("l_quantity")
    grade = tags.derived_grade(F.lit(0.0), rise * 3, length, 2.0)
    found = tags.effective_grade(F.when(F.col("l_linenumber") == 1, F.lit(4.0)), grade)
    rows = table(spark, sf, "lineitem").select("l_linestatus", found.alias("g"))
    sums = (F.count("g.percent").alias("known"), F.round(F.sum("g.percent"), 1).alias("percent"), F.round(F.sum("g.disagreement"), 1).alias("disagreement"))
    return rows.groupBy("l_linestatus", F.col("g.source").alias("source")).agg(*sums)


def crossing_units(spark: SparkSession, sf: str) -> DataFrame:
    """The lines of an order as the pieces of one crossing, part keys as nodes, some with kerbs."""
    pieces = table(spark, sf, "lineitem").select(
        F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey").alias("segment_id"), F.col("l_orderkey").alias("way_id"), F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.col("l_quantity").alias("length_m"),
        (F.col("l_orderkey") % 3 != 0).alias("is_crossing"), F.lit("no").alias("steps"), F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 1), "raised").otherwise("unknown").alias("kerb"), F.lit(False).alias("kerb_from_node"),
    )
    kerbs = table(spark, sf, "part").filter("p_size <= 5").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_size") <= 3, "lowered").otherwise("rolled").alias("kerb"))
    found = crossings.units(pieces, kerbs)
    return found.select("segment_id", "unit_ref", F.round("unit_share", 6).alias("unit_share"), "crossing_kerb", "crossing_kerb_ends")


def crossing_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as crossings between two customers' nodes."""
    o = table(spark, sf, "orders")
    segments = o.select("o_orderkey", (F.col("o_custkey") % 7).alias("src"), (F.col("o_orderkey") % 7).alias("dst"), F.lit(True).alias("is_crossing"), F.when(F.col("o_orderkey") % 4 == 0, "flush").otherwise("unknown").alias("kerb"), F.lit("unknown").alias("tactile_paving"), F.lit(None).cast("string").alias("crossing_type"))
    said = spark.createDataFrame([(0, {"kerb": "lowered", "tactile_paving": "yes"}), (1, {"barrier": "kerb", "tactile_paving": "no"}), (2, {"kerb": "raised", "crossing": "zebra"}), (3, {"highway": "crossing", "crossing": "marked"}), (4, {})], "node_id int, tags map<string,string>")
    found = crossings.with_node_evidence(segments, said)
    return found.groupBy("src", "dst", "kerb", "kerb_from_node", "tactile_paving", "crossing_type").agg(F.count("*").alias("n"))


def _expected(columns: str, rows: Sequence[str]) -> str:
    cases = ", ".join(f"({i}, {r})" for i, r in enumerate(rows))
    return f"select p_partkey, {columns} from part join (values {cases}) v(i, {columns}) on p_partkey % {len(rows)} = i"


RULE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (foot_directions, tag_values, name_forms, field_codes, record_ids, source_signals, age_buckets, derived_grades, crossing_units, crossing_evidence)
}
RULE_ORACLES: dict[str, str] = {
    "foot_directions": _expected("forward, backward, ambiguous, ignored", [
        "true, true, false, true", "true, false, false, true", "false, true, false, true", "false, true, false, false", "true, true, true, false", "false, true, false, false", "true, false, false, false",
        "true, false, true, true", "true, true, true, false", "true, true, false, false", "true, true, true, false", "true, true, false, false", "true, true, false, false",
    ]),
    "tag_values": _expected("kerb, step_count, width_m, incline_percent, incline_direction, is_crossing, surface_class", [
        "'lowered', null::int, null::double, null::double, 'unknown', false, 'rough'", "'unknown', null, 1.5, null, 'unknown', false, 'unknown'", "'unknown', 0, null, null, 'up', false, 'unknown'",
        "'unknown', 12, null, 4.0, 'up', false, 'unknown'", "'unknown', null, null, 0.0, 'unknown', true, 'unknown'", "'raised', null, null, -8.3333, 'down', true, 'unknown'",
        "'unknown', null, null, 100.0, 'up', false, 'unknown'", "'unknown', null, null, null, 'unknown', true, 'unknown'", "'unknown', null, null, null, 'unknown', false, 'unknown'",
        "'unknown', null, null, -3.5, 'down', false, 'compacted'",
    ]),
    "name_forms": _expected("plain, compact, code, initials", [
        "'davis centre', 'daviscenter', null::varchar, 'dc'", "'engineering 5', 'engineering5', null, 'e5'", "'p a c', 'pac', 'pac', 'pc'", "'east 5', 'e5', 'e5', 'e5'", "'12a', '12a', null, null",
        "'street jacobs', 'stjacobs', null, 'sj'", "'cafe and bar', 'cafebar', null, 'cb'", "'childrens museum', 'childrensmuseum', null, 'cm'", "'slc', 'slc', 'slc', null",
        "'faculty of mathematics', 'facultyofmathematics', null, 'fm'", "'a', 'a', null, null", "'one two three four five six seven', 'onetwothreefourfivesixseven', null, null", "'', '', null, null",
        "'theatre on the square', 'theateronthesq', null, 'ts'",
    ]),
    "field_codes": _expected("state", ["'unknown'", "'non_default'", "'unknown'", "'out_of_domain'", "'not_applicable'", "'template_default'", "'non_default'", "'out_of_domain'", "'blank'", "'null'", "'not_published'"]),
    "record_ids": _expected("kind, id, version, problem", [
        "'way', 123::bigint, 4::bigint, null::varchar", "null, null, null, 'unrecognised_shape'", "'way', 12, null, 'version_zero'", "null, null, null, 'unrecognised_shape'", "null, null, null, 'unrecognised_shape'",
        "null, null, null, 'missing'", "null, null, null, 'missing'", "'relation', 9, 10, null", "null, null, null, 'unrecognised_shape'",
    ]),
    "source_signals": _expected("signals", [
        "'public_orthoimagery'", "'kitchener_data'", "'declared_unrelated_imagery,survey'", "'import_or_external_data,other_government_data'", "'public_orthoimagery'", "'declared_unrelated_imagery'",
        "'unspecified_imagery'", "'declared_street_level_imagery'", "'google_named,survey'", "''", "null",
    ]),
    "age_buckets": """with d as (select date_diff('day', o_orderdate::date, date '1998-08-02') d from orders)
select case when d is null then 'unknown' when d <= 7 then '0-7 days' when d <= 30 then '8-30 days' when d <= 180 then '31-180 days' when d <= 365 then '181-365 days' else 'over a year' end bucket, count(*) n
from d group by 1""",
    "derived_grades": """with d as (select l_linestatus, l_linenumber = 1 m, case when l_quantity >= 10 and abs(l_discount * l_quantity * 3 * 100 / l_quantity) <= 25 then round(l_discount * l_quantity * 3 * 100 / l_quantity, 2) end g from lineitem)
select l_linestatus, case when m then 'osm_incline' when g is not null then 'derived_elevation' end source, count(case when m then 4.0 else g end) known, round(sum(case when m then 4.0::double else g end), 1) percent, round(sum(case when m then g - 4.0 end), 1) disagreement
from d group by 1, 2""",
    "crossing_units": """with p as (select l_orderkey || ':' || l_linenumber || ':' || l_partkey segment_id, l_orderkey w, l_quantity q, l_partkey a, l_suppkey b, l_orderkey % 5 = 0 and l_linenumber = 1 r from lineitem where l_orderkey % 3 <> 0),
k as (select p_partkey k, case when p_size <= 3 then 2 else 4 end s from part where p_size <= 5), n as (select distinct w, k, s from (select w, a x from p union select w, b from p) join k on x = k),
u as (select w, count(*) c, max(s) s from n group by w), t as (select w, bool_or(r) r, sum(q) total, count(*) m from p group by w)
select segment_id, 'crossing:way/' || p.w unit_ref, round(case when total > 0 then q / total else 1.0 / m end, 6) unit_share,
  case when t.r then 'raised' when c is null then 'unknown' else ['lowered', 'unknown', 'rolled'][greatest(s, case when c = 1 then 3 else 0 end) - 1] end crossing_kerb, case when t.r then 2 else least(coalesce(c, 0), 2) end::int crossing_kerb_ends
from p join t on p.w = t.w left join u on p.w = u.w
union all select l_orderkey || ':' || l_linenumber || ':' || l_partkey, null, 1.0, null, null from lineitem where l_orderkey % 3 = 0""",
    "crossing_evidence": """with v(i, kerb, paving, kind) as (values (0, 2, 'yes', null::varchar), (1, 5, 'no', null), (2, 6, null, 'zebra'), (3, null::int, null, 'marked'), (4, null, null, null)),
s as (select o_custkey % 7 src, o_orderkey % 7 dst, o_orderkey % 4 = 0 flush from orders)
select src, dst, case when flush then 'flush' else coalesce(['lowered', 'unknown', 'rolled', 'present_unknown', 'raised'][greatest(a.kerb, b.kerb) - 1], 'unknown') end kerb, not flush and greatest(a.kerb, b.kerb) is not null kerb_from_node,
  case when a.paving is null and b.paving is null then 'unknown' when coalesce(a.paving, 'yes') = 'yes' and coalesce(b.paving, 'yes') = 'yes' then 'yes' else 'no' end tactile_paving, coalesce(a.kind, b.kind) crossing_type, count(*) n
from s left join v a on src = a.i left join v b on dst = b.i group by all""",
}
