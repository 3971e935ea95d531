"""Column expressions on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from kerbline.functions import cost, fields, geo, tags, text
from kerbline.operators.graph import directed


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


def tag_map(**pairs):
    return F.create_map(*(F.lit(x) for p in pairs.items() for x in p)) if pairs else F.expr("map('', '')")


def test_values_of_merged_tags(spark):
    r = one(spark, all=tags.all_values(F.lit(" Paved;gravel; paved")), none=tags.all_values(F.lit(None).cast("string")), worst=tags.worst_of(F.lit("paved;gravel"), tags.SURFACE_ORDER), odd=tags.worst_of(F.lit("mud;lava"), tags.SURFACE_ORDER), cls=tags.surface_class(F.lit("asphalt;sand")))
    assert (r.all, r.none, r.worst, r.odd, r.cls) == (["paved", "gravel"], [], "gravel", "lava", "rough")


@pytest.mark.parametrize(("raw", "percent"), [("4%", 4.0), ("-3.5", -3.5), ("1/12", 100 / 12), ("45°", 100.0), ("3deg", math.tan(math.radians(3)) * 100), ("up", None), ("5/0", None), ("4%;6%", 4.0), (None, None), ("steep", None)])
def test_inclines(spark, raw, percent):
    got = one(spark, v=tags.incline_percent(F.lit(raw).cast("string"))).v
    assert got == (None if percent is None else pytest.approx(percent))


def test_absence_is_unknown_but_a_footway_is_not_stairs(spark):
    r = one(spark, steps=tags.steps(tag_map(highway="footway")), stairs=tags.steps(tag_map(highway="steps")), none=tags.steps(tag_map()), kerb=tags.kerb(tag_map()), access=tags.access(F.lit(None).cast("string")), lit=tags.tri_state(F.lit("24/7")))
    assert (r.steps, r.stairs, r.none, r.kerb, r.access, r.lit) == ("no", "yes", "unknown", "unknown", "unknown", "yes")


def test_foot_direction(spark):
    def d(**t):
        v = one(spark, v=tags.foot_direction(tag_map(**t))).v
        return v.forward, v.backward, v.ambiguous

    assert d(highway="residential", oneway="yes") == (True, True, False)
    assert d(highway="steps", oneway="yes") == (True, False, False)
    assert d(highway="footway", **{"oneway:foot": "-1"}) == (False, True, False)
    assert d(highway="footway", **{"foot:forward": "no", "foot:backward": "no"}) == (True, True, True)
    assert d(highway="steps", conveying="backward") == (False, True, False)
    assert d(highway="steps", conveying="forward", **{"foot:backward": "yes"}) == (True, False, False)
    assert d(highway="steps", oneway="yes", **{"oneway:foot": "odd"}) == (True, False, True)
    assert d(highway="steps", conveying="yes") == (True, True, True)


def test_grades(spark):
    r = one(spark, steep=tags.derived_grade(F.lit(0.0), F.lit(2.5004), F.lit(10.0), 1.0), fine=tags.derived_grade(F.lit(0.0), F.lit(2.4999), F.lit(10.0), 1.0), g=tags.effective_grade(F.lit(4.0), F.lit(6.5)))
    assert (r.steep, r.fine, r.g.percent, r.g.source, r.g.disagreement) == (None, 25.0, 4.0, "osm_incline", 2.5)


def test_worst_kerb_and_reversal(spark):
    assert one(spark, k=tags.worst_kerb(F.array(F.lit("flush"), F.lit("unknown"), F.lit("lowered")))).k == "unknown"
    seg = spark.createDataFrame([("a", "b", 4.0, "forward", True, True)], "src string, dst string, effective_grade double, conveying string, foot_forward boolean, foot_backward boolean")
    back = directed(seg).filter("reversed").first()
    assert (back.src, back.dst, back.effective_grade, back.conveying) == ("b", "a", -4.0, "backward")


def segment(spark, **over):
    base = dict(length_m=100.0, foot_access="yes", general_access="unknown", steps="no", step_count=None, surface_class="paved", smoothness_class="good", effective_grade=0.0, width_m=2.0, is_crossing=False, kerb="unknown", crossing_type=None, unit_share=1.0) | over
    kinds = dict(length_m="double", effective_grade="double", width_m="double", unit_share="double", step_count="int", is_crossing="boolean")
    return spark.range(1).select(*(F.lit(v).cast(kinds.get(k, "string")).alias(k) for k, v in base.items()))


@pytest.mark.parametrize(("over", "profile", "expected"), [
    ({}, "wheelchair", 100.0),
    ({"surface_class": "rough"}, "wheelchair", 1300.0),
    ({"effective_grade": 10.0}, "wheelchair", 100 + 100 * 2 * 6 + 100 * 8 * 0.55),
    ({"effective_grade": -10.0}, "wheelchair", 100 + 100 * 8 * 0.55 * 0.4),
    ({"is_crossing": True, "kerb": "raised", "crossing_type": "zebra"}, "wheelchair", 100 + 400 + 10),
    ({"width_m": None}, "wheelchair", 100.0),
    ({"steps": "unknown"}, "wheelchair", 130.0),
    ({"steps": "yes", "step_count": 5, "unit_share": 0.5}, "crutches", 100 + (60 + 12 * 5) * 0.5),
    ({"steps": "yes"}, "crutches", 100 + 60 + 120),
    ({"steps": "yes"}, "standard", 100.0),
])
def test_cost(spark, over, profile, expected):
    assert cost.with_cost(segment(spark, **over), cost.profiles(spark, (profile,))).first().cost == pytest.approx(expected)


def test_only_declared_limits_block(spark):
    six = cost.with_cost(segment(spark, steps="yes", effective_grade=20.0, width_m=0.3), cost.profiles(spark)).select("profile", "blocked").collect()
    assert {r.profile for r in six if r.blocked} == {"wheelchair", "walker", "stroller"}
    assert cost.with_cost(segment(spark, foot_access="no"), cost.profiles(spark)).filter("blocked = 'prohibited'").count() == 6


def test_geometry(spark):
    line = F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (3, 4), (3, 10))))
    r = one(spark, length=geo.planar_length(line), near=geo.on_segment(F.lit(5.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)), angle=geo.undirected_angle(F.lit(350.0), F.lit(20.0)), side=geo.side_of(F.lit(0.0), F.lit(5.0), F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0)), points=F.size(geo.densified(line, 1.0)), issue=geo.geometry_issue(F.array(F.struct(F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))), cut=geo.cut_points(F.lit(0.0), F.lit(10.0), F.array(F.lit(0.5), F.lit(0.0), F.lit(0.2))))
    assert (r.length, r.near.t, r.near.d, r.angle, r.side, r.points, r.issue) == (11.0, 0.5, 5.0, 30.0, 1, 13, "single_point")
    assert [(p["from"], p["to"]) for p in r.cut] == [(0, 2), (2, 5), (5, 10)]


def test_ellipsoid(spark):
    r = one(spark, equator=geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0)), meridian=geo.geodesic_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), same=geo.geodesic_m(F.lit(5.0), F.lit(5.0), F.lit(5.0), F.lit(5.0)), utm=geo.to_utm(F.lit(-81.0), F.lit(0.0), F.lit(17)))
    assert r.equator == pytest.approx(111319.4908, abs=1e-3)
    assert r.meridian == pytest.approx(110574.3886, abs=1e-3)
    assert r.same == 0
    assert (r.utm.x, r.utm.y) == (pytest.approx(500000, abs=1e-6), pytest.approx(0, abs=1e-6))


def test_text(spark):
    r = one(spark, n=text.normalise(F.lit("Café d'Étoile & St. John's Rd")), t=text.terms(F.lit("a b a c")), code=text.code_of(F.lit("E7")), no=text.code_of(F.lit("seventeen")), ini=text.initialism(F.lit("School of Fine Arts Hall 2")), tri=text.trigrams(F.lit("ab")), same=text.similarity(F.lit("king st"), F.lit("king st")), street=text.same_street(F.lit("King St."), F.lit("street king")))
    assert (r.n, r.t, r.code, r.no, r.ini, r.tri, r.same, r.street) == ("cafe detoile and street johns road", ["a", "b", "c"], "e7", None, "sfah2", ["  a", " ab", "ab "], 1.0, True)


def test_fields(spark):
    def state(v, published=True):
        return one(spark, s=fields.field_state(F.lit(v).cast("string"), F.lit(published), default="std", domain=("std", "new"))).s

    assert [state("x", False), state(None), state(" "), state("UNKNOWN"), state("NA"), state("std"), state("old"), state("new"), state("STD")] == ["not_published", "null", "blank", "unknown", "not_applicable", "template_default", "out_of_domain", "non_default", "out_of_domain"]
    r = one(spark, s=fields.signals(F.lit("Bing;survey")), ref=fields.element_ref(F.lit("w12@3")), bad=fields.element_ref(F.lit("q1")), rng=fields.linear_range(F.array(F.lit(0.5), F.lit(0.2))), whole=fields.linear_range(F.lit(None).cast("array<double>")))
    assert (r.s, r.ref.kind, r.ref.id, r.ref.version, r.bad.problem, r.rng.malformed, r.whole) == (["declared_unrelated_imagery", "survey"], "way", 12, 3, "unrecognised_shape", True, None)
