"""Lineage, linkage, route audit and study operators against brute force and on hand-made tables."""

import random

from pyspark.sql import functions as F

from kerbline.functions import cost
from kerbline.operators import audit, graph, lineage, linkage, studies


def test_review_queue(spark):
    r = random.Random(4)
    rows = [(s, r.randrange(30), float(r.randrange(6))) for s in ("a", "b", "c") for _ in range(25)]
    best = {}
    for s, k, v in rows:
        best[s, k] = max(v, best.get((s, k), 0.0))
    rows = [(s, k, v) for (s, k), v in best.items()]
    want, taken = [], set()
    for _ in range(8):
        for s in ("a", "b", "c"):
            left = sorted((-v, k) for t, k, v in rows if t == s and k not in taken)
            if left and len(want) < 20:
                taken.add(left[0][1])
                want.append((len(want) + 1, s, left[0][1]))
    df = spark.createDataFrame(rows, "stratum string, record int, score double")
    assert studies.review_queue(df, ["a", "b", "c"], most=20) == want
    assert studies.review_queue(df.limit(0), ["a"]) == []


def test_contracted(spark):
    # a-b-c-d is one street whose last piece has another surface; b2 hangs on c, so c has three ends.
    rows = [(1, "a", "b", 10.0, "paved"), (2, "c", "b", 20.0, "paved"), (3, "c", "d", 5.0, "paved"), (4, "c", "x", 1.0, "paved"), (5, "d", "e", 2.0, "gravel"), (6, "e", "f", 3.0, "gravel"), (7, "g", "g", 4.0, None)]
    got = graph.contracted(spark.createDataFrame(rows, "segment_id int, src string, dst string, length_m double, surface string"), ["surface"])
    assert {(x.chain_id, x.segments, x.length_m, x.surface) for x in got.collect()} == {(1, 2, 30.0, "paved"), (3, 1, 5.0, "paved"), (4, 1, 1.0, "paved"), (5, 2, 5.0, "gravel"), (7, 1, 4.0, None)}


def test_relocated(spark):
    choices = spark.createDataFrame([
        ("q", "origin", 1, 5.0, 500.0), ("q", "origin", 2, 40.0, 460.0), ("q", "destination", 3, 6.0, 500.0), ("r", "origin", 1, 5.0, 30.0), ("r", "origin", 2, 40.0, 30.0), ("r", "destination", 3, 6.0, 30.0),
    ], "request string, side string, node int, d double, far double")
    parts = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "node int, part int")
    assert [tuple(x) for x in graph.relocated(choices, parts).collect()] == [("q", 2, 3, 0)]  # r's other snap is as near the far end


def test_lineage(spark):
    rows = [
        (1, 1, "v", "survey", None), (1, 2, "v", "survey", None),  # carried over, so the second edit states nothing
        (2, 1, "u", None, None), (2, 2, "v", None, "bulk import"), (3, 1, "v", "City of Kitchener", None), (4, 1, "v", None, None), (5, 1, "v", None, None), (6, 1, "v", None, None), (6, 2, None, None, None),
    ]
    history = spark.createDataFrame(rows, "id int, at int, value string, source string, comment string")
    edits = lineage.introducing_edits(history, "id", "at", "value", "source", "comment")
    assert {x.id: x["at"] for x in edits.collect()} == {1: 1, 2: 2, 3: 1, 4: 1, 5: 1}
    since = spark.createDataFrame([(5, 3)], "id int, since int")
    found = lineage.decided(edits, "id", "at", since)
    assert {x.id: (x.lineage, x.basis) for x in found.collect()} == {1: ("independent", "declared"), 2: ("possible", None), 3: ("known", None), 4: ("unknown", None), 5: ("independent", "dates")}
    together = lineage.least_independent(found.withColumn("g", F.when(F.col("id") < 3, 1).otherwise(2)), "g")
    assert {x.g: x.lineage for x in together.collect()} == {1: "possible", 2: "known"}


def test_version_status(spark):
    t = "2020-01-0{}T00:00:00Z".format
    cases = [
        ([1, 2], [t(1)], 1, t(1), "ambiguous"), ([1], [t(1)], None, None, "no_evidence"), ([2], [t(1)], 1, t(1), "ours_older"), ([1], [t(1)], 2, t(1), "ours_newer"), ([1], [t(1), t(2)], 1, t(1), "time_unverified"), ([1], ["x"], 1, t(1), "time_unverified"),
        ([1], [t(3)], 1, t(3), "exact"), ([1], [t(6)], 1, t(3), "edited_after_our_snapshot"), ([1], [t(4)], 1, t(3), "time_inconsistent"), ([1], [t(3)], 1, t(9), "edited_after_their_snapshot"), ([1], [t(1)], 1, t(2), "time_inconsistent"), ([1], [t(3)], 1, t(4), "time_unverified"),
    ]
    df = spark.createDataFrame(cases, "v array<int>, ts array<string>, o int, ot string, want string")
    status = lineage.version_status(F.col("v"), F.col("ts"), F.col("o"), F.col("ot"), F.lit(t(5)), F.lit("2020-01-07"), F.lit(t(2)))
    assert [x.got for x in df.select(status.alias("got"), "want").collect()] == [c[-1] for c in cases]


def test_linkage(spark):
    rows = [("s1", "OSM", "w1@1", None, None, "t"), ("s1", "OSM", "w1@1", None, None, "t"), ("s1", "OSM", "w2@1", None, [0.0, 0.5], "t"), ("s2", "OSM", "w2@2", None, None, "t"), ("s3", "OSM", "w3@1", None, [0.7, 0.2], "t"), ("s3", None, "w3@1", None, None, "t"), ("s4", "OSM", "q", None, None, "t"), ("s4", "OSM", "n4@1", None, None, "t"), ("s5", "OSM", "w5@1", "/x", None, "t")]
    found = linkage.classified_sources(spark.createDataFrame(rows, "segment_id string, dataset string, record_id string, property string, between array<double>, update_time string"), "OSM")
    assert {x.kind: x["count"] for x in found.groupBy("kind").count().collect()} == {"way": 3, "duplicate": 1, "malformed_range": 1, "other_dataset": 1, "malformed_id": 1, "other_element": 1, "property_only": 1}
    ways = linkage.linked_ways(spark.createDataFrame([(1,), (2,), (3,)], "way_id long"), linkage.way_links(found))
    assert {x.way_id: (x.match, x.cardinality, x.partial_ranges) for x in ways.collect()} == {1: ("linked", "N:1", 0), 2: ("linked", "N:M", 1), 3: ("not_linked", None, None)}


def test_audit(spark):
    pieces = spark.createDataFrame([("q", "p", 0, "a", 10.0, 1, 2, 4.0), ("q", "p", 1, "b", 5.0, 2, 3, 9.0), ("q", "p", 2, "c", 5.0, 4, 5, 9.0)], "request string, profile string, ix int, segment_id string, length_m double, src int, dst int, effective_grade double")
    routes = spark.createDataFrame([("q", "p", 21.0, 10.5, 21.0, 1.0, 2.0)], "request string, profile string, distance_m double, fastest_s double, slowest_s double, pace_low double, pace_high double")
    found = audit.findings(routes, pieces, {"climb": F.col("effective_grade") > 8})
    assert {x.check: x.n for x in found.collect()} == {"continuity": 1, "distance": 1, "climb": 2}
    g = audit.gradients(pieces.withColumn("grade_source", F.lit("recorded"))).first()
    assert (g.steepest_up, g.up_segment, g.steepest_down, g.m_recorded) == (9.0, "b", None, 20.0)


def test_studies(spark):
    p = cost.profiles(spark, ("wheelchair", "walker")).select("profile", F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0), F.lit("c"), F.lit(1.0)).alias("m"))
    assert {tuple(x["values"]) for x in studies.equivalent_values(p, ["profile"], "m").collect()} == {("a", "c"), ("b",)}
    rows = spark.createDataFrame([(1, True), (2, None), (3, False)], "k int, ok boolean")
    assert [tuple(x) for x in studies.funnel(rows, {"ok": F.col("ok"), "small": F.col("k") < 2}).collect()] == [(1, "ok", 3, 2), (2, "small", 1, 0)]
    r = random.Random(1)
    js = [(i, *(r.uniform(-50, 50) for _ in range(4)), r.uniform(20, 90)) for i in range(60)]
    ss = [(r.uniform(-50, 50), r.uniform(-50, 50)) for _ in range(15)]
    want = {j for j, a, b, c, d, z in js if any(((a - x) ** 2 + (b - y) ** 2) ** 0.5 + ((c - x) ** 2 + (d - y) ** 2) ** 0.5 <= z for x, y in ss)}
    got = studies.could_move(spark.createDataFrame(js, "journey int, ox double, oy double, dx double, dy double, cost double"), spark.createDataFrame(ss, "x double, y double"))
    assert {x.journey for x in got.collect()} == want
