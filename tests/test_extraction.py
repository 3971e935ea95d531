"""Places from relations, nodes and ways; rings, inner points and what tags say."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import place_tags
from kerbline.operators import extraction

from test_areas import holds, star

CASES = [
    ({"name": "X", "amenity": "fast_food"}, "fast food", None, True),
    ({"name": "X", "shop": "yes", "building": "yes"}, "shop", None, True),
    ({"name": "X", "building": "yes"}, "building", None, True),
    ({"name": "X", "building": "fire_station"}, "fire station building", None, True),
    ({"name": "X", "railway": "rail", "building": "yes"}, "building", None, True),
    ({"name": "X", "railway": "tram_stop"}, "tram stop", None, True),
    ({"name": "X", "public_transport": "platform"}, "transit platform", None, True),
    ({"name": "X", "public_transport": "stop_position"}, None, None, False),
    ({"name": "X", "highway": "bus_stop", "shop": "kiosk"}, "transit stop", None, True),
    ({"name": "  ", "amenity": "cafe"}, "cafe", None, False),
    ({"amenity": "no", "name": "X"}, None, None, False),
    ({"addr:housenumber": " 5 ", "addr:street": "Main"}, None, None, True),
    ({"addr:housenumber": "5"}, None, None, False),
    ({"name": "X", "highway": "Residential"}, None, "street", False),
    ({"name": "X", "highway": "cycleway"}, None, "path", False),
    ({"name": "X", "highway": "pedestrian"}, None, "pedestrian street", False),
    ({"name": "X", "highway": "steps"}, None, None, False),
    ({"name": "X", "highway": "trunk"}, None, None, False),
    ({}, None, None, False),
    (None, None, None, None),
]


def test_what_tags_say(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, tags map<string,string>")
    rows = df.select("i", place_tags.place_category(F.col("tags")).alias("place"), place_tags.street_category(F.col("tags")).alias("street"), place_tags.is_candidate(F.col("tags")).alias("candidate")).collect()
    for r in rows:
        assert (r.place, r.street, bool(r.candidate)) == (*CASES[r.i][1:3], bool(CASES[r.i][3])), CASES[r.i]


def test_entries(spark):
    tags = {"name": "Davis Centre", "building": "university", "addr:housenumber": "200", "addr:street": "University Ave", "ref": "DC;not a code", "short_name": "DC", "alt_name": "Davis; Library"}
    r = spark.createDataFrame([(tags,)], "tags map<string,string>").select(place_tags.entry(F.col("tags")).alias("e"), place_tags.place_codes(F.col("tags")).alias("codes")).first()
    assert (r.e.kind, r.e.label, r.e.category, r.codes) == ("place", "Davis Centre, 200 University Ave", "university building", ["dc"])
    assert r.e.searched.startswith("Davis Centre 200 University Ave Davis")
    one = spark.createDataFrame([({"addr:housenumber": "5", "addr:street": "Main", "addr:city": "Town"},)], "tags map<string,string>").select(place_tags.entry(F.col("tags")).alias("e")).first()
    assert (one.e.kind, one.e.label) == ("address", "5 Main, Town")


def test_rings_close_in_any_order(spark):
    r = random.Random(5)
    members, ways, want = [], [], set()
    for area in range(40):
        for ring in range(r.randrange(1, 4)):
            nodes = [area * 1000 + ring * 100 + k for k in range(r.randrange(3, 12))]
            cuts = sorted(r.sample(range(len(nodes)), r.randrange(1, 4) if len(nodes) > 3 else 1))
            arcs = [(nodes + nodes)[a : b + 1] for a, b in zip(cuts, [*cuts[1:], cuts[0] + len(nodes)], strict=True)]
            lost = r.random() < 0.3
            for n, arc in enumerate(arcs):
                way = area * 1000 + ring * 100 + n
                members.append((area, way))
                if not (lost and n == 0):
                    ways.append((way, arc[::-1] if r.random() < 0.5 else arc))
                    if not lost:
                        want.add((area, way))
    r.shuffle(members)
    found = extraction.closed_rings(spark.createDataFrame(members, "area_id long, way_id long"), spark.createDataFrame(ways, "way_id long, refs array<long>")).collect()
    assert {(x.area_id, x.way_id) for x in found} == want
    rings = {}
    for x in found:
        rings.setdefault((x.area_id, x.way_id // 100), set()).add(x.ring)
    assert all(len(v) == 1 for v in rings.values()) and len({x for v in rings.values() for x in v}) == len(rings)


def test_points_lie_inside(spark):
    r = random.Random(6)
    shapes = {i: [star(r, r.uniform(-9, 9), r.uniform(-9, 9), r.uniform(0.1, 5), r.randrange(3, 14))] for i in range(120)}
    shapes[500] = [[(0.0, 0.0), (10.0, 0.0), (10.0, 1.0), (1.0, 1.0), (1.0, 10.0), (0.0, 10.0)]]
    shapes[501] = [star(r, -50, 0, 5, 6), star(r, 60, 0, 9, 6)]
    edges = [(i, *a, *b) for i, rings in shapes.items() for ring in rings for a, b in zip(ring, ring[1:] + ring[:1], strict=True)] + [(900, 1.0, 1.0, 2.0, 1.0), (900, 2.0, 1.0, 1.0, 1.0)]
    got = {x.area_id: (x.x, x.y) for x in extraction.inner_points(spark.createDataFrame(edges, "area_id long, ax double, ay double, bx double, by double")).collect()}
    assert set(got) == set(shapes)  # a flat outline has no inside
    assert all(holds(shapes[i], *p) for i, p in got.items())


def test_way_points(spark):
    rows = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, [(0.0, 0.0), (3.0, 0.0), (3.0, 5.0)]), (3, [(1.0, 1.0), (1.0, 1.0)]), (4, [(0.0, 0.0), (2.0, 0.0), (4.0, 0.0), (0.0, 0.0)])]
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in line]) for i, line in rows], "way_id long, line array<struct<x:double,y:double>>")
    got = {x.way_id: (x.x, x.y) for x in extraction.way_points(df).collect()}
    assert got[1] == (2.0, 1.0) and got[2] == pytest.approx((3.0, 1.0)) and got[4] == pytest.approx((4.0, 0.0)) and 3 not in got


def test_reading_a_region(spark):
    node = "node_id long, tags map<string,string>, version int, lon double, lat double"
    way = "way_id long, tags map<string,string>, version int, refs array<long>"
    relation = "relation_id long, tags map<string,string>, version int, members array<struct<type:string,ref:long,role:string>>"
    corners = [(0.1, 0.1), (0.4, 0.1), (0.4, 0.3), (0.1, 0.3)]
    nodes = [(n, None, 1, x, y) for n, (x, y) in enumerate(corners)] + [(10, {"name": "Cafe", "amenity": "cafe"}, 2, 0.5, 0.5), (11, {"name": "Far", "amenity": "cafe"}, 1, 1.0, 0.5), (12, None, 1, 5.0, 5.0)]
    ways = [(1, None, 1, [0, 1, 2]), (2, None, 1, [0, 3, 2]), (3, {"name": "Main", "highway": "residential"}, 1, [0, 1, 12]), (4, {"name": "Cut", "building": "yes"}, 1, [0, 1, 12, 0]), (5, {"name": "Hall", "building": "yes"}, 4, [0, 1, 2, 3, 0])]

    def members(*refs):
        return [{"type": "w", "ref": r, "role": "outer"} for r in refs]

    relations = [(1, {"type": "multipolygon", "name": "Park", "leisure": "park"}, 3, members(2, 1)), (2, {"type": "multipolygon", "name": "Open", "leisure": "park"}, 1, members(1)), (3, {"type": "route", "name": "R", "leisure": "park"}, 1, members(1, 2)), (4, {"type": "multipolygon", "name": "None", "leisure": "park"}, 1, None)]
    tables = [spark.createDataFrame(relations, relation), spark.createDataFrame(nodes, node), spark.createDataFrame(ways, way)]
    entries, streets = extraction.read_places(*tables, (0.0, 0.0, 0.9, 0.9))
    got = {(x.osm_type, x.osm_id, x.label, x.version): (round(x.lon, 6), round(x.lat, 6)) for x in entries.collect()}
    assert got == {("node", 10, "Cafe", 2): (0.5, 0.5), ("way", 5, "Hall", 4): (0.25, 0.2), ("relation", 1, "Park", 3): (0.25, 0.2)}
    assert [(x.way_id, x.name, x.category, len(x.line)) for x in streets.collect()] == [(3, "Main", "street", 2)]
    empty, none = extraction.read_places(*(t.limit(0) for t in tables), (0.0, 0.0, 0.9, 0.9))
    assert empty.count() == none.count() == 0
    assert math.isclose(sum(x[0] for x in got.values()), 1.0)
