"""Operators against brute force and on hand-made tables."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F, types as T

from kerbline import schemas
from kerbline.functions import cost
from kerbline.operators import aggregates, conflate, graph, joins, lifecycle, places, spatial, stats, windows
from kerbline.sources import network, tables
from kerbline.streaming import events as streams


def dijkstra(edges, origin):
    out, heap = {}, [(0.0, origin)]
    while heap:
        c, n = heapq.heappop(heap)
        if n in out:
            continue
        out[n] = c
        for s, d, w in edges:
            if s == n and d not in out:
                heapq.heappush(heap, (c + w, d))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_shortest_paths(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(12), r.randrange(12), float(r.randint(1, 9))) for _ in range(30)]
    df = spark.createDataFrame([("p", s, d, f"{i}", w) for i, (s, d, w) in enumerate(edges)] + [("p", 0, 1, "blocked", None)], "profile string, src int, dst int, segment_id string, cost double")
    asked = spark.createDataFrame([(f"{o}", "p", o) for o in (0, 5)], "request string, profile string, origin int")
    got = {(row.request, row.node): (row.cost, row.path) for row in graph.shortest_paths(df, asked).collect()}
    for o in (0, 5):
        want = dijkstra(edges, o)
        assert {n: c for (q, n), (c, _) in got.items() if q == f"{o}"} == want
    for (_, _), (c, path) in got.items():
        assert c == sum(edges[int(i)][2] for i in path)
    to = spark.createDataFrame([("x", "p", 0, 7)], "request string, profile string, origin int, destination int")
    assert graph.routes(df, to).first().cost == dijkstra(edges, 0).get(7)


@pytest.mark.parametrize("cells", [None, "hash", "grid"])
def test_routes_over_a_lattice(spark, cells, monkeypatch):
    """Costs and paths over a lattice equal a plain search, whatever the cells, with and without straight-line bounds."""
    r = random.Random(7)
    n = 14
    points = spark.createDataFrame([(i, float(i % n), float(i // n)) for i in range(n * n)], "node int, x double, y double")
    edges = [(i, j, float(r.choice((1, 1, 2, 3)))) for i in range(n * n) for j in (i + 1, i + n) if j < n * n and (j == i + n or j % n)]
    edges += [(j, i, w) for i, j, w in edges]
    df = spark.createDataFrame([("p", s, d, f"{i}", w) for i, (s, d, w) in enumerate(edges)], "profile string, src int, dst int, segment_id string, cost double")
    pairs = [(0, n * n - 1), (5, 5), (n * n - 1, 3), (20, 170)]
    asked = spark.createDataFrame([(f"{i}", "p", *p) for i, p in enumerate(pairs)] + [("lost", "p", 0, 999)], "request string, profile string, origin int, destination int")
    monkeypatch.setattr(graph, "BATCH", 2)
    if cells == "hash":
        monkeypatch.setattr(graph, "CELL_EDGES", 250)
    how = {"cells": graph.grid_cells(points, 5.0), "points": points} if cells == "grid" else {}
    got = {x.request: x for x in graph.routes(df, asked, **how).collect()}
    assert got["lost"].cost is None
    for i, (o, d) in enumerate(pairs):
        x = got[f"{i}"]
        assert x.cost == dijkstra(edges, o)[d] == sum(edges[int(k)][2] for k in x.path)
        at = o
        for k in x.path:
            assert edges[int(k)][0] == at
            at = edges[int(k)][1]
        assert at == d


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(60), r.randrange(60)) for _ in range(45)]
    root = {}
    for n in {x for e in edges for x in e}:
        seen, todo = {n}, [n]
        while todo:
            a = todo.pop()
            for u, v in edges:
                for x, y in ((u, v), (v, u)):
                    if x == a and y not in seen:
                        seen.add(y)
                        todo.append(y)
        root[n] = min(seen)
    got = graph.connected_parts(spark.createDataFrame(edges, "src int, dst int"))
    assert {x.node: x.root for x in got.collect()} == root
    first = graph.numbered_parts(got).filter("part = 0").collect()
    assert len(first) == max(list(root.values()).count(v) for v in root.values())


def test_counterfactual(spark):
    nodes, ways = network.lattice(spark, 4)
    rows = network.with_features(network.segments(nodes, network.walkable_ways(ways)))
    two = cost.profiles(spark, ("standard", "wheelchair"))
    asked = spark.createDataFrame([(p, p, "0", "15") for p in ("standard", "wheelchair")], "request string, profile string, origin string, destination string")
    edges = cost.with_cost(graph.directed(rows), two)
    base = graph.routes(edges, asked)
    changed = graph.substituted(rows, rows.filter("steps = 'yes'").select("segment_id", F.lit("no").alias("steps")), ["steps"])
    other = cost.with_cost(graph.directed(changed), two)
    again = graph.recosted(base.filter("cost is not null"), other)
    assert rows.count() == 24
    assert again.filter("newly_blocked > 0").count() == 0
    pairs = graph.routes(other, asked).select("request", F.col("cost").alias("new")).join(base, "request")
    assert pairs.filter("new > cost").count() == 0


def test_publication_join(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d"), (3, "e")], "id int, l string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "z")], "id int, r string")
    got = sorted((r.side, r.l, r.r) for r in joins.publication_join(a, b, "id").fillna("-").collect())
    assert got == [("both", "a", "x"), ("left", "e", "-"), ("left_unjoinable", "b", "-"), ("left_unjoinable", "c", "-"), ("left_unjoinable", "d", "-"), ("right", "-", "z"), ("right_unjoinable", "-", "y")]


def test_hash_ignores_order(spark):
    rows = [(i, f"v{i % 3}") for i in range(50)]
    a, b = (aggregates.content_hash(spark.createDataFrame(x, "k int, v string"), ["k"], ["v"]).first().content_sha256 for x in (rows, rows[::-1]))
    assert a == b
    assert a != aggregates.content_hash(spark.createDataFrame(rows[1:], "k int, v string"), ["k"], ["v"]).first().content_sha256


def test_windows(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 3, 8), ("a", 10, 12), ("b", 1, 1)], "k string, lo int, hi int")
    assert {r.k: (r.covered, r.pieces) for r in windows.merged_length(i, "k", "lo", "hi").collect()} == {"a": (10, 2), "b": (0, 1)}
    pts = spark.createDataFrame([("r", 1, 0.0, 0.0), ("r", 2, 1.0, 0.0), ("r", 3, 1.0, 0.0), ("r", 4, 2.0, 0.0)], "k string, i int, x double, y double")
    assert windows.stitched(pts, "k", ["i"]).count() == 3


def test_snap_and_nearest(spark):
    r = random.Random(5)
    segs = [(i, r.random() * 50, r.random() * 50, r.random() * 50, r.random() * 50) for i in range(30)]
    pts = [(i, r.random() * 50, r.random() * 50) for i in range(20)]

    def d(p, s):
        _, ax, ay, bx, by = s
        t = max(0, min(1, ((p[1] - ax) * (bx - ax) + (p[2] - ay) * (by - ay)) / ((bx - ax) ** 2 + (by - ay) ** 2)))
        return ((p[1] - ax - t * (bx - ax)) ** 2 + (p[2] - ay - t * (by - ay)) ** 2) ** 0.5

    got = spatial.snap(spark.createDataFrame(pts, "point_id int, x double, y double"), spark.createDataFrame(segs, "segment_id int, ax double, ay double, bx double, by double"), 4.0).collect()
    for row in got:
        near = min((d(pts[row.point_id], s), s[0]) for s in segs)
        assert (row.segment_id, row.d) == ((near[1], pytest.approx(near[0])) if near[0] <= 4 else (None, None))


def test_conflation(spark):
    def p(x, y):
        return {"x": float(x), "y": float(y)}

    line = "record_id int, line array<struct<x:double,y:double>>"
    points = conflate.samples(spark.createDataFrame([(1, [p(0, 0), p(30, 0)]), (2, [p(0, 50), p(30, 50)]), (3, [p(0, 100), p(30, 100)])], line))
    pieces = spark.createDataFrame([(10, 0.0, 1.0, 30.0, 1.0, 90.0), (11, 15.0, -20.0, 15.0, 20.0, 0.0), (30, 0.0, 101.0, 30.0, 101.0, 90.0), (31, 0.0, 99.0, 30.0, 99.0, 90.0)], "way_id int, ax double, ay double, bx double, by double, bearing double")
    got = {r.record_id: (r.outcome, r.ways) for r in conflate.decisions(points, conflate.claims(points, pieces)).collect()}
    assert got == {1: ("matched", [10]), 2: ("unmatched", None), 3: ("ambiguous", [30])}


def test_search_prefers_exact_and_falls_back(spark):
    index = spark.createDataFrame([(1, "place", "Davis Centre", "building", "davis centre", ["DC"], []), (2, "place", "Davis Street Park", "park", "davis street park", None, None), (3, "address", "12 King Street", "address", "12 king street", [], [])], "place_id int, kind string, label string, category string, search_text string, codes array<string>, initialisms array<string>")
    asked = spark.createDataFrame([(1, "dc"), (2, "davis"), (3, "12 king"), (4, "dabis centre")], "query_id int, text string")
    top = {r.query_id: r.place_id for r in places.search(asked, index).filter("rank = 1").collect()}
    assert top == {1: 1, 2: 1, 3: 3, 4: 1}


def test_bootstrap(spark):
    """Intervals hold the measure, equal records are drawn apart, and more draws change little."""
    rows = spark.createDataFrame([(i, int(i % 4 > 0), int(i % 4 == 0), 0) for i in range(400)], "i int, tp int, fp int, fn int")
    got = {r.measure: r for r in stats.bootstrap(rows, "i", draws=300).collect()}
    assert 0.68 < got["precision"].low < 0.75 < got["precision"].high < 0.82
    assert (got["recall"].low, got["recall"].high) == (1.0, 1.0)


@pytest.mark.parametrize(("sizes", "target", "minimum", "take"), [
    ({"a": 90, "b": 9, "c": 1}, 20, 1, {"a": 17, "b": 2, "c": 1}),
    ({**{f"s{i}": 2 for i in range(10)}, "t": 1000}, 30, 2, {**{f"s{i}": 2 for i in range(10)}, "t": 10}),
    ({"a": 3, "b": 2}, 100, 1, {"a": 3, "b": 2}),
    ({"a": 10, "b": 10, "c": 10}, 5, 1, {"a": 3, "b": 1, "c": 1}),
    ({"a": 10, "b": 10}, 1, 1, {"a": 1, "b": 1}),
])
def test_allocation(spark, sizes, target, minimum, take):
    got = stats.allocated(spark.createDataFrame(list(sizes.items()), "stratum string, n long"), target, minimum).collect()
    assert {r.stratum: r["take"] for r in got} == take


def test_lifecycle(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.001, 0.0)], "node_id string, lon double, lat double")
    edges = spark.createDataFrame([("s", "a", "b", 111.0)], "segment_id string, src string, dst string, length_m double")
    root = str(tmp_path)
    assert lifecycle.seal(spark, root, "v1", "r", nodes, edges).count() == 0
    broken = edges.unionByName(spark.createDataFrame([("t", "a", "z", 5.0)], edges.schema))
    assert {f.code for f in lifecycle.seal(spark, root, "v2", "r", nodes, broken).collect()} == {"missing_endpoint"}
    lifecycle.activate(spark, root, "r", "v1", "first")
    assert lifecycle.active(spark, root, "r") == "v1"
    with pytest.raises(ValueError, match="v2"):
        lifecycle.activate(spark, root, "r", "v2", "no")


def test_schema_check():
    s = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.LongType()), T.StructField("x", T.LongType())])))])
    w = T.StructType([T.StructField("a", T.ArrayType(T.StructType([T.StructField("b", T.StringType()), T.StructField("c", T.LongType())])))])
    assert sorted(schemas.differences(s, w)) == [("a.[].b", "mismatched", "bigint, not string"), ("a.[].c", "missing", "bigint"), ("a.[].x", "additional", "bigint")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    tables.write_canonical_json(df, str(tmp_path / "j"), ["k"])
    assert [r.v for r in tables.ndjson(spark, str(tmp_path / "j"), df.schema).orderBy("k").collect()] == ["a", "b"]
    tables.write_sorted(df, str(tmp_path / "p"), ["k"])
    assert tables.checked(spark.read.parquet(str(tmp_path / "p")), df.schema).count() == 2
    with pytest.raises(ValueError, match="contract"):
        tables.checked(df, T.StructType([T.StructField("z", T.LongType())]))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").orderBy("ts")
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = streams.windowed(stream, "1 day", late="30 days").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.start, r.event_type, r.n) for r in spark.table("w").collect()} == {(r.start, r.event_type, r.n) for r in streams.windowed(rows, "1 day").collect()}
    limited = streams.rate_limited(stream, 2.0, 1 / 86400).writeStream.format("memory").queryName("b").outputMode("append").trigger(availableNow=True).start()
    limited.awaitTermination(180)
    batch = {(r.event_id, r.admitted) for r in streams.rate_limited_batch(rows, 2.0, 1 / 86400).collect()}
    assert {(r.event_id, r.admitted) for r in spark.table("b").collect()} == batch


def test_distances_fall_at_the_radius_as_written_out(spark):
    """Points that are at the radius but for rounding: in or out as sqrt(dx * dx + dy * dy) says."""
    r = random.Random(3)
    rows = []
    while len(rows) < 120:
        x, y = r.randrange(-9999, 9999) / 10000, r.randrange(-9999, 9999) / 10000
        a, b = round(x + 0.018, 4), round(y + 0.024, 4)
        if (math.hypot(x - a, y - b) <= 0.03) != (math.sqrt((x - a) ** 2 + (y - b) ** 2) <= 0.03):
            rows += [(len(rows), x, y), (len(rows) + 1, a, b)]
    got = {row.i: row.n for row in spatial.density(spark.createDataFrame(rows, "i long, x double, y double"), 0.03, "i").collect()}
    assert got == {i: sum(j != i and math.sqrt((x - a) * (x - a) + (y - b) * (y - b)) <= 0.03 for j, a, b in rows) for i, x, y in rows}


def test_nearest_ties_but_for_rounding(spark):
    """Targets at one distance that floating point tells apart go by their ids."""
    r = random.Random(4)
    points, targets = [], []
    for i in range(50):
        x, y = r.randrange(-9999, 9999) / 10000, r.randrange(-9999, 9999) / 10000
        points.append((i, x, y))
        targets += [(4 * i + k, round(x + dx, 4), round(y + dy, 4)) for k, (dx, dy) in enumerate(((0.0003, 0.0004), (-0.0004, 0.0003), (0.0005, 0.0), (0.0, -0.0005)))]
    near = spatial.nearest(spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(targets, "t long, x double, y double"), 0.01, "i", "t", k=3).collect()
    wanted = {i: sorted((round(math.sqrt((x - a) ** 2 + (y - b) ** 2), 12), t) for t, a, b in targets)[:3] for i, x, y in points}
    assert {(n.i, n["rank"]): n.t for n in near} == {(i, k): t for i, best in wanted.items() for k, (_, t) in enumerate(best, 1)}


def test_nearest_compares_few_in_a_crowd(spark, monkeypatch):
    r = random.Random(6)
    targets = [(i, r.randrange(10000) / 10000, r.randrange(10000) / 10000) for i in range(1500)] + [(2000 + i, 0.5, 0.5) for i in range(500)]
    points = [(i, r.randrange(10000) / 10000, r.randrange(10000) / 10000) for i in range(1500)] + [(2000 + i, 0.25, 0.75) for i in range(500)] + [(3000, 1.9, 1.0), (3001, 2.5, 1.0), (3002, None, 1.0)]
    pairs, whole = [], spatial.within

    def within(*args):
        out = whole(*args)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(spatial, "within", within)
    near = spatial.nearest(spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(targets, "t long, x double, y double"), 1.0, "i", "t", k=2).collect()
    wanted = {}
    for i, x, y in points[:-1]:
        best = heapq.nsmallest(2, ((round(math.sqrt((x - a) ** 2 + (y - b) ** 2), 12), t) for t, a, b in targets))
        wanted |= {(i, k): t for k, (d, t) in enumerate(best, 1) if d <= 1.0}
    assert {(n.i, n["rank"]): n.t for n in near} == wanted
    assert sum(pairs) < 100_000
