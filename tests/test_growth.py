"""Work that must not grow with the square of copies: rows that the steps of a plan give, and what operators hand on."""

import math

import pyarrow as pa
from pyspark.sql import functions as F

from kerbline.functions import linear
from kerbline.functions.search import Labels
from kerbline.operators import areas, crossings, graph, places, stats, studies
from kerbline.plans import extract_queries
from kerbline.plans.queries import QUERIES


def most_rows(df, kind=""):
    """The most rows that a step of the executed plan gave, of those whose name holds kind."""
    df.collect()

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            inner = [p.executedPlan()]
        elif "QueryStage" in name:
            inner = [p.plan()]
        else:
            inner = [p.children().apply(i) for i in range(p.children().size())]
        own = p.metrics().apply("numOutputRows").value() if kind in name and p.metrics().contains("numOutputRows") else 0
        return max([own, *map(walk, inner)])

    return walk(df._jdf.queryExecution().executedPlan())


def test_most_similar_of_copied_texts(spark):
    """copies of a text aren't joined with all queries of it; a query's own id still isn't its answer."""
    rows = spark.createDataFrame([(i, ("red brick hall", "red brick hull", "old mill", "lone kiln")[i % 4] if i else "lone dune") for i in range(1200)], "place_id int, search_text string")
    asked = rows.filter("place_id % 3 = 0").selectExpr("place_id query_id", "search_text text")
    best = places.most_similar(asked, rows)
    assert most_rows(best) < 20_000
    got = {r.query_id: (r.place_id, r.similarity) for r in best.collect()}
    assert got == {i: ((i % 4 or 4) if i != (i % 4 or 4) else i + 4, 1.0) for i in range(3, 1200, 3)} | {0: (3, got[0][1])} and got[0][1] < 1


def test_journeys_of_the_same_ends(spark):
    """F8: journeys of the same ends and cost are asked once, and so are places."""
    journeys = spark.range(1000).selectExpr("id journey", "0D ox", "0D oy", "10D dx", "0D dy", "if(id % 2 = 0, 12D, 11D) cost")
    moved = studies.could_move(journeys, spark.range(800).selectExpr("5D x", "3D y"))
    assert most_rows(moved, "Join") <= 1000
    assert {r.journey for r in moved.collect()} == set(range(0, 1000, 2))


def test_areas_of_the_same_rings(spark, monkeypatch):
    """areas of the same rings are covered once, and each still gets its points."""
    seen, cover = [], areas.cover
    monkeypatch.setattr(areas, "cover", lambda shapes, size: (seen.append(shapes.count()), cover(shapes, size))[1])
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 0.0, "y": 9.0}]]
    shapes = spark.createDataFrame([(i, ring) for i in range(50)] + [(99, None)], "area_id long, rings array<array<struct<x:double,y:double>>>")
    points = spark.createDataFrame([(i, 1.0, 2.0) for i in range(20)] + [(50, 8.0, 8.0), (51, None, 1.0)], "i long, x double, y double")
    got = sorted((r.i, r.area_id) for r in areas.points_in_areas(points, shapes, 4.0).collect())
    assert got == [(i, a) for i in range(20) for a in range(50)]
    assert seen == [1]


def test_pieces_of_no_unit_skip_the_joins(spark):
    """they have no key, so a join would send all of them to one task."""
    schema = "segment_id string, way_id long, src long, dst long, length_m double, is_crossing boolean, steps string, kerb string, kerb_from_node boolean"
    rows = spark.createDataFrame([(f"{i}", i, i, i + 1, 1.0, i < 10, "no", "unknown", False) for i in range(500)], schema)
    found = crossings.units(rows, spark.createDataFrame([(1, "lowered")], "node_id long, kerb string"))
    assert most_rows(found, "Join") <= 20
    got = {r.segment_id: r for r in found.collect()}
    assert len(got) == 500 and got["400"].unit_share == 1.0 and got["400"].unit_ref is None and got["400"].crossing_kerb is None
    assert got["1"].crossing_kerb_ends == 1 and got["5"].crossing_kerb_ends == 0


def test_changes_are_written_by_as_many_tasks_as_they_need(spark, monkeypatch):
    """F16"""
    files, read = [], extract_queries.extracts.row_groups
    monkeypatch.setattr(extract_queries, "PART_ROWS", 100, raising=False)
    monkeypatch.setattr(extract_queries.extracts, "row_groups", lambda s, path: (files.append(len(s.read.parquet(path).inputFiles())), read(s, path))[1])
    assert QUERIES["row_group_estimate"](spark, "/root/testdata/sf0.001").filter("covers").count() == 3
    assert files[0] > 12


def test_links_are_not_broadcast(spark):
    """tables that grow with the pieces are joined by exchanges, however small their files are."""
    pieces = spark.createDataFrame([(i, "a", float(i), 0.0, [i % 7, i % 5]) for i in range(60)], "piece_id long, name string, x double, y double, nodes array<long>")
    found = graph.named_stretches(pieces, 1.0)
    assert {r.stretch for r in found.collect()} == {0}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_nodes_are_not_broadcast(spark):
    """nodes and requests grow with the network, so the driver holds no copies of them."""
    edges = spark.createDataFrame([("p", i, i + 1, f"s{i}", 1.0) for i in range(9)], "profile string, src long, dst long, segment_id string, cost double")
    points = spark.range(10).selectExpr("id node", "double(id) x", "0D y")
    asked = spark.createDataFrame([("q", "p", 0, 9), ("r", "p", 3, 5)], "request string, profile string, origin long, destination long")
    found = graph.routes(edges, asked, cells=points.selectExpr("node", "node div 4 cell"), points=points)
    assert {r.request: r.cost for r in found.collect()} == {"q": 9.0, "r": 2.0}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_draws_are_spread_over_tasks(spark):
    """a small table of records is one file, and its draws are still the work of all tasks."""
    rows = spark.range(300).coalesce(1).selectExpr("id", "1 tp", "0 fp", "0 fn").union(spark.range(300, 310).coalesce(1).selectExpr("id", "0 tp", "0 fp", "0 fn"))
    found = stats.bootstrap(rows, "id", draws=20)
    assert {(r.measure, r.low, r.high) for r in found.collect()} == {(m, 1.0, 1.0) for m in ("precision", "recall", "f1")}
    assert "REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString()


def test_records_of_lines_are_computed_once(spark):
    """a record that is an expression isn't computed anew for each vertex of the line, nor for each figure."""
    line = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.struct((i + F.col("id")).cast("double").alias("x"), F.lit(0.0).alias("y")))
    record = F.transform(line, lambda v: F.struct((v["x"] + 0.73).alias("x"), v["y"].alias("y")))
    df = spark.range(3).withColumn("a", linear.vertex_agreement(line, record)).select("id", "a.near", "a.paired", F.round("a.median_m", 6).alias("m"), F.round("a.spread_m", 6).alias("s"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("0.73") == 1
    assert sorted(tuple(r) for r in df.collect()) == [(i, 6, 6, 0.27, 0.0) for i in range(3)]


def test_lines_are_clipped_by_shapes(spark, monkeypatch):
    """F1 of round 4: areas of the same rings clip a line once, pairs of a cell aren't rows of a join, and crowded cells are split."""
    seen, cover = [], areas.cover
    monkeypatch.setattr(areas, "cover", lambda shapes, size: (seen.append(shapes.count()), cover(shapes, size))[1])
    monkeypatch.setattr(areas, "LINES", 7, raising=False)
    monkeypatch.setattr(areas, "AREAS", 1, raising=False)
    rings = [[[{"x": x, "y": y} for x, y in ring]] for ring in ([(0.0, 0.0), (9.0, 0.0), (0.0, 9.0)], [(1.0, 0.0), (9.0, 0.0), (9.0, 9.0), (1.0, 9.0)])]
    shapes = spark.createDataFrame([(i, rings[i % 2]) for i in range(50)] + [(99, None)], "area_id long, rings array<array<struct<x:double,y:double>>>")
    lines = spark.createDataFrame([(i, 0, -1.0, 2.0, 9.0, 2.0) for i in range(20)], "line_id long, step int, ax double, ay double, bx double, by double")
    got = areas.clipped(lines, shapes, 4.0)
    assert most_rows(got, "MergeJoin") <= 1000
    want = {(i, a, 0, *((0.2, 1.0) if a % 2 else (0.1, 0.8))) for i in range(20) for a in range(50)}
    assert {(r.line_id, r.area_id, r.step, round(r.t0, 9), round(r.t1, 9)) for r in got.collect()} == want and got.count() == len(want)
    sums = areas.lengths_inside(lines, shapes, 4.0).collect()
    assert seen == [2, 2]
    assert sorted((r.line_id, r.area_id, r.pieces, round(r.inside_m, 9)) for r in sums) == [(i, a, 1, 8.0 if a % 2 else 7.0) for i in range(20) for a in range(50)]


def test_requests_of_a_cell_are_relaxed_together(monkeypatch):
    """F3 of round 4: a task's requests take as many steps as the longest of them, and a limit on expansions still stops node by node."""
    side, asked = 12, 40
    steps, settle = [], Labels.settle
    monkeypatch.setattr(Labels, "settle", lambda self, *a: (steps.append(len(self.limit)), settle(self, *a))[1])
    grid = [(a, b) for n in range(side * side) for a, b in ((n, n + 1), (n, n + side)) if b < side * side and (b - a > 1 or b % side)]
    grid += [(b, a) for a, b in grid]
    edges = pa.table({"src": [a for a, _ in grid], "dst": [b for _, b in grid], "segment_id": [f"{min(e)}-{max(e)}" for e in grid], "w": [1.0 + min(e) % 3 for e in grid], "dst_cell": [0] * len(grid), "dst_x": [float(b % side) for _, b in grid], "dst_y": [float(b // side) for _, b in grid]})
    goal = side * side - 1
    rows = [{"request": f"q{i}", "profile": "p", "node": i, "cell": 0, "cost": 0.0, "hops": 0, "segment_id": None, "parent": None, "goals": [{"node": goal, "rest": 0.0}], "limit": None, "goal_x": 11.0, "goal_y": 11.0, "lower": math.hypot(i % side - 11, i // side - 11), "left": 5.0 if i == 7 else None} for i in range(asked)]
    kinds = {"segment_id": pa.string(), "parent": pa.int64(), "limit": pa.float64(), "left": pa.float64()}
    entries = pa.table({k: pa.array([r[k] for r in rows], kinds.get(k)) for k in rows[0]})
    told = graph._relax(entries, edges).to_pylist()
    assert steps == [asked]
    cost = {r["request"]: r["cost"] for r in told if r["kind"] == graph.SETTLED and r["node"] == goal}
    want = {goal: 0.0}
    for _ in range(4 * side):
        for a, b in grid:
            want[a] = min(want.get(a, math.inf), 1.0 + min(a, b) % 3 + want.get(b, math.inf))
    assert cost == {f"q{i}": want[i] for i in range(asked) if i != 7}
    assert [(r["cost"], r["hops"]) for r in told if r["kind"] == graph.SPENT and r["request"] == "q7"] == [(5.0, 1)]


def test_points_are_given_their_areas_last(spark, monkeypatch):
    """F4 of round 4: pairs of a point and an area are rows only after the last exchange."""
    monkeypatch.setattr(areas, "MEMBERS", 30, raising=False)
    ring = [[{"x": 0.0, "y": 0.0}, {"x": 9.0, "y": 0.0}, {"x": 0.0, "y": 9.0}]]
    schema = "area_id long, rings array<array<struct<x:double,y:double>>>"
    few, many = (spark.createDataFrame([(i, ring) for i in range(n)], schema) for n in (20, 80))
    same = spark.createDataFrame([(i, 1.0, 2.0) for i in range(70)], "i long, x double, y double")
    apart = spark.createDataFrame([(i, 1.0 + i / 100, 2.0) for i in range(70)], "i long, x double, y double")
    for points, shapes, n in ((same, many, 80), (apart, many, 80), (same, few, 20), (apart, few, 20)):
        got = areas.points_in_areas(points, shapes, 4.0)
        assert most_rows(got, "Join") <= 70 * 3
        assert sorted((r.i, r.area_id) for r in got.collect()) == [(i, a) for i in range(70) for a in range(n)]
