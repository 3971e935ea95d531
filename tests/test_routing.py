"""Lines, snapping and routes between coordinates against brute force."""

import heapq
import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import linear
from kerbline.operators import graph, routing

POINT = "array<struct<x:double,y:double>>"


def lines(spark, rows):
    return spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in line] if line is not None else None) for i, line in rows], f"i long, line {POINT}")


def length(line):
    return sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))


def brute_project(p, line):
    best, walked = None, 0.0
    for a, b in zip(line, line[1:], strict=False):
        n = math.dist(a, b) ** 2
        t = 0.0 if n == 0 else max(0.0, min(1.0, ((p[0] - a[0]) * (b[0] - a[0]) + (p[1] - a[1]) * (b[1] - a[1])) / n))
        at = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
        found = (round(math.dist(p, at), 9), (walked + t * math.dist(a, b)) / length(line) if length(line) else 0.0, at)
        best = found if best is None else min(best, found)
        walked += math.dist(a, b)
    return best


def test_projection_and_cuts(spark):
    r = random.Random(3)
    rows = [(i, [(r.randrange(9), r.randrange(9)) for _ in range(r.randrange(2, 8))]) for i in range(200)]
    df = lines(spark, rows).select("i", linear.project_on_line(F.lit(4.3), F.lit(3.1), F.col("line")).alias("p"), linear.cut_at(F.col("line"), F.array(F.lit(0.25), F.lit(0.6))).alias("cuts"), linear.point_on_line(F.col("line"), F.lit(0.6)).alias("q"))
    got = {x.i: x for x in df.collect()}
    for i, line in rows:
        d, fraction, at = brute_project((4.3, 3.1), line)
        assert (got[i].p.d, got[i].p.fraction, got[i].p.x, got[i].p.y) == pytest.approx((d, fraction, *at), abs=1e-6)
        pieces = [[(v.x, v.y) for v in c.line] for c in got[i].cuts]
        assert [length(p) for p in pieces] == pytest.approx([s * length(line) for s in (0.25, 0.35, 0.4)], abs=1e-6)
        assert pieces[0][-1] == pytest.approx(pieces[1][0]) and pieces[1][-1] == pytest.approx((got[i].q.x, got[i].q.y))
        inner = [v for p in pieces for v in p[1:-1]]
        assert inner == [v for v in map(lambda v: (float(v[0]), float(v[1])), line[1:-1]) if v in inner] or length(line) == 0


def test_odd_lines(spark):
    df = lines(spark, [(0, None), (1, []), (2, [(1, 1)]), (3, [(1, 1), (1, 1)])])
    at = {x.i: x.p for x in df.select("i", linear.project_on_line(F.lit(4.0), F.lit(5.0), F.col("line")).alias("p")).collect()}
    assert at[0] is None and at[1] is None
    assert (at[2].d, at[2].fraction) == (at[3].d, at[3].fraction) == (5.0, 0.0)
    cuts = {x.i: x.c for x in df.select("i", linear.cut_at(F.col("line"), F.array(F.lit(0.5), F.lit(0.5))).alias("c")).collect()}
    assert len(cuts[3]) == 3 and cuts[3][1].line[0] == cuts[3][1].line[-1]


@pytest.mark.parametrize("limit", [150.0, 700.0])
def test_snapping_widens(spark, limit):
    r = random.Random(5)
    rows = [(i, [(r.uniform(0, 3000), r.uniform(0, 3000))]) for i in range(60)]
    rows = [(i, [*line, *((line[0][0] + r.uniform(-200, 200), line[0][1] + r.uniform(-200, 200)) for _ in range(2))]) for i, line in rows]
    points = [(f"p{i}", r.uniform(-500, 3500), r.uniform(-500, 3500)) for i in range(150)]
    found = routing.snapped(spark.createDataFrame(points, "point_id string, x double, y double"), lines(spark, rows).withColumnRenamed("i", "segment_id"), limit=limit)
    got = {x.point_id: (x.segment_id, x.d, x.fraction) for x in found.collect()}
    want = {}
    for p, x, y in points:
        (d, i, f) = min((brute_project((x, y), line)[0], i, brute_project((x, y), line)[1]) for i, line in rows)
        if d <= limit:
            want[p] = (i, pytest.approx(d), pytest.approx(f))
    assert got == want and len(want) > 50


def network(seed, side=6):
    """(segments, costed): a bent grid with one-way, blocked and dear lines, and an island."""
    r = random.Random(seed)
    segments, costed = [], []

    def add(a, b, pa, pb):
        bend = ((pa[0] + pb[0]) / 2 + r.uniform(-15, 15), (pa[1] + pb[1]) / 2 + r.uniform(-15, 15))
        line, i = [pa, bend, pb], f"s{len(segments)}"
        segments.append((i, a, b, line, length(line)))
        dear = r.choice([1, 1, 3])
        for back in (False, True):
            if r.random() < 0.9:
                costed.append(("walk", i, b if back else a, a if back else b, back, None if r.random() < 0.05 else length(line) * dear * (1.5 if back else 1)))

    at = {(x, y): (x * 100.0, y * 100.0) for x in range(side) for y in range(side)}
    for x, y in at:
        for nx, ny in ((x + 1, y), (x, y + 1)):
            if (nx, ny) in at:
                add(x * 100 + y, nx * 100 + ny, at[x, y], at[nx, ny])
    add(9000, 9001, (650.0, 0.0), (650.0, 200.0))
    return segments, costed


def brute_route(segments, costed, parts, ask):
    _, profile, ox, oy, dx, dy = ask
    if None in (ox, oy, dx, dy):
        return "off_network", None
    if math.dist((ox, oy), (dx, dy)) > 15_000:
        return "too_far", None
    cost = {(i, back): c for p, i, _, _, back, c in costed if c is not None}
    usable = {i for i, _ in cost}
    by_id = {s[0]: s for s in segments}

    def near(p, part=None):
        some = [(brute_project(p, by_id[i][3])[0], i, *brute_project(p, by_id[i][3])[1:]) for i in usable if part is None or parts[i] == part]
        return min((s for s in some if s[0] <= 150), default=None)

    o, d = near((ox, oy)), near((dx, dy))
    if not o or not d:
        return "off_network", None
    if parts[o[1]] != parts[d[1]]:
        options = []
        for mine, other, me, far, part in ((o, d, (ox, oy), (dx, dy), parts[d[1]]), (d, o, (dx, dy), (ox, oy), parts[o[1]])):
            moved = near(me, part)
            if moved and math.dist(moved[3], far) > moved[0]:
                options.append((part, moved[0] - mine[0], (moved, other) if mine is o else (other, moved)))
        if not options:
            return "disconnected", None
        o, d = min(options, key=lambda x: x[:2])[2]
    ahead = {}

    def link(a, b, c):
        ahead.setdefault(a, []).append((b, c))

    cuts = {}
    for name, snap in (("O", o), ("D", d)):
        cuts.setdefault(snap[1], []).append((snap[2], name))
    for i, a, b, _, _ in segments:
        chain = [(0.0, a), *sorted(cuts.get(i, [])), (1.0, b)]
        for whole in ([(0.0, a), (1.0, b)], chain):
            for (f, x), (g, y) in zip(whole, whole[1:], strict=False):
                for back in (False, True):
                    if (i, back) in cost:
                        link(y if back else x, x if back else y, (g - f) * cost[i, back])
    best, todo = {}, [(0.0, "O")]
    while todo:
        c, n = heapq.heappop(todo)
        if n not in best:
            best[n] = c
            for m, w in ahead.get(n, []):
                heapq.heappush(todo, (c + w, str(m) if False else m)) if m not in best else None
    return ("route", best["D"]) if "D" in best else ("no_route", None)


@pytest.mark.parametrize("seed", [1, 2])
def test_coordinate_routes(spark, seed):
    segments, costed = network(seed)
    ids = {n: n for s in segments for n in s[1:3]}
    r = random.Random(seed)
    asks = [(f"q{i}", "walk", r.uniform(-60, 720), r.uniform(-60, 560), r.uniform(-60, 720), r.uniform(-60, 560)) for i in range(25)]
    asks += [("same", "walk", 20.0, 3.0, 70.0, 3.0), ("back", "walk", 70.0, 3.0, 20.0, 3.0), ("far", "walk", 0.0, 0.0, 2e4, 0.0), ("off", "walk", -900.0, 0.0, 10.0, 0.0), ("null", "walk", None, 0.0, 1.0, 1.0), ("corner", "walk", 0.0, 0.0, 500.0, 500.0)]
    rows = lines(spark, [(n, s[3]) for n, s in enumerate(segments)]).join(spark.createDataFrame([(n, *s[:3], s[4]) for n, s in enumerate(segments)], "i long, segment_id string, src long, dst long, length_m double"), "i").drop("i")
    edges = spark.createDataFrame(costed, "profile string, segment_id string, src long, dst long, reversed boolean, cost double")
    parts = routing.segment_parts(edges)
    known = {x.segment_id: x.part for x in parts.collect()}
    points = rows.select(F.col("src").alias("node"), F.col("line")[0].alias("p")).union(rows.select("dst", F.col("line")[2])).select("node", "p.x", "p.y").distinct()
    found = routing.coordinate_routes(rows, edges, spark.createDataFrame(asks, "request string, profile string, ox double, oy double, dx double, dy double"), parts=parts, points=points, cells=graph.even_cells(points, 12))
    got = {x.request: x for x in found.collect()}
    assert len(got) == len(asks) and len(ids) == 38
    lengths = {s[0]: s[4] for s in segments}
    outcomes = set()
    for ask in asks:
        # Nodes as text, as the brute-force heap compares them with the two ends' names.
        outcome, cost = brute_route([(s[0], str(s[1]), str(s[2]), *s[3:]) for s in segments], [(p, i, str(a), str(b), back, c) for p, i, a, b, back, c in costed], known, ask)
        x = got[ask[0]]
        outcomes.add(outcome)
        assert x.outcome == outcome, ask
        if cost is not None:
            assert x.cost == pytest.approx(cost, abs=0.011)
            assert sum(p.cost for p in x.pieces) == pytest.approx(x.cost, abs=0.02)
            assert [p.length_m for p in x.pieces] == pytest.approx([max(0.01, abs(p.to_fraction - p.from_fraction) * lengths[p.segment_id]) for p in x.pieces])
            assert x.distance_m == pytest.approx(sum(p.length_m for p in x.pieces))
    assert {"route", "too_far", "off_network"} <= outcomes


def test_search_limit(spark):
    segments, costed = network(3)
    rows = lines(spark, [(n, s[3]) for n, s in enumerate(segments)]).join(spark.createDataFrame([(n, *s[:3], s[4]) for n, s in enumerate(segments)], "i long, segment_id string, src long, dst long, length_m double"), "i").drop("i")
    edges = spark.createDataFrame(costed, "profile string, segment_id string, src long, dst long, reversed boolean, cost double")
    asked = spark.createDataFrame([("q", "walk", 0.0, 40.0, 480.0, 460.0)], "request string, profile string, ox double, oy double, dx double, dy double")
    x = routing.coordinate_routes(rows, edges, asked, max_expansions=3).first()
    assert (x.outcome, x.cost, x.expanded) == ("search_limit", None, 3)
    assert routing.coordinate_routes(rows, edges, asked.limit(0)).count() == 0


def test_ties_do_not_depend_on_cells(spark):
    side = 7
    edges = [("w", x * side + y, nx * side + ny, f"{x * side + y}-{nx * side + ny}", 1.0) for x in range(side) for y in range(side) for nx, ny in ((x + 1, y), (x, y + 1), (x - 1, y), (x, y - 1)) if 0 <= nx < side and 0 <= ny < side]
    edges += [("w", n, n + 2, f"long{n}", 2.0) for n in range(0, side * side - 2, 5)]  # as dear as two steps, with fewer hops
    df = spark.createDataFrame(edges, "profile string, src long, dst long, segment_id string, cost double")
    points = spark.createDataFrame([(n, float(n // side), float(n % side)) for n in range(side * side)], "node long, x double, y double")
    asked = spark.createDataFrame([(f"r{i}", "w", i, side * side - 1 - i) for i in range(0, 20, 3)], "request string, profile string, origin long, destination long")
    paths = [sorted(tuple(map(str, x)) for x in graph.shortest_paths(df, asked, cells=cells).collect()) for cells in (None, graph.even_cells(points, 5), graph.even_cells(points, 13), graph.grid_cells(points, 2.0))]
    assert paths[0] == paths[1] == paths[2] == paths[3]


def test_even_cells(spark):
    r = random.Random(2)
    rows = [(i, r.gauss(0, 1) ** 3, r.gauss(0, 1) ** 3) for i in range(500)]
    cells = graph.even_cells(spark.createDataFrame(rows, "node long, x double, y double"), 60).groupBy("cell").count().collect()
    assert sorted(c["count"] for c in cells) == [20, *[60] * 8]
