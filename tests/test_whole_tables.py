"""Queries over whole tables against brute force."""

import heapq
import math
from collections import Counter
from datetime import timedelta

import pytest

from kerbline.operators import places
from kerbline.plans import queries
from kerbline.plans.queries import QUERIES
from kerbline.sources.tables import table

SF = "/root/testdata/sf0.001"


def test_link_cardinality_whole(spark):
    pairs = {(r.l_orderkey, r.l_partkey) for r in table(spark, SF, "lineitem").select("l_orderkey", "l_partkey").collect()}
    a, b = Counter(p[0] for p in pairs), Counter(p[1] for p in pairs)
    kinds = {(True, True): "1:1", (False, True): "1:N", (True, False): "N:1", (False, False): "N:M"}
    wanted = Counter(kinds[a[x] == 1, b[y] == 1] for x, y in pairs)
    assert {r.cardinality: r.links for r in QUERIES["link_cardinality_whole"](spark, SF).collect()} == wanted


def test_as_of_value_whole(spark):
    rows = table(spark, SF, "events").select("event_id", "user_id", "ts", "event_type").collect()
    wanted = {}
    for r in rows:
        known = [(x.ts, x.event_type) for x in rows if x.user_id == r.user_id and x.ts <= r.ts + timedelta(hours=1)]
        wanted[r.event_id] = max(known)[1]
    got = QUERIES["as_of_value_whole"](spark, SF).collect()
    assert len(got) == len(rows)
    assert {r.event_id: r.event_type for r in got} == wanted


def test_trigram_similarity_whole(spark):
    def pieces(t):
        return {f"  {w} "[i : i + 3] for w in t.split(" ") if w for i in range(len(w) + 1)}

    names = {r.p_partkey: pieces(r.p_name.lower()) for r in table(spark, SF, "part").collect()}
    wanted = {q: min((-len(names[q] & t) / len(names[q] | t), i) for i, t in names.items() if i != q) for q in names if q % 100 == 0}
    got = {r["query"]: (r.p_partkey, r.similarity) for r in QUERIES["trigram_similarity_whole"](spark, SF).collect()}
    assert got == {q: (i, pytest.approx(-s, abs=1e-6)) for q, (s, i) in wanted.items()}


def test_most_similar_without_shared_trigrams(spark):
    rows = spark.createDataFrame([(1, "abc"), (2, "xyz"), (3, "xyw")], "place_id int, search_text string")
    got = places.most_similar(rows.selectExpr("place_id query_id", "search_text text"), rows).collect()
    assert {r.query_id: r.place_id for r in got} == {1: 2, 2: 3, 3: 2}


def test_grid_knn_whole(spark):
    rows = [(r.vec_id, round(float(r.embedding[0]), 4), round(float(r.embedding[1]), 4)) for r in table(spark, SF, "embeddings").collect()]
    got = {(r.vec_id, r["rank"]): (r.target, r.d) for r in QUERIES["grid_knn_whole"](spark, SF).collect()}
    wanted = {}
    for i, x, y in rows:
        near = sorted((math.hypot(x - a, y - b), j) for j, a, b in rows if j != i)
        wanted |= {(i, k): (j, pytest.approx(d, abs=1e-6)) for k, (d, j) in enumerate(near[:3], 1) if d <= 0.05}
    assert got == wanted


def test_routes_over_the_part_grid(spark):
    edges, points, asked = (x.collect() for x in queries.part_grid(spark, SF))
    ahead = {}
    for e in edges:
        ahead.setdefault(e.src, []).append((e.dst, e.cost))
    assert len(points) == 196
    assert len(asked) == 2
    for r in QUERIES["part_routes"](spark, SF).collect():
        best, todo = {}, [(0.0, r.origin)]
        while todo:
            c, n = heapq.heappop(todo)
            if n not in best:
                best[n] = c
                for m, w in ahead[n]:
                    heapq.heappush(todo, (c + w, m))
        assert r.cost == best[r.destination]
