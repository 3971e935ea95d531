"""Regions replaced behind a pointer, located runs, numbered segments and vertex agreement."""

import math
import random
import statistics
import threading

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kerbline.functions import linear
from kerbline.operators import positions
from kerbline.sources import regions


def rows(spark, edition, *names):
    return spark.createDataFrame([(n, i, edition) for n in names for i in range(3)], "region string, place long, edition string")


def shown(df):
    return sorted({(r.region, r.edition) for r in df.collect()})


@pytest.fixture
def root(spark, tmp_path):
    regions.replace_regions(spark, str(tmp_path), rows(spark, "old", "a", "b"))
    return str(tmp_path)


def test_others_stay(spark, root):
    before = regions.read_regions(spark, root)
    assert regions.replace_regions(spark, root, rows(spark, "new", "b", "c"), facts={"source": "x"}) == 2
    assert shown(regions.read_regions(spark, root)) == [("a", "old"), ("b", "new"), ("c", "new")]
    assert shown(before) == [("a", "old"), ("b", "old")]  # a reader keeps what it began with
    assert shown(regions.read_regions(spark, root, number=1)) == [("a", "old"), ("b", "old")]
    assert shown(regions.read_regions(spark, root, ["c", "none"])) == [("c", "new")]
    assert regions.pointer(spark, root)["regions"]["c"]["rows"] == 3
    with pytest.raises(ValueError):
        regions.read_regions(spark, root, ["none"])


@pytest.mark.parametrize("bad", ["row", "null"])
def test_a_failed_writer_shows_nothing(spark, root, bad):
    broken = rows(spark, "new", "a", "b").withColumn("edition", F.when(F.col("place") < 2, F.col("edition")).otherwise(F.raise_error(F.lit("stop"))))
    if bad == "null":
        broken = rows(spark, "new", "a").union(spark.createDataFrame([(None, 1, "new")], "region string, place long, edition string"))
    with pytest.raises(Exception, match="stop|without region"):
        regions.replace_regions(spark, root, broken)
    assert shown(regions.read_regions(spark, root)) == [("a", "old"), ("b", "old")]
    assert regions.pointer(spark, root)["number"] == 1


def test_concurrent_writers_and_readers(spark, root):
    seen, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(shown(regions.read_regions(spark, root)))

    writers = [threading.Thread(target=regions.replace_regions, args=(spark, root, rows(spark, f"w{n}", "a", f"own{n}"))) for n in range(3)]
    reader = threading.Thread(target=read)
    reader.start()
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    stop.set()
    reader.join()
    last = regions.pointer(spark, root)
    assert last["number"] == 4 and sorted(last["regions"]) == ["a", "b", "own0", "own1", "own2"]
    for s in seen:  # never two editions of a region, never a region that is half there
        assert len({r for r, _ in s}) == len(s) and ("b", "old") in s
    gone = regions.sweep(spark, root)
    assert len(gone) == 2 - (last["regions"]["a"]["version"] == last["regions"]["b"]["version"]) or len(gone) <= 2
    assert len(regions.read_regions(spark, root).collect()) == 15


def test_located_runs(spark):
    r = random.Random(3)
    ways = [(i, [r.randrange(4) for _ in range(r.randrange(0, 9))]) for i in range(80)] + [(99, None)]
    segments = [(f"s{n}", i, (refs[a : a + 3] if n % 2 else refs[a : a + 3][::-1])) for n, (i, refs) in enumerate(ways) if refs for a in (0, 2) if len(refs) > a]
    segments += [("x", 1, [9, 9]), ("y", 777, [1, 2]), ("z", 2, [1]), ("n", 3, None)]
    got = {tuple(x) for x in positions.located_runs(spark.createDataFrame(segments, "segment_id string, way_id long, refs array<long>"), spark.createDataFrame(ways, "way_id long, refs array<long>")).collect()}
    known = dict(ways)
    want = set()
    for s, w, run in segments:
        for reversed_, own in ((False, run), (True, run[::-1] if run else None)):
            if own and len(own) > 1 and known.get(w) and not (reversed_ and own == run):
                want |= {(s, w, p, reversed_) for p in range(len(known[w]) - len(own) + 1) if known[w][p : p + len(own)] == own}
    assert got == want and len(want) > 40


def test_numbered_segments(spark):
    ways = spark.createDataFrame([(1, [10, 11, 12], [0.0, 5.0, 9.0])], "way_id long, refs array<long>, positions array<double>")
    sources = spark.createDataFrame([("a", 1, 1, 11, 12), ("b", 1, 2, 12, 13), ("c", 1, 0, 11, 10), ("d", None, 0, 1, 2), ("e", 5, 0, 1, 2), ("f", 1, -1, 10, 11)], "segment_id string, way_id long, place int, src long, dst long")
    placed, problems = positions.numbered_segments(sources, ways)
    assert [tuple(x) for x in placed.collect()] == [("a", 1, 5.0, 9.0)]
    assert {x.problem: x.n for x in problems.collect()} == {"no_source_way": 1, "way_not_in_extract": 1, "nodes_do_not_match_the_way": 3}


def brute_agreement(line, record):
    def far(v):
        out = []
        for a, b in zip(record, record[1:], strict=False):
            n = math.dist(a, b) ** 2
            t = 0 if n == 0 else max(0, min(1, ((v[0] - a[0]) * (b[0] - a[0]) + (v[1] - a[1]) * (b[1] - a[1])) / n))
            out.append(math.dist(v, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))))
        return min(out)

    near = [v for v in line if far(v) <= 3]
    offsets = []
    for v in near:
        d, i = min((math.dist(v, w), i) for i, w in enumerate(record))
        if d <= 2:
            offsets.append((record[i][0] - v[0], record[i][1] - v[1]))
    if not offsets:
        return len(near), 0, None, None
    mx, my = (statistics.median(o[k] for o in offsets) for k in (0, 1))
    return len(near), len(offsets), statistics.median(math.hypot(*o) for o in offsets), statistics.median(math.hypot(o[0] - mx, o[1] - my) for o in offsets)


def test_vertex_agreement(spark):
    r = random.Random(4)
    cases = []
    for i in range(60):
        record = [(r.uniform(0, 40), r.uniform(0, 40)) for _ in range(r.randrange(2, 7))]
        line = [(x + r.choice([0, 1.2, 5]) + r.uniform(-0.3, 0.3), y + r.uniform(-0.5, 0.5)) for x, y in record]
        cases.append((i, line, record))
    schema = "i long, line array<struct<x:double,y:double>>, record array<struct<x:double,y:double>>"
    df = spark.createDataFrame([(i, [{"x": x, "y": y} for x, y in a], [{"x": x, "y": y} for x, y in b]) for i, a, b in cases] + [(100, None, [{"x": 1.0, "y": 1.0}])], schema)
    got = {x.i: x.a for x in df.select("i", linear.vertex_agreement(F.col("line"), F.col("record")).alias("a")).collect()}
    assert got[100] is None
    for i, line, record in cases:
        assert tuple(got[i]) == pytest.approx(brute_agreement(line, record), abs=1e-9, nan_ok=True)


def test_vertex_agreement_in_pieces(monkeypatch):
    """Pairs are met a piece at a time: pieces of any size give the same, also for odd lines and for slices of arrays."""
    r = random.Random(5)
    kind = pa.list_(pa.struct({"x": pa.float64(), "y": pa.float64()}))
    pairs = [[[(r.uniform(0, 9), r.uniform(0, 9)) for _ in range(r.randrange(2, 9))] for _ in "ab"] for _ in range(30)]
    odd = [([], pairs[0][1]), (pairs[0][0], []), (None, pairs[0][1]), (pairs[0][0], None), ([(0.0, 0.0), (None, 1.0), None], [(1.0, 0.0)]), ([(0.0, 0.0)], [(0.0, 0.0), (1.0, None)]), ([(0.0, 3.0)], [(0.0, 0.0), (0.0, 0.0)]), ([(0.0, math.nan)], [(0.0, 0.0)])]
    rows = [*pairs, *odd, *pairs]
    lines, records = (pa.array([x[i] if x[i] is None else [p and {"x": p[0], "y": p[1]} for p in x[i]] for x in rows], kind).slice(3) for i in (0, 1))
    wanted = [brute_agreement(a, b) for a, b in pairs] + [(0, 0, None, None), (0, 0, None, None), None, None, (1, 1, 1.0, 0.0), (0, 0, None, None), (1, 0, None, None), (0, 0, None, None)]
    for size in (1, 7, 40, 1 << 18):
        monkeypatch.setattr(linear, "PAIRS", size)
        got = [x and tuple(x.values()) for x in linear._agreements(lines, records, 3.0, 2.0).to_pylist()]
        assert len(got) == len(rows) - 3
        for x, y in zip(got, (wanted + wanted[:30])[3:], strict=True):
            assert x == (y and pytest.approx(y, abs=1e-9, nan_ok=True))
    assert linear._agreements(lines.slice(0, 0), records.slice(0, 0), 3.0, 2.0).to_pylist() == []
