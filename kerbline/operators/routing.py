"""Routes between coordinates: snapping to whole lines, an overlay of each request's own, and itemised routes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.linear import END, project_on_line
from ..storage import settled, stored
from . import graph
from .spatial import cell

WINDOWS_M = (60.0, 200.0, 500.0)
SNAP_LIMIT_M = 150.0
SPAN_LIMIT_M = 15_000.0
LEAST_PIECE_M = 0.01
"""A piece without length counts as this long."""
MAX_EXPANSIONS = 750_000


def usable_segments(costed: DataFrame) -> DataFrame:
    """(profile, segment_id): what a profile can walk in one direction at least; costed: directed edges with a cost, null if blocked."""
    return costed.filter("cost is not null").select("profile", "segment_id").distinct()


def line_boxes(segments: DataFrame) -> DataFrame:
    """segments (segment_id, line, ...) with the box of each line; those without a vertex go."""
    def bound(f, axis: str) -> Column:
        return f(F.transform("line", lambda p: p[axis]))

    boxes = {"xmin": bound(F.array_min, "x"), "xmax": bound(F.array_max, "x"), "ymin": bound(F.array_min, "y"), "ymax": bound(F.array_max, "y")}
    return segments.filter(F.size("line") > 0).withColumns(boxes)


def lines_within(points: DataFrame, lines: DataFrame, radius: float, keys: Sequence[str] = ()) -> DataFrame:
    """points with every line within radius: segment_id and at, its nearest place (see project_on_line).

    points: (x, y, keys, ...); lines: line_boxes of (segment_id, line, keys). Lines are spread over the cells of the radius's size that
    their widened boxes meet, so that a point looks into its own cell only.
    """
    spans = [F.sequence(cell(F.col(low) - radius, radius), cell(F.col(high) + radius, radius)) for low, high in (("xmin", "xmax"), ("ymin", "ymax"))]
    spread = lines.select(*keys, "segment_id", "line", "xmin", "xmax", "ymin", "ymax", F.explode(spans[0]).alias("cx"), spans[1].alias("cys")).withColumn("cy", F.explode("cys"))
    asked = points.withColumns({"cx": cell(F.col("x"), radius), "cy": cell(F.col("y"), radius)})
    near_box = (F.col("x") >= F.col("xmin") - radius) & (F.col("x") <= F.col("xmax") + radius) & (F.col("y") >= F.col("ymin") - radius) & (F.col("y") <= F.col("ymax") + radius)
    met = asked.join(spread, [*keys, "cx", "cy"]).filter(near_box).withColumn("at", project_on_line(F.col("x"), F.col("y"), F.col("line")))
    return met.filter(F.col("at.d") <= radius).drop("cx", "cy", "cys", "line", "xmin", "xmax", "ymin", "ymax")


def snapped(points: DataFrame, lines: DataFrame, keys: Sequence[str] = (), windows: Sequence[float] = WINDOWS_M, limit: float = SNAP_LIMIT_M) -> DataFrame:
    """(point_id, segment_id, fraction, x, y, d): each point's nearest line within limit; points without one are missing.

    points: (point_id, x, y, keys); lines: (segment_id, line, keys). Windows widen: only points that found nothing look into the next one,
    so most points look into small cells. What is nearest within a window is nearest of all. Ties go to the lesser segment_id.
    """
    boxes = stored(line_boxes(lines))
    open_ = points.select("point_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), *keys)
    found = []
    for window in [*(w for w in windows if w < limit), limit]:
        near = lines_within(open_, boxes, window, keys)
        best = near.groupBy("point_id").agg(F.min(F.struct("at.near", "segment_id", F.col("at.fraction").alias("fraction"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.col("at.d").alias("d"))).alias("b"))
        found.append(stored(best.select("point_id", "b.segment_id", "b.fraction", "b.x", "b.y", "b.d")))
        open_ = stored(open_.join(found[-1], "point_id", "left_anti"))
        if not open_.limit(1).count():
            break
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _relocated(ends: DataFrame, snaps: DataFrame, lines: DataFrame, parts: DataFrame, limit: float) -> DataFrame:
    """snaps with one end moved where the two ends' parts differ; requests that can't be joined keep null for `part`.

    parts: (profile, segment_id, part), 0 the largest. The nearest line of the other end's part within limit is taken, if it is nearer the
    point it stands for than the other one; the larger part wins, then the shorter move.
    """
    known = snaps.join(ends.select("point_id", "request", "side", "profile", F.col("x").alias("px"), F.col("y").alias("py")), "point_id").join(parts, ["profile", "segment_id"])
    sides = [known.filter(F.col("side") == s).select("request", "profile", *(F.col(c).alias(f"{c}_{s[0]}") for c in ("point_id", "segment_id", "fraction", "x", "y", "d", "part", "px", "py"))) for s in ("origin", "destination")]
    both = stored(sides[0].join(sides[1], ["request", "profile"]))
    fine = both.filter("part_o = part_d").withColumn("part", F.col("part_o"))
    apart = both.filter("part_o != part_d")
    movers = []
    for mine, other in (("o", "d"), ("d", "o")):
        movers.append(apart.select("request", "profile", F.lit(mine).alias("moved"), F.col(f"part_{other}").alias("part"), F.col(f"px_{mine}").alias("x"), F.col(f"py_{mine}").alias("y"), F.col(f"px_{other}").alias("fx"), F.col(f"py_{other}").alias("fy"), F.col(f"d_{mine}").alias("was")))
    wanted = movers[0].union(movers[1])
    reach = lines_within(wanted, line_boxes(lines.join(parts, ["profile", "segment_id"])), limit, ["profile", "part"])
    at = F.struct("at.near", "segment_id", F.col("at.fraction").alias("fraction"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.col("at.d").alias("d"))
    nearest = reach.groupBy("request", "moved", "part", "fx", "fy", "was").agg(F.min(at).alias("s"))
    nearest = nearest.filter(F.hypot(F.col("s.x") - F.col("fx"), F.col("s.y") - F.col("fy")) > F.col("s.d"))
    chosen = nearest.groupBy("request").agg(F.min_by(F.struct("moved", "s", "part"), F.struct("part", F.col("s.d") - F.col("was"), "moved")).alias("m"))
    moved = apart.join(chosen, "request", "left")
    for mine in ("o", "d"):
        take = F.col("m.moved") == mine
        moved = moved.withColumns({f"{c}_{mine}": F.when(take, F.col(f"m.s.{c}")).otherwise(F.col(f"{c}_{mine}")) for c in ("segment_id", "fraction", "x", "y", "d")})
    moved = moved.withColumn("part", F.col("m.part")).drop("m")
    return fine.select(moved.columns).union(moved)


def coordinate_routes(segments: DataFrame, costed: DataFrame, requests: DataFrame, parts: DataFrame | None = None, points: DataFrame | None = None, cells: DataFrame | None = None, max_expansions: int = MAX_EXPANSIONS) -> DataFrame:
    """(request, profile, outcome, cost, distance_m, origin_d, destination_d, expanded, pieces): the cheapest way between two coordinates.

    segments: (segment_id, src, dst, line, length_m), coordinates in metres; costed: (profile, segment_id, src, dst, reversed, cost), a row
    for each direction that can be walked, cost null if blocked; requests: (request, profile, ox, oy, dx, dy), request unique; parts:
    (profile, segment_id, part) of connected parts, 0 the largest, or null if all is one; points, cells: see graph.shortest_paths.

    Each end snaps to the nearest line that its profile can walk one way at least, wherever along it that is. The line is cut there for
    this request only: its pieces, prorated by length, are where the request enters and leaves the shared network, and a way along one line
    needs no junction. Pieces of a one-way line are one-way. Ends at a junction need no piece.

    pieces: array<struct(segment_id, from_fraction, to_fraction, length_m, cost)> along the way, fractions falling where a line is walked
    backwards. outcome: route, or too_far (more than 15 km apart), off_network (nothing to snap to within 150 m), disconnected (the ends'
    parts differ and neither end can move), no_route, search_limit. Null coordinates are off the network.
    """
    spark = segments.sparkSession

    def build() -> DataFrame:
        asked = stored(requests.select(F.col("request").cast("string").alias("request"), "profile", *(F.col(c).cast("double").alias(c) for c in ("ox", "oy", "dx", "dy"))))
        far = F.hypot(F.col("ox") - F.col("dx"), F.col("oy") - F.col("dy")) > SPAN_LIMIT_M
        near = asked.filter(~F.coalesce(far, F.lit(False)))
        ends = [near.select(F.concat_ws("|", F.lit(side[0]), "request").alias("point_id"), "request", F.lit(side).alias("side"), "profile", F.col(f"{side[0]}x").alias("x"), F.col(f"{side[0]}y").alias("y")) for side in ("origin", "destination")]
        ends = stored(ends[0].union(ends[1]).filter("x is not null and y is not null"))
        lines = usable_segments(costed).join(segments.select("segment_id", "line"), "segment_id")
        snaps = snapped(ends, lines, ["profile"])
        whole = parts if parts is not None else usable_segments(costed).withColumn("part", F.lit(0))
        located = stored(_relocated(ends, snaps, lines, whole, SNAP_LIMIT_M))
        joined = located.filter("part is not null")
        # Both directions of the two lines: what a piece costs for each share of the whole.
        ways = costed.groupBy("profile", "segment_id").agg(F.min(F.when(~F.col("reversed"), F.col("cost"))).alias("ahead"), F.min(F.when(F.col("reversed"), F.col("cost"))).alias("back"))
        ways = ways.join(segments.select("segment_id", "src", "dst", "length_m"), "segment_id")
        for s in ("o", "d"):
            joined = joined.join(ways.select("profile", *(F.col(c).alias(f"{c}_{s}") for c in ("segment_id", "ahead", "back", "src", "dst", "length_m"))), ["profile", f"segment_id_{s}"])
        entry = F.struct
        fo, fd = F.col("fraction_o"), F.col("fraction_d")

        def exits(s: str, f: Column, to_dst: Column, to_src: Column, value: str) -> Column:
            """The nodes that the end's pieces lead to or come from, and their costs."""
            src, dst, zero = F.col(f"src_{s}"), F.col(f"dst_{s}"), F.lit(0.0)
            both = F.filter(F.array(entry(dst.alias("node"), to_dst.alias(value)), entry(src.alias("node"), to_src.alias(value))), lambda e: e[value].isNotNull())
            return F.when(f <= END, F.array(entry(src.alias("node"), zero.alias(value)))).when(f >= 1 - END, F.array(entry(dst.alias("node"), zero.alias(value)))).otherwise(both)

        joined = joined.withColumns({
            "starts": exits("o", fo, (1 - fo) * F.col("ahead_o"), fo * F.col("back_o"), "cost"),
            "goals": exits("d", fd, (1 - fd) * F.col("back_d"), fd * F.col("ahead_d"), "rest"),
        })
        inner = (F.col("segment_id_o") == F.col("segment_id_d")) & fo.between(END, 1 - END) & fd.between(END, 1 - END)
        along = F.when(inner & (fd > fo), (fd - fo) * F.col("ahead_o")).when(inner & (fd < fo), (fo - fd) * F.col("back_o")).when(inner & (fd == fo), F.lit(LEAST_PIECE_M))
        joined = stored(joined.withColumn("along", along))
        network = costed.join(segments.select("segment_id").distinct(), "segment_id", "left_semi").select("profile", "src", "dst", F.concat_ws("|", F.when(F.col("reversed"), "b").otherwise("a"), "segment_id").alias("segment_id"), "cost")
        over = joined.select("request", "profile", "starts", "goals", F.col("x_d").alias("goal_x"), F.col("y_d").alias("goal_y"))
        found, told = graph.overlay_paths(network, over, cells=cells, points=points, max_expansions=max_expansions)
        found = stored(found.withColumnRenamed("cost", "way_cost"))
        best = joined.join(found.select("request", "node", "start", "way_cost", "path"), "request", "left").join(told, "request", "left")
        direct = F.col("along").isNotNull() & (F.col("way_cost").isNull() | (F.col("along") <= F.col("way_cost")))
        best = stored(best.withColumn("direct", direct).withColumn("cost", F.when(F.col("direct"), F.col("along")).otherwise(F.col("way_cost"))))
        pieces = _pieces(best, costed, segments)
        totals = pieces.groupBy("request").agg(F.sum("length_m").alias("distance_m"), F.sort_array(F.collect_list(F.struct("nth", "segment_id", "from_fraction", "to_fraction", "length_m", "cost"))).alias("pieces"))
        out = asked.join(best.select("request", "cost", F.col("d_o").alias("origin_d"), F.col("d_d").alias("destination_d"), "expanded", "stopped"), "request", "left").join(totals, "request", "left")
        out = out.join(located.select("request", "part", F.lit(True).alias("snapped")), "request", "left")
        outcome = (
            F.when(F.coalesce(far, F.lit(False)), "too_far").when(F.col("snapped").isNull(), "off_network").when(F.col("part").isNull(), "disconnected")
            .when(F.col("cost").isNotNull(), "route").when(F.col("stopped"), "search_limit").otherwise("no_route")
        )
        shown = F.transform("pieces", lambda p: F.struct(p["segment_id"].alias("segment_id"), p["from_fraction"].alias("from_fraction"), p["to_fraction"].alias("to_fraction"), p["length_m"].alias("length_m"), p["cost"].alias("cost")))
        return out.select(F.col("request").cast(requests.schema["request"].dataType).alias("request"), "profile", outcome.alias("outcome"), "cost", F.when(F.col("cost").isNotNull(), F.coalesce("distance_m", F.lit(0.0))).alias("distance_m"), "origin_d", "destination_d", "expanded", F.when(F.col("cost").isNotNull(), F.coalesce(shown, F.array().cast("array<struct<segment_id:string,from_fraction:double,to_fraction:double,length_m:double,cost:double>>"))).alias("pieces"))

    return settled(build)


def _pieces(best: DataFrame, costed: DataFrame, segments: DataFrame) -> DataFrame:
    """(request, nth, segment_id, from_fraction, to_fraction, length_m, cost) of each route's pieces; fractions fall where it walks backwards."""
    def piece(nth: int, segment: str, start: Column, end: Column, cost: Column, length: Column) -> Column:
        return F.struct(F.lit(nth).cast("long").alias("nth"), F.col(segment).cast("string").alias("segment_id"), start.alias("from_fraction"), end.alias("to_fraction"), F.greatest(length, F.lit(LEAST_PIECE_M)).alias("length_m"), cost.alias("cost"))

    fo, fd, last = F.col("fraction_o"), F.col("fraction_d"), 1 << 40
    direct = piece(0, "segment_id_o", fo, fd, F.col("along"), F.abs(fd - fo) * F.col("length_m_o"))
    # A line whose ends are one node can be left by either; the cheaper piece is the one that the search took.
    leave_dst = (F.col("start") == F.col("dst_o")) & F.col("ahead_o").isNotNull() & ((F.col("src_o") != F.col("dst_o")) | F.col("back_o").isNull() | ((1 - fo) * F.col("ahead_o") <= fo * F.col("back_o")))
    reach_src = (F.col("node") == F.col("src_d")) & F.col("ahead_d").isNotNull() & ((F.col("src_d") != F.col("dst_d")) | F.col("back_d").isNull() | (fd * F.col("ahead_d") <= (1 - fd) * F.col("back_d")))
    first = F.when(leave_dst, piece(0, "segment_id_o", fo, F.lit(1.0), (1 - fo) * F.col("ahead_o"), (1 - fo) * F.col("length_m_o"))).otherwise(piece(0, "segment_id_o", fo, F.lit(0.0), fo * F.col("back_o"), fo * F.col("length_m_o")))
    final = F.when(reach_src, piece(last, "segment_id_d", F.lit(0.0), fd, fd * F.col("ahead_d"), fd * F.col("length_m_d"))).otherwise(piece(last, "segment_id_d", F.lit(1.0), fd, (1 - fd) * F.col("back_d"), (1 - fd) * F.col("length_m_d")))
    cut = [F.when(f.between(END, 1 - END), F.array(p)).otherwise(F.array().cast("array<struct<nth:bigint,segment_id:string,from_fraction:double,to_fraction:double,length_m:double,cost:double>>")) for f, p in ((fo, first), (fd, final))]
    own = best.filter("cost is not null").select("request", F.explode(F.when(F.col("direct"), F.array(direct)).otherwise(F.concat(*cut))).alias("p")).select("request", "p.*")
    steps = best.filter("cost is not null and not direct").select("request", "profile", F.posexplode("path").alias("at", "step"))
    steps = steps.select("request", "profile", (F.col("at") + 1).cast("long").alias("nth"), (F.substring("step", 1, 1) == "b").alias("reversed"), F.expr("substring(step, 3)").alias("segment_id"))
    costs = costed.groupBy("profile", F.col("segment_id").cast("string").alias("segment_id"), "reversed").agg(F.min("cost").alias("cost"))
    lengths = segments.select(F.col("segment_id").cast("string").alias("segment_id"), "length_m")
    walked = steps.join(costs, ["profile", "segment_id", "reversed"]).join(lengths, "segment_id")
    back = F.col("reversed").cast("double")
    return own.unionByName(walked.select("request", "nth", "segment_id", back.alias("from_fraction"), (1 - back).alias("to_fraction"), "length_m", "cost"))


def segment_parts(costed: DataFrame) -> DataFrame:
    """(profile, segment_id, part) of what each profile can walk: connected parts, 0 the one with most nodes (ties: the least node)."""
    walkable = costed.filter("cost is not null")
    ends = walkable.select(F.struct("profile", F.col("src").alias("node")).alias("u"), F.struct("profile", F.col("dst").alias("node")).alias("v")).distinct()
    named = ends.select(*(F.concat_ws("|", f"{c}.profile", F.col(f"{c}.node").cast("string")).alias(c) for c in ("u", "v")), F.col("u.profile").alias("profile"))
    roots = graph.connected_parts(named, "u", "v")
    sizes = roots.groupBy("root").agg(F.count("*").alias("n"))
    keys = walkable.groupBy("profile", "segment_id").agg(F.min(F.concat_ws("|", "profile", F.col("src").cast("string"))).alias("node"))
    rows = keys.join(roots, "node").join(sizes, "root")
    order = stored(rows.select("profile", "root", "n").distinct())
    numbered = graph.global_rank(order, [F.col("profile"), F.col("n").desc(), F.col("root")])
    first = numbered.groupBy("profile").agg(F.min("rank").alias("first"))
    part = numbered.join(first, "profile").select("root", (F.col("rank") - F.col("first")).alias("part"))
    return rows.join(part, "root").select("profile", "segment_id", "part")
