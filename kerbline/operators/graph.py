"""Street graphs as edge tables: directions, components, batches of shortest paths, counterfactuals."""

from __future__ import annotations

import math
from collections import defaultdict
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.search import Labels, least, remaining, spans
from ..functions.tags import reversed_conveying
from ..storage import settled, stored
from .windows import global_rank

MAX_ROUNDS = 10_000
CELL_EDGES = 200_000
"""Edges that a task relaxes as one piece, where no cells are given."""
CELL_NODES = 50_000
"""Nodes of a cell of even_cells."""
BATCH = 128
"""Requests that a task relaxes together inside a cell; one for ways to every node, which tells all of a cell's nodes, counts as EVERY of them."""
EVERY = 4
SLOTS = 1 << 22
"""Labels that a task holds at once, of requests x nodes of a cell."""
SETTLED, EXIT, SPENT = 0, 1, 2
"""Kinds of rows that a relaxed cell gives: settled nodes, nodes across its border, and how many nodes a request expanded."""


def directed(segments: DataFrame) -> DataFrame:
    """A row for each direction that can be walked; the reverse row has its slope and conveying turned."""
    ahead = segments.filter("foot_forward").withColumn("reversed", F.lit(False))
    turned = {"src": F.col("dst"), "dst": F.col("src"), "reversed": F.lit(True)}
    if "effective_grade" in segments.columns:
        turned["effective_grade"] = -F.col("effective_grade")
    if "conveying" in segments.columns:
        turned["conveying"] = reversed_conveying(F.col("conveying"))
    return ahead.unionByName(segments.filter("foot_backward").withColumns(turned))


def _star_round(links: DataFrame) -> DataFrame:
    """A node's larger neighbours moved to its least neighbour, then its smaller ones moved likewise."""
    both = links.select(F.col("v").alias("n"), F.col("u").alias("m")).union(links.select(F.col("u").alias("n"), F.col("v").alias("m")))
    # Stored minima leave nothing but exchanges under the joins, so that a hub's rows can be split. Both sides grow with the links: small as
    # a stored table may be, it is many times larger as a broadcast, which the driver would hold.
    least = stored(both.groupBy("n").agg(F.least(F.min("m"), F.col("n")).alias("least")))
    large = stored(both.join(least.hint("merge"), "n").filter("m > n").select(F.col("m").alias("v"), F.col("least").alias("u")).distinct())
    low = stored(large.groupBy("v").agg(F.min("u").alias("least")))
    ends = F.explode(F.array(F.struct("v", F.col("least").alias("u")), F.struct(F.col("u").alias("v"), F.col("least").alias("u"))))
    return large.join(low.hint("merge"), "v").select(ends.alias("e")).select("e.*").filter("u < v").distinct()


def star_roots(links: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the links (u, v) reaches, for all nodes but roots.

    Rounds of grouped minima joined back alternate until the links form stars, so their number is logarithmic and no node's neighbours are collected.
    """
    stars = stored(links.select(F.greatest("u", "v").alias("v"), F.least("u", "v").alias("u")).filter("u < v").distinct())
    seen = None
    while True:
        stars = settled(lambda links=stars: _star_round(links))
        now = tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            return stars.select(F.col("v").alias("node"), F.col("u").alias("root"))
        seen = now


def connected_parts(edges: DataFrame, u: str = "src", v: str = "dst") -> DataFrame:
    """(node, root): the least node of each weakly connected part, for all nodes of the edges."""
    nodes = edges.select(F.explode(F.array(u, v)).alias("node")).distinct()
    roots = settled(lambda: star_roots(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))))
    return nodes.join(roots.hint("merge"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def numbered_parts(parts: DataFrame) -> DataFrame:
    """(node, part): parts numbered from 0 by falling size, then least node. Numbering sorts the parts, not the nodes."""
    sizes = parts.groupBy("root").agg(F.count("*").alias("size"))
    ranks = global_rank(sizes, [F.col("size").desc(), F.col("root").asc()], "part").withColumn("part", F.col("part") - 1)
    return parts.join(ranks, "root").select("node", "part", "size")


KIND_TYPES = {"request": pa.string(), "profile": pa.string(), "node": None, "cell": pa.int64(), "cost": pa.float64(), "hops": pa.int32(), "segment_id": pa.string(), "parent": None, "kind": pa.int32()}


def _relax(entries: pa.Table, edges: pa.Table) -> pa.Table:
    """Settles what a batch of requests can reach inside one cell, from the nodes at which they enter it.

    Labels (cost, hops, segment) only get less, so ties are settled alike in any order. What is told of a request that has goals are its
    arrivals and exits and the nodes on the way to them; of others, all nodes. Requests that may expand no more nodes than they did are
    searched anew, one at a time and node by node, as only the order tells which nodes those are.
    """
    node_type = edges.schema.field("src").type
    schema = pa.schema([(k, t or node_type) for k, t in KIND_TYPES.items()])
    if not entries.num_rows:
        return schema.empty_table()
    entries, edges = entries.combine_chunks(), edges.combine_chunks()
    profile, cell = entries.column("profile")[0].as_py(), entries.column("cell")[0].as_py()
    flat = {c: pa.concat_arrays(edges.column(c).chunks) if edges.num_rows else pa.array([], edges.schema.field(c).type) for c in ("src", "dst", "segment_id", "w", "dst_cell", "dst_x", "dst_y")}
    own = {c: pa.concat_arrays(entries.column(c).chunks) for c in ("request", "node", "cost", "hops", "segment_id", "parent", "goals", "limit", "goal_x", "goal_y", "lower", "left")}
    nodes = pa.concat_arrays([flat["src"], flat["dst"], own["node"]]).dictionary_encode()
    codes, names = nodes.indices.to_numpy(zero_copy_only=False), nodes.dictionary
    src, dst, start = np.split(codes, [edges.num_rows, 2 * edges.num_rows])
    segments = pa.concat_arrays([flat["segment_id"], pc.fill_null(own["segment_id"], "")]).dictionary_encode()
    order = pc.array_sort_indices(segments.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(len(order))
    via, last = np.split(place[segments.indices.to_numpy(zero_copy_only=False)], [edges.num_rows])
    segment_names = segments.dictionary.take(pa.array(order))

    def floats(values: pa.Array, missing: float) -> np.ndarray:
        return pc.fill_null(values, missing).to_numpy(zero_copy_only=False).astype(np.float64)

    x, y = np.full(len(names), np.nan), np.full(len(names), np.nan)
    x[dst], y[dst] = floats(flat["dst_x"], np.nan), floats(flat["dst_y"], np.nan)
    weight, inner = floats(flat["w"], np.nan), flat["dst_cell"].to_numpy(zero_copy_only=False) == cell

    def by_source(which: np.ndarray) -> tuple[np.ndarray, ...]:
        e = np.flatnonzero(which)
        e = e[np.argsort(src[e], kind="stable")]
        return np.searchsorted(src[e], np.arange(len(names) + 1)), dst[e], weight[e], via[e]

    within, across = by_source(inner), by_source(~inner)
    asked = own["request"].dictionary_encode()
    of, ids = asked.indices.to_numpy(zero_copy_only=False), asked.dictionary
    head = np.unique(of, return_index=True)[1]
    limit, gx, gy, left = (floats(own[c].take(pa.array(head)), m) for c, m in (("limit", np.inf), ("goal_x", np.nan), ("goal_y", np.nan), ("left", np.inf)))
    wanted = own["goals"].take(pa.array(head))
    every = wanted.is_null().to_numpy(zero_copy_only=False)
    goal_of = np.repeat(np.arange(len(head)), pc.fill_null(pc.list_value_length(wanted), 0).to_numpy(zero_copy_only=False))
    inner_goals = dict(zip((f.name for f in wanted.type.value_type), wanted.flatten().flatten(), strict=True))
    goal_node, rest = pc.fill_null(pc.index_in(inner_goals["node"], names), -1).to_numpy(zero_copy_only=False), floats(inner_goals["rest"], 0.0)
    cost, hops, lower = floats(own["cost"], 0.0), own["hops"].to_numpy(zero_copy_only=False).astype(np.int32), floats(own["lower"], 0.0)
    known = pa.concat_arrays([names, own["parent"]])
    width = 2 * float(np.mean(weight)) if len(weight) else 0.0
    told, n = [], len(names)

    def tell(request: np.ndarray, node: pa.Array, at: pa.Array, cost: np.ndarray, hops: np.ndarray, segment: np.ndarray | None, parent: pa.Array, kind: int) -> None:
        name = pa.nulls(len(request), pa.string())
        if segment is not None:
            name = segment_names.take(pa.array(segment))
            name = pc.if_else(pc.equal(name, ""), pa.scalar(None, pa.string()), name)
        columns = (ids.take(pa.array(request)), pa.repeat(pa.scalar(profile, pa.string()), len(request)), node, at, pa.array(cost, pa.float64()), pa.array(hops, pa.int32()), name, parent, pa.repeat(pa.scalar(kind, pa.int32()), len(request)))
        told.append(pa.Table.from_arrays(list(columns), schema=schema))

    step, again = max(1, SLOTS // n), []
    for low in range(0, len(head), step):
        high = min(low + step, len(head))
        rows, mine = np.flatnonzero((of >= low) & (of < high)), np.flatnonzero((goal_of >= low) & (goal_of < high) & (goal_node >= 0))
        labels = Labels(high - low, n, limit[low:high].copy(), gx[low:high], gy[low:high], x, y)
        slot, goal_slot = (of[rows].astype(np.int64) - low) * n + start[rows], (goal_of[mine] - low) * n + goal_node[mine]
        labels.settle((slot, cost[rows], hops[rows], last[rows], lower[rows]), within, (goal_slot, rest[mine]), width)
        reached = np.flatnonzero(np.isfinite(labels.cost))
        f = labels.cost[reached] + remaining(x[reached % n], y[reached % n], labels.gx[reached // n], labels.gy[reached // n])
        f[np.searchsorted(reached, slot)] = labels.cost[slot] + lower[rows]
        reached = reached[f <= labels.limit[reached // n]]
        expanded = np.bincount(reached // n, minlength=high - low)
        cut = expanded >= left[low:high]
        again += list(low + np.flatnonzero(cut))
        reached = reached[~cut[reached // n]]
        # Nodes across the border, each by its best way.
        degree = across[0][reached % n + 1] - across[0][reached % n]
        e, base = spans(across[0][reached % n], degree), np.repeat(reached, degree)
        new, to = labels.cost[base] + across[2][e], base - base % n + across[1][e]
        f = new + remaining(x[to % n], y[to % n], labels.gx[to // n], labels.gy[to // n])
        e, base, new, to = (v[f <= labels.limit[to // n]] for v in (e, base, new, to))
        best = least(to, new, labels.hops[base] + 1, across[3][e])
        e, base, new, to = e[best], base[best], new[best], to[best]
        leads = flat["dst_cell"].take(pa.array(np.flatnonzero(~inner)[np.argsort(src[~inner], kind="stable")][e]))
        tell(low + to // n, names.take(pa.array(to % n)), leads.cast(pa.int64()), new, labels.hops[base] + 1, across[3][e], names.take(pa.array(base % n)), EXIT)
        arrived = goal_slot[np.isfinite(labels.cost[goal_slot]) & (labels.cost[goal_slot] + rest[mine] <= labels.limit[goal_slot // n]) & ~cut[goal_slot // n]]
        on = np.union1d(labels.ways(np.concatenate([arrived, base[~every[low + base // n]]])), reached[every[low + reached // n]])
        parent = labels.parent[on].astype(np.int64)
        parent = np.where(parent >= 0, parent, n + rows[np.maximum(-2 - parent, 0)])
        tell(low + on // n, names.take(pa.array(on % n)), pa.repeat(pa.scalar(cell, pa.int64()), len(on)), labels.cost[on], labels.hops[on], labels.last[on], known.take(pa.array(parent)), SETTLED)
        done = np.flatnonzero(~cut)
        tell(low + done, pa.nulls(len(done), node_type), pa.repeat(pa.scalar(cell, pa.int64()), len(done)), expanded[done].astype(np.float64), np.zeros(len(done), np.int32), None, pa.nulls(len(done), node_type), SPENT)
    if again:
        told.append(_search(entries.filter(pc.is_in(entries.column("request"), ids.take(pa.array(again)))), edges, schema))
    return pa.concat_tables(told)


def _search(entries: pa.Table, edges: pa.Table, schema: pa.Schema) -> pa.Table:
    """_relax of requests that stop after so many nodes, by Dijkstra's algorithm."""
    out: dict[str, list] = {f.name: [] for f in schema}
    profile, cell = entries.column("profile")[0].as_py(), entries.column("cell")[0].as_py()
    ahead: dict = defaultdict(list)
    for src, *edge in zip(*(edges.column(c).to_pylist() for c in ("src", "dst", "segment_id", "w", "dst_cell", "dst_x", "dst_y")), strict=True):
        ahead[src].append(edge)
    asked: dict = defaultdict(list)
    for request, *entry in zip(*(entries.column(c).to_pylist() for c in ("request", "node", "cost", "hops", "segment_id", "parent", "goals", "limit", "goal_x", "goal_y", "lower", "left")), strict=True):
        asked[request].append(entry)

    def row(request: str, node, at: int, cost: float, hops: int, segment: str | None, parent, kind: int) -> None:
        for k, v in zip(out, (request, profile, node, at, cost, hops, segment, parent, kind), strict=True):
            out[k].append(v)

    for request, starts in asked.items():
        goals, limit, gx, gy = starts[0][5:9]
        left = starts[0][10]
        rest: dict = {}
        for g in goals or []:
            rest[g["node"]] = min(g["rest"], rest.get(g["node"], math.inf))
        limit = math.inf if limit is None else limit
        label: dict = {}
        heap: list = []
        pushed = expanded = 0
        for node, cost, hops, segment, parent, *_, lower, _ in starts:
            if node not in label or (cost, hops, segment or "") < label[node][:3]:
                label[node] = (cost, hops, segment or "", parent)
                pushed += 1
                heap.append((cost + lower, cost, hops, segment or "", pushed, node))
        heapify(heap)
        exits: dict = {}
        settled_here, arrivals = set(), []
        while heap and heap[0][0] <= limit and (left is None or expanded < left):
            _, cost, hops, segment, _, node = heappop(heap)
            if label[node][:3] != (cost, hops, segment):
                continue
            expanded += 1
            settled_here.add(node)
            if node in rest:
                arrivals.append(node)
                limit = min(limit, cost + rest[node])
            for dst, via, w, dst_cell, x, y in ahead.get(node, ()):
                lower = 0.0 if gx is None or x is None else math.hypot(x - gx, y - gy)
                new = (cost + w, hops + 1, via)
                if new[0] + lower > limit:
                    continue
                if dst_cell != cell:
                    if dst not in exits or new < exits[dst][0]:
                        exits[dst] = new, node, dst_cell
                elif dst not in label or new < label[dst][:3]:
                    label[dst] = (*new, node)
                    pushed += 1
                    heappush(heap, (new[0] + lower, *new, pushed, dst))
        leaving = [(dst, *exit_) for dst, exit_ in exits.items() if exit_[0][0] <= limit]
        if goals is None:
            told = settled_here
        else:
            told = set()
            for node in [*arrivals, *(node for _, _, node, _ in leaving)]:
                while node in label and node not in told:
                    told.add(node)
                    node = label[node][3]
        for node in told:
            cost, hops, segment, parent = label[node]
            row(request, node, cell, cost, hops, segment or None, parent, SETTLED)
        for dst, (cost, hops, via), node, at in leaving:
            row(request, dst, at, cost, hops, via, node, EXIT)
        row(request, None, cell, float(expanded), int(left is not None and expanded >= left), None, None, SPENT)
    return pa.table(out, schema)


def _walk(rows: pa.Table) -> pa.Table:
    """Paths of one request from its nodes' parents: to its best goal, or to every node if it has none."""
    known = {n: rest for n, *rest in zip(*(rows.column(c).to_pylist() for c in ("node", "cost", "hops", "segment_id", "parent")), strict=True)}
    goals = rows.column("goals")[0].as_py()
    paths: dict = {}

    def path(node) -> tuple[object, list[str]]:
        """(where it starts, segments)."""
        way = []
        while known[node][3] is not None and node not in paths:
            way.append(node)
            node = known[node][3]
        start, found = paths.get(node, (node, []))
        if goals is not None:
            return start, [known[n][2] for n in reversed(way)]
        for n in reversed(way):
            start, found = paths[n] = start, [*found, known[n][2]]
        return start, found

    if goals is None:
        wanted = [(n, 0.0) for n in known]
    else:
        wanted = sorted(((known[g["node"]][0] + g["rest"], known[g["node"]][1], known[g["node"]][2] or "", i, g["node"], g["rest"]) for i, g in enumerate(goals) if g["node"] in known))[:1]
        wanted = [(node, rest) for *_, node, rest in wanted]
    found = [path(n) for n, _ in wanted]
    kind = rows.schema.field("node").type
    columns = {c: pa.array([rows.column(c)[0].as_py()] * len(wanted), pa.string()) for c in ("request", "profile")}
    columns |= {"node": pa.array([n for n, _ in wanted], kind), "cost": pa.array([known[n][0] + rest for n, rest in wanted], pa.float64()), "hops": pa.array([known[n][1] for n, _ in wanted], pa.int32())}
    return pa.table(columns | {"start": pa.array([s for s, _ in found], kind), "path": pa.array([p for _, p in found], pa.list_(pa.string()))})


def overlay_paths(edges: DataFrame, requests: DataFrame, cells: DataFrame | None = None, points: DataFrame | None = None, max_rounds: int = MAX_ROUNDS, max_expansions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """((request, profile, node, cost, hops, start, path), (request, expanded, stopped)): cheapest ways over an overlay of each request's own.

    edges: (profile, src, dst, segment_id, cost), null costs are skipped. requests: (request, profile, starts, goals, goal_x, goal_y) with
    starts array<struct(node, cost)>: where the request's own first pieces enter the network, at which cost; goals array<struct(node,
    rest)>: where its last pieces leave it, and what they cost, or null for ways to every node; goal_x and goal_y are null or the place it
    goes to in metres, if no edge or piece costs less than its length. The network itself is shared and never changed. cells, points: see
    shortest_paths. A request stops when a round begins or goes on after max_expansions nodes.

    A round relaxes the entries of all requests inside their cells, a batch of requests and a cell at a time; only nodes across a cell's
    border go on, if their label (cost, hops, last segment) beats the request's earlier ones there and can beat its best arrival. So
    rounds are as many as cells in a row on a way. Paths are walked at the end, a request at a time.
    """
    node_type = edges.schema["src"].dataType
    node = node_type.simpleString()
    usable = edges.filter("cost is not null").select("profile", "src", "dst", F.col("segment_id").cast("string").alias("segment_id"), F.col("cost").cast("double").alias("w"))
    if cells is None:
        usable = stored(usable)
        pieces = max(1, math.ceil(usable.count() / CELL_EDGES))

        def celled(df: DataFrame, key: str, name: str) -> DataFrame:
            return df.withColumn(name, F.pmod(F.xxhash64(key), F.lit(pieces)) if pieces > 1 else F.lit(0).cast("long"))
    else:
        def celled(df: DataFrame, key: str, name: str) -> DataFrame:
            return df.join(cells.select(F.col("node").alias(key), F.col("cell").cast("long").alias(name)).hint("merge"), key)

    def placed(df: DataFrame, key: str, x: str, y: str) -> DataFrame:
        if points is None:
            return df.withColumns({x: F.lit(None).cast("double"), y: F.lit(None).cast("double")})
        return df.join(points.select(F.col("node").alias(key), F.col("x").cast("double").alias(x), F.col("y").cast("double").alias(y)).hint("merge"), key, "left")

    # Nodes, cells and requests grow with the network: none of them is broadcast, as the driver would hold each copy.
    usable = stored(placed(celled(celled(usable, "src", "cell"), "dst", "dst_cell"), "dst", "dst_x", "dst_y"))
    asked = stored(requests.select(F.col("request").cast("string").alias("request"), "profile", "starts", "goals", "goal_x", "goal_y"))
    goals = asked.select("request", "goals", "goal_x", "goal_y")
    first = asked.select("request", "profile", F.explode("starts").alias("s")).select("request", "profile", F.col("s.node").alias("node"), F.col("s.cost").alias("cost"))
    nothing = {"hops": F.lit(0), "segment_id": F.lit(None).cast("string"), "parent": F.lit(None).cast(node_type)}
    first = celled(first.groupBy("request", "profile", "node").agg(F.min("cost").alias("cost")), "node", "cell").withColumns(nothing)
    entered = stored(first.select("request", "profile", "node", "cell", "cost", "hops", "segment_id", "parent"))
    fresh, settled_rows = entered, []
    told = stored(asked.select("request", F.lit(None).cast("double").alias("limit"), F.lit(0.0).alias("expanded"), F.lit(0).alias("stopped")))
    rest_of = asked.select("request", F.explode("goals").alias("g")).groupBy("request", F.col("g.node").alias("node")).agg(F.min("g.rest").alias("rest"))
    keys = ["profile", "cell", "batch"]
    for _ in range(max_rounds):
        lower = F.coalesce(F.hypot(F.col("x") - F.col("goal_x"), F.col("y") - F.col("goal_y")), F.lit(0.0))
        rows = placed(fresh.join(goals.hint("merge"), "request").join(told.hint("merge"), "request"), "node", "x", "y").withColumn("lower", lower).drop("x", "y")
        rows = rows.withColumn("left", F.lit(None).cast("double") if max_expansions is None else max_expansions - F.col("expanded"))
        rows = rows.filter("(limit is null or cost + lower <= limit) and (left is null or left > 0)")
        rows = stored(rows)
        weight = F.when(F.col("goals").isNull(), EVERY).otherwise(1)
        there = rows.groupBy("profile", "cell", "request").agg(F.max(weight).alias("_w")).groupBy("profile", "cell").agg(F.ceil(F.sum("_w") / BATCH).alias("_n"))
        rows = rows.join(there, ["profile", "cell"]).withColumn("batch", F.pmod(F.xxhash64("request"), F.col("_n"))).drop("_n")
        # A cell's edges go to the batches of requests that enter it now, and to no others.
        active = usable.join(rows.select(*keys).distinct(), ["profile", "cell"])
        # New columns, as both sides come from the same tables.
        entries, near = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (rows, active))
        found = entries.groupBy(*keys).cogroup(near.groupBy(*keys)).applyInArrow(_relax, f"request string, profile string, node {node}, cell long, cost double, hops int, segment_id string, parent {node}, kind int")
        found = stored(found)
        settled_rows.append(found.filter(F.col("kind") == SETTLED).drop("kind", "cell"))
        best = F.min(F.struct("cost", "hops", "segment_id", "parent")).alias("b")
        exits = found.filter(F.col("kind") == EXIT).groupBy("request", "profile", "node", "cell").agg(best).select("request", "profile", "node", "cell", "b.*")
        before = entered.groupBy("request", "node").agg(F.min(F.struct("cost", "hops", F.coalesce("segment_id", F.lit("")).alias("segment_id"))).alias("had"))
        better = F.col("had").isNull() | (F.struct("cost", "hops", F.coalesce("segment_id", F.lit("")).alias("segment_id")) < F.col("had"))
        fresh = stored(exits.join(before.hint("merge"), ["request", "node"], "left").filter(better).drop("had"))
        arrived = settled_rows[-1].join(rest_of.hint("merge"), ["request", "node"]).groupBy("request").agg(F.min(F.col("cost") + F.col("rest")).alias("new"))
        spent = found.filter(F.col("kind") == SPENT).groupBy("request").agg(F.sum("cost").alias("more"), F.max("hops").alias("cut"))
        told = told.join(arrived.hint("merge"), "request", "left").join(spent.hint("merge"), "request", "left")
        told = stored(told.select("request", F.least("limit", "new").alias("limit"), (F.col("expanded") + F.coalesce("more", F.lit(0.0))).alias("expanded"), F.greatest("stopped", F.coalesce("cut", F.lit(0))).alias("stopped")))
        if not fresh.limit(1).count():
            break
        entered = stored(entered.unionByName(fresh).groupBy("request", "profile", "node", "cell").agg(best).select("request", "profile", "node", "cell", "b.*"))
    rows = _union(settled_rows).groupBy("request", "profile", "node").agg(F.min(F.struct("cost", "hops", "segment_id", "parent")).alias("b")).select("request", "profile", "node", "b.*")
    out = rows.join(goals.select("request", "goals").hint("merge"), "request").groupBy("request").applyInArrow(_walk, f"request string, profile string, node {node}, cost double, hops int, start {node}, path array<string>")
    own = requests.schema["request"].dataType
    return out.withColumn("request", F.col("request").cast(own)), told.select(F.col("request").cast(own).alias("request"), F.col("expanded").cast("long").alias("expanded"), (F.col("stopped") > 0).alias("stopped"))


def shortest_paths(edges: DataFrame, requests: DataFrame, cells: DataFrame | None = None, points: DataFrame | None = None, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """(request, profile, node, cost, hops, path): the cheapest way from each request's origin to its destination, or to every node if that is null.

    edges: (profile, src, dst, segment_id, cost); requests: (request, profile, origin, destination or null). Blocked edges have a null
    cost and are skipped. cells: (node, cell), a partition of the nodes into pieces of neighbours that fit a task, such as even_cells;
    without it nodes are dealt by hash into pieces of CELL_EDGES edges, so a small graph is one piece. points: (node, x, y) in metres, if no
    edge costs less than its length: the straight line to the destination then bounds what is left, as in A*.

    See overlay_paths. Ties go to fewer hops, then the lesser last segment, whatever the cells are.
    """
    node_type = edges.schema["src"].dataType
    goal = F.col("destination").cast(node_type) if "destination" in requests.columns else F.lit(None).cast(node_type)
    asked = requests.select("request", "profile", F.array(F.struct(F.col("origin").cast(node_type).alias("node"), F.lit(0.0).alias("cost"))).alias("starts"), goal.alias("goal"))
    asked = asked.withColumn("goals", F.when(F.col("goal").isNotNull(), F.array(F.struct(F.col("goal").alias("node"), F.lit(0.0).alias("rest")))))
    if points is None:
        asked = asked.withColumns({"goal_x": F.lit(None).cast("double"), "goal_y": F.lit(None).cast("double")})
    else:
        asked = asked.join(points.select(F.col("node").alias("goal"), F.col("x").cast("double").alias("goal_x"), F.col("y").cast("double").alias("goal_y")).hint("merge"), "goal", "left")
    return overlay_paths(edges, asked, cells, points, max_rounds)[0].drop("start")


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def grid_cells(points: DataFrame, size: float) -> DataFrame:
    """(node, cell) of points (node, x, y) by squares of a size, so that neighbours share a cell."""
    return points.select("node", F.xxhash64(F.floor(F.col("x") / size), F.floor(F.col("y") / size)).alias("cell"))


def _spread_bits(n: Column) -> Column:
    """The 16 low bits with a zero before each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        n = n.bitwiseOR(F.shiftleft(n, shift)).bitwiseAND(mask)
    return n


def even_cells(points: DataFrame, nodes: int = CELL_NODES) -> DataFrame:
    """(node, cell) of points (node, x, y): runs of so many nodes along a Z-curve, so cells hold neighbours and are as large as a task can take, however dense."""
    box = points.agg(*(f(c).cast("double").alias(f"{n}_{c}") for n, f in (("low", F.min), ("high", F.max)) for c in ("x", "y"))).first()
    if box["low_x"] is None:
        return points.select("node", F.lit(0).cast("long").alias("cell"))

    def step(c: str) -> Column:
        width = (box[f"high_{c}"] - box[f"low_{c}"]) or 1.0
        return _spread_bits(F.floor((F.col(c) - box[f"low_{c}"]) / width * 0xFFFF).cast("long"))

    curve = step("x").bitwiseOR(F.shiftleft(step("y"), 1))
    ranked = global_rank(points.select("node", curve.alias("curve")), [F.col("curve").asc(), F.col("node").asc()])
    return ranked.select("node", F.floor((F.col("rank") - 1) / nodes).cast("long").alias("cell"))


def routes(edges: DataFrame, requests: DataFrame, **how) -> DataFrame:
    """requests with cost, hops and path to the destination; null where there is no way."""
    found = shortest_paths(edges, requests, **how)
    return requests.join(found.withColumnRenamed("node", "destination").hint("merge"), ["request", "profile", "destination"], "left")


def compared(found: DataFrame, baseline: str = "standard") -> DataFrame:
    """Each request's route under each other profile beside the baseline's: costs, extra, and whether both are the same path."""
    base = found.filter(F.col("profile") == baseline).select("origin", "destination", F.col("cost").alias("base_cost"), F.col("path").alias("base_path"))
    other = found.filter(F.col("profile") != baseline)
    same = F.col("path").eqNullSafe(F.col("base_path"))
    return other.join(base, ["origin", "destination"]).withColumn("same_path", same)


def substituted(segments: DataFrame, replacements: DataFrame, columns: list[str], key: str = "segment_id") -> DataFrame:
    """segments with the given columns replaced where a replacement isn't null: a counterfactual graph."""
    r = replacements.select(key, *(F.col(c).alias(f"_r_{c}") for c in columns))
    return segments.join(r, key, "left").withColumns({c: F.coalesce(f"_r_{c}", c) for c in columns}).drop(*(f"_r_{c}" for c in columns))


def recosted(found: DataFrame, edges: DataFrame) -> DataFrame:
    """(request, profile, path_cost, newly_blocked): the cost of fixed paths under other edge costs; null if a segment is blocked there."""
    pieces = found.select("request", "profile", F.explode("path").alias("segment_id"))
    costs = edges.groupBy("profile", F.col("segment_id").cast("string").alias("segment_id")).agg(F.min("cost").alias("cost"))
    rows = pieces.join(costs, ["profile", "segment_id"], "left")
    blocked = F.count_if(F.col("cost").isNull())
    return rows.groupBy("request", "profile").agg(F.when(blocked == 0, F.sum("cost")).alias("path_cost"), blocked.alias("newly_blocked"))


def outcome(base: Column, other: Column, recost: Column, tolerance: float = 0.01) -> Column:
    """What a substitution did to a route."""
    return (
        F.when(base.isNull() & other.isNull(), "no_route").when(base.isNull(), "opened").when(other.isNull(), "closed")
        .when(recost.isNull(), "rerouted_blocked").when(other < recost - tolerance, "rerouted").when(F.abs(recost - base) > tolerance, "same_path_new_cost").otherwise("unchanged")
    )


def contracted(segments: DataFrame, attributes: list[str]) -> DataFrame:
    """(chain_id, segments, length_m, attributes): runs of segments through nodes of degree two, joined where all attributes are equal.

    chain_id is the chain's least segment_id. Two segments share a chain if they meet alone at a node and don't differ; chains are the connected parts
    of those links, so a long street takes a logarithmic number of rounds.
    """
    same = F.xxhash64(*(F.coalesce(F.col(a).cast("string"), F.lit("\0")) for a in attributes))
    ends = segments.select("segment_id", same.alias("_h"), F.explode(F.array("src", "dst")).alias("node"))
    at = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("segment_id").alias("u"), F.max("segment_id").alias("v"), F.min("_h").alias("a"), F.max("_h").alias("b"))
    links = at.filter("n = 2 and u != v and a = b").select("u", "v")
    roots = connected_parts(links, "u", "v").select(F.col("node").alias("segment_id"), "root")
    rows = segments.join(roots, "segment_id", "left").withColumn("chain_id", F.coalesce("root", "segment_id"))
    return rows.groupBy("chain_id").agg(F.count("*").alias("segments"), F.sum("length_m").alias("length_m"), *(F.first(a).alias(a) for a in attributes))


def relocated(choices: DataFrame, parts: DataFrame) -> DataFrame:
    """(request, origin, destination, part): a snap of both ends in one part, at least one of them the nearest of its end.

    choices: (request, side 'origin' or 'destination', node, d, far): snaps of a request's end, d from it and far from the other end;
    parts: (node, part), 0 the largest. A snap that is at least as near the other end as its own is no choice unless it is its end's
    nearest. The least sum of distances over the nearest snaps' is tried last: the larger part wins first.
    """
    w = W.partitionBy("request", "side").orderBy("d", "node")
    ranked = choices.withColumn("_i", F.row_number().over(w)).filter((F.col("_i") == 1) | (F.col("far") > F.col("d"))).join(parts.select("node", "part"), "node")
    best = ranked.groupBy("request", "side", "part").agg(F.min(F.struct("d", "node", "_i")).alias("s"))
    a = best.filter("side = 'origin'").select("request", "part", F.col("s").alias("a"))
    b = best.filter("side = 'destination'").select("request", "part", F.col("s").alias("b"))
    both = a.join(b, ["request", "part"]).filter("a._i = 1 or b._i = 1")
    order = F.struct(F.when((F.col("a._i") == 1) & (F.col("b._i") == 1), 0).otherwise(1).alias("moved"), "part", (F.col("a.d") + F.col("b.d")).alias("sum"))
    won = both.groupBy("request").agg(F.min_by(F.struct(F.col("a.node").alias("origin"), F.col("b.node").alias("destination"), "part"), order).alias("m"))
    return won.select("request", "m.*")


def named_stretches(pieces: DataFrame, near: float) -> DataFrame:
    """(piece_id, stretch): pieces of one name that share a node or have points within near of each other; pieces: (piece_id, name, x, y, nodes)."""
    shared = pieces.select("piece_id", "name", F.explode("nodes").alias("node"))
    first = shared.groupBy("name", "node").agg(F.min("piece_id").alias("u"))
    by_node = shared.join(first.hint("merge"), ["name", "node"]).filter("piece_id != u").select("u", F.col("piece_id").alias("v"))
    # The first piece of each cell stands for the cell, so crowded cells give no pairs among themselves; a cell's diagonal is near.
    size = near / 2 ** 0.5
    cells = pieces.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)}).select("piece_id", "name", "x", "y", "cx", "cy")
    head = cells.groupBy("name", "cx", "cy").agg(F.min("piece_id").alias("u"))
    inside = cells.join(head.hint("merge"), ["name", "cx", "cy"]).filter("piece_id != u").select("u", F.col("piece_id").alias("v"))
    steps = F.explode(F.array(*(F.struct((F.col("cx") + i).alias("cx"), (F.col("cy") + j).alias("cy")) for i in (-2, -1, 0, 1, 2) for j in (-2, -1, 0, 1, 2) if i or j)))
    a = cells.select("piece_id", "name", "x", "y", steps.alias("c")).select(F.col("piece_id").alias("u"), "name", F.col("x").alias("ux"), F.col("y").alias("uy"), "c.cx", "c.cy")
    across = a.join(cells.hint("merge"), ["name", "cx", "cy"]).filter((F.hypot(F.col("x") - F.col("ux"), F.col("y") - F.col("uy")) <= near) & (F.col("u") < F.col("piece_id"))).select("u", F.col("piece_id").alias("v"))
    roots = connected_parts(by_node.union(inside).union(across), "u", "v").select(F.col("node").alias("piece_id"), "root")
    return pieces.select("piece_id").join(roots.hint("merge"), "piece_id", "left").select("piece_id", F.coalesce("root", "piece_id").alias("stretch"))
