"""Positions along whole lines, which are arrays of struct<x, y>: projection, points at fractions, and cuts."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

END = 1e-9
"""A fraction this close to an end is the end."""
PAIRS = 1 << 18
"""Pairs of vertices that are met at once inside a task."""


def _steps(line: Column) -> Column:
    """The line's vertex pairs: struct(a, b)."""
    n = F.greatest(F.size(line) - 1, F.lit(0))
    return F.zip_with(F.slice(line, F.lit(1), n), F.slice(line, F.lit(2), n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _length(p: Column) -> Column:
    return F.hypot(p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"])


def line_length(line: Column) -> Column:
    """The line's length; 0 below two vertices, null for null."""
    return F.aggregate(_steps(line), F.lit(0.0), lambda s, p: s + _length(p))


def vertex_positions(line: Column) -> Column:
    """The distance of each vertex from the line's start."""
    start = F.array(F.lit(0.0))
    return F.aggregate(_steps(line), start, lambda s, p: F.concat(s, F.array(F.element_at(s, -1) + _length(p))))


def with_positions(line: Column, then: Callable[[Column, Column], Column]) -> Column:
    """then(line, its vertex positions), each computed once for a row."""
    both = F.array(F.struct(line.alias("line"), vertex_positions(line).alias("at")))
    return F.element_at(F.transform(both, lambda s: then(s["line"], s["at"])), 1)


def project_on_line(px: Column, py: Column, line: Column) -> Column:
    """struct(near, fraction, d, x, y): the line's nearest point to a point, its distance and its share of the way.

    near is the distance to nine digits: of places equally near by that the first along the line counts. Null if the line is null or has no vertex; a line without length is at 0.
    """

    def found(own: Column, at: Column) -> Column:
        total = F.element_at(at, -1)

        def nearest(p: Column, before: Column) -> Column:
            dx, dy = p["b"]["x"] - p["a"]["x"], p["b"]["y"] - p["a"]["y"]
            along = F.try_divide((px - p["a"]["x"]) * dx + (py - p["a"]["y"]) * dy, dx * dx + dy * dy)
            t = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), along)), F.lit(0.0))
            x, y = p["a"]["x"] + t * dx, p["a"]["y"] + t * dy
            share = F.when(total > 0, F.least(F.lit(1.0), F.try_divide(before + t * _length(p), total))).otherwise(0.0)
            return F.struct(F.round(F.hypot(px - x, py - y), 9).alias("near"), share.alias("fraction"), F.hypot(px - x, py - y).alias("d"), x.alias("x"), y.alias("y"))

        first = F.get(own, 0)
        alone = F.hypot(px - first["x"], py - first["y"])
        lone = F.struct(F.round(alone, 9).alias("near"), F.lit(0.0).alias("fraction"), alone.alias("d"), first["x"].alias("x"), first["y"].alias("y"))
        return F.coalesce(F.array_min(F.zip_with(_steps(own), F.slice(at, F.lit(1), F.greatest(F.size(own) - 1, F.lit(0))), nearest)), F.when(F.size(own) > 0, lone))

    return F.when(F.size(line) > 0, with_positions(line, found))


def _at(line: Column, at: Column, distance: Column) -> Column:
    """struct(x, y) of the place at a distance from the start."""
    last = F.size(line) - 1
    after = F.greatest(F.lit(1), F.least(last, F.size(F.filter(at, lambda d: d <= distance))))  # place of the next vertex, from 0
    a, b = F.get(line, after - 1), F.coalesce(F.get(line, after), F.get(line, after - 1))
    from_, to = F.get(at, after - 1), F.coalesce(F.get(at, after), F.get(at, after - 1))
    t = F.coalesce(F.try_divide(distance - from_, to - from_), F.lit(0.0))
    return F.struct((a["x"] + t * (b["x"] - a["x"])).alias("x"), (a["y"] + t * (b["y"] - a["y"])).alias("y"))


def point_on_line(line: Column, fraction: Column) -> Column:
    """struct(x, y) at a fraction of the line's length."""
    return F.when(F.size(line) > 0, with_positions(line, lambda own, at: _at(own, at, fraction * F.element_at(at, -1))))


def cut_line(line: Column, start: Column, end: Column) -> Column:
    """The piece of the line between two fractions, start <= end, with every vertex between them.

    It has two vertices at least, which coincide if the fractions do: a piece without length.
    """

    def piece(own: Column, at: Column) -> Column:
        total = F.element_at(at, -1)
        a, b = start * total, end * total
        inner = F.filter(F.zip_with(own, at, lambda p, d: F.struct(p.alias("p"), d.alias("d"))), lambda v: (v["d"] > a + END * total) & (v["d"] < b - END * total))
        return F.concat(F.array(_at(own, at, a)), F.transform(inner, lambda v: F.struct(v["p"]["x"].alias("x"), v["p"]["y"].alias("y"))), F.array(_at(own, at, b)))

    return F.when(F.size(line) > 0, with_positions(line, piece))


def cut_at(line: Column, fractions: Column) -> Column:
    """array<struct(start, end, line)>: the line cut at ascending fractions, one piece more than there are; equal ones give a piece without length."""
    stops = F.concat(F.array(F.lit(0.0)), F.array_sort(fractions), F.array(F.lit(1.0)))
    pairs = F.zip_with(F.slice(stops, F.lit(1), F.size(stops) - 1), F.slice(stops, F.lit(2), F.size(stops) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return F.transform(pairs, lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), cut_line(line, p["start"], p["end"]).alias("line")))


def _vertices(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vertices of each line (0 for null), and of all of them in a row x, y and whether both are given."""
    flat = lines.flatten()
    x, y = (pc.cast(pc.struct_field(flat, c), pa.float64()) for c in "xy")
    given = np.asarray(pc.and_(x.is_valid(), y.is_valid()))
    return np.asarray(pc.fill_null(pc.list_value_length(lines), 0)).astype(np.int64), *(np.asarray(pc.fill_null(c, math.nan)) for c in (x, y)), given


def _group_medians(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    """The median of each group's values: the middle one in order, or the mean of the two; nan without a value."""
    n = np.bincount(group, minlength=groups)
    some, ordered = n > 0, values[np.lexsort((values, group))]
    first, n = (np.cumsum(n) - n)[some], n[some]
    out = np.full(groups, math.nan)
    out[some] = (ordered[first + (n - 1) // 2] + ordered[first + n // 2]) / 2
    return out


def _agreements(lines: pa.Array, records: pa.Array, stretch: float, pair: float) -> pa.Array:
    """vertex_agreement of a batch: each vertex of a line meets each vertex of its record and the step from there, PAIRS at a time."""
    rows = len(lines)
    sizes, x, y, given = _vertices(lines)
    others, rx, ry, sound = _vertices(records)
    end = np.cumsum(others)
    broken = np.bincount(np.repeat(np.arange(rows), others), ~sound, rows) > 0
    row = np.repeat(np.arange(rows), sizes)
    met = given & (others[row] > 0) & ~broken[row]
    x, y, row = x[met], y[met], row[met]
    n = others[row]
    until = np.cumsum(n)
    cuts = [0, *(np.flatnonzero(np.diff(until // PAIRS)) + 1).tolist(), len(row)]
    far, apart, nearest = np.full(len(row), math.inf), np.full(len(row), math.inf), np.zeros(len(row), np.int64)
    with np.errstate(all="ignore"):
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            first = until[a:b] - n[a:b] - (until[a] - n[a])
            own = np.repeat(np.arange(a, b), n[a:b])
            at = np.arange(len(own)) + np.repeat(end[row[a:b]] - n[a:b] - first, n[a:b])
            last = at == end[row[own]] - 1
            to = np.where(last, at, at + 1)
            px, py, dx, dy = x[own] - rx[at], y[own] - ry[at], rx[to] - rx[at], ry[to] - ry[at]
            length = dx * dx + dy * dy
            t = np.where(length == 0, 0.0, np.clip((px * dx + py * dy) / length, 0.0, 1.0))
            d = np.sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2)
            d[last & (n[own] > 1)] = math.inf  # no step begins at the last vertex
            far[a:b] = np.fmin.reduceat(d, first)
            d = np.sqrt(px * px + py * py)
            apart[a:b] = np.fmin.reduceat(d, first)
            best = np.flatnonzero(d == apart[own])
            whose, place = np.unique(own[best], return_index=True)
            nearest[whose] = at[best[place]]
        near = far <= stretch
        told = near & (apart <= pair)
        group, dx, dy = row[told], rx[nearest[told]] - x[told], ry[nearest[told]] - y[told]
        middle_x, middle_y = _group_medians(group, dx, rows), _group_medians(group, dy, rows)
        median = _group_medians(group, apart[told], rows)
        spread = _group_medians(group, np.sqrt((dx - middle_x[group]) ** 2 + (dy - middle_y[group]) ** 2), rows)
    paired = np.bincount(group, minlength=rows)
    counts = [pa.array(c, pa.int32()) for c in (np.bincount(row[near], minlength=rows), paired)]
    return pa.StructArray.from_arrays([*counts, *(pa.array(m, mask=paired == 0) for m in (median, spread))], names=["near", "paired", "median_m", "spread_m"], mask=pc.or_(lines.is_null(), records.is_null()))


def vertex_agreement(line: Column, record: Column, stretch: float = 3.0, pair: float = 2.0) -> Column:
    """struct(near, paired, median_m, spread_m): how far the vertices of a line are those of a record's line.

    near: the line's vertices within stretch of the record; each is paired with the record's nearest vertex (ties: the first), if that is
    within pair. median_m is the median displacement of pairs; spread_m the median distance of displacements from the median displacement,
    by which a shift of the whole line doesn't hide shared vertices. Both are null without a pair, all of it for null lines. A vertex without
    a coordinate isn't near, and nothing is near a record with such a vertex.
    """

    @F.arrow_udf("near int, paired int, median_m double, spread_m double")
    def told(lines: pa.Array, records: pa.Array) -> pa.Array:
        return _agreements(lines, records, stretch, pair)

    return told(line, record)
