"""Straight segments clipped by the edges of one cell, many at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PAIRS = 1 << 19
"""Pairs of a segment or a piece and an edge that are met at once inside a task."""


def _turns(px: np.ndarray, py: np.ndarray, x0: float, y0: float, ax: np.ndarray, ay: np.ndarray, bx: np.ndarray, by: np.ndarray) -> np.ndarray:
    """How often the way from a cell's corner (x0, y0) up to py and then to px crosses an edge; see operators.areas."""
    dx, dy = bx - ax, by - ay
    side = dx * (py - ay) - dy * (x0 - ax)
    up = (ax <= x0) != (bx <= x0)
    over = (ay > py) != (by > py)
    below = side * np.sign(dx) >= 0
    right = np.where(side == 0, dx, side) * np.sign(dy) > 0
    return (up & (ay + (x0 - ax) * dy / dx > y0) & below).astype(np.int64) + (over & right & (ax + (py - ay) * dx / dy <= px))


def _blocks(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes sum up to PAIRS at most, or of one row."""
    ends, start = np.cumsum(sizes), 0
    while start < len(sizes):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + PAIRS, side="right")))
        yield start, stop
        start = stop


def _pieces(lines: tuple[np.ndarray, ...], inside: np.ndarray, counts: np.ndarray, edges: tuple[np.ndarray, ...], x0: float, y0: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(line, area, t0, t1) of what lies inside areas that have edges in the cell; edges in the order of the areas, counts of each."""
    ax, ay, dx, dy, t0, t1 = lines
    eax, eay, ebx, eby = edges
    ex, ey, many = ebx - eax, eby - eay, len(counts)
    of, first = np.repeat(np.arange(many), counts), np.cumsum(counts) - counts
    step = max(1, PAIRS // len(of))
    for low in range(0, len(ax), step):
        x, y, lx, ly, a0, a1 = (v[low:low + step, None] for v in (ax, ay, dx, dy, t0, t1))
        cross = lx * ey - ly * ex
        t, u = ((eax - x) * ey - (eay - y) * ex) / cross, ((eax - x) * ly - (eay - y) * lx) / cross
        cut = (cross != 0) & (u >= 0) & (u <= 1) & (t > a0) & (t < a1)
        line, edge = np.nonzero(cut)
        pair = line * many + of[edge]
        was_cut = np.unique(pair)
        whole = np.setdiff1d(np.arange(len(x) * many), was_cut, assume_unique=True)
        pairs, stops = np.concatenate([was_cut, was_cut, pair]), np.concatenate([a0[was_cut // many, 0], a1[was_cut // many, 0], t[cut]])
        order = np.lexsort((stops, pairs))
        pairs, stops = pairs[order], stops[order]
        next_ = np.flatnonzero((pairs[1:] == pairs[:-1]) & (stops[1:] > stops[:-1]))
        pairs = np.concatenate([whole, pairs[next_]])
        begin, end = np.concatenate([a0[whole // many, 0], stops[next_]]), np.concatenate([a1[whole // many, 0], stops[next_ + 1]])
        at, area = low + pairs // many, pairs % many
        px, py = ax[at] + (begin + end) / 2 * dx[at], ay[at] + (begin + end) / 2 * dy[at]
        for i, j in _blocks(counts[area]):
            n = counts[area[i:j]]
            starts = np.cumsum(n) - n
            e = np.repeat(first[area[i:j]] - starts, n) + np.arange(n.sum())
            turns = np.add.reduceat(_turns(np.repeat(px[i:j], n), np.repeat(py[i:j], n), x0, y0, eax[e], eay[e], ebx[e], eby[e]), starts)
            held = i + np.flatnonzero((inside[area[i:j]] + turns) % 2 == 1)
            yield at[held], area[held], begin[held], end[held]


def clip_cell(lines: pa.StructArray, areas: pa.StructArray, x0: float, y0: float, keys: list[str]) -> Iterator[pa.RecordBatch]:
    """(keys, area_id, t0, t1): the parts of lines (keys, ax, ay, bx, by, t0, t1) inside areas (area_id, inside, edges) of a cell with the lower left corner (x0, y0)."""
    of = {f.name: v for f, v in zip(lines.type, lines.flatten(), strict=True)}
    ids, inside, edges = areas.flatten()
    inside, plain = inside.to_numpy(zero_copy_only=False).astype(np.int64), edges.is_null().to_numpy(zero_copy_only=False)
    ax, ay, bx, by, t0, t1 = (of[c].to_numpy() for c in ("ax", "ay", "bx", "by", "t0", "t1"))

    def told(line: np.ndarray, area: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
        at = pa.array(line)
        return pa.RecordBatch.from_arrays([*(of[k].take(at) for k in keys), ids.take(pa.array(area)), pa.array(begin), pa.array(end)], [*keys, "area_id", "t0", "t1"])

    inner, border = np.flatnonzero(plain & (inside == 1)), np.flatnonzero(~plain)
    step = max(1, PAIRS // max(1, len(inner)))
    for low in range(0, len(ax) if len(inner) else 0, step):
        line = np.repeat(np.arange(low, min(low + step, len(ax))), len(inner))
        yield told(line, np.tile(inner, len(line) // len(inner)), t0[line], t1[line])
    if len(border):
        flat = tuple(v.to_numpy() for v in edges.flatten().flatten())
        counts = pc.list_value_length(edges).to_numpy(zero_copy_only=False)[border].astype(np.int64)
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            for line, area, begin, end in _pieces((ax, ay, bx - ax, by - ay, t0, t1), inside[border], counts, flat, x0, y0):
                yield told(line, border[area], begin, end)
