"""Shortest paths of many requests inside one piece of a graph, relaxed together."""

from __future__ import annotations

import numpy as np

NOTHING = -1
"""The parent of a label that is none; others below are starts, see settle."""


def spans(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Runs of indices, so many from each first one, after another."""
    ends = np.cumsum(count)
    return np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)


def least(slot: np.ndarray, cost: np.ndarray, hops: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The rows with the least (cost, hops, last) of each slot."""
    order = np.lexsort((last, hops, cost, slot))
    at = slot[order]
    return order[np.concatenate([[True], at[1:] != at[:-1]])] if len(order) else order


def remaining(x: np.ndarray, y: np.ndarray, gx: np.ndarray, gy: np.ndarray) -> np.ndarray:
    """Straight lines to the goals; 0 where a place isn't known."""
    return np.nan_to_num(np.hypot(x - gx, y - gy), nan=0.0)


class Labels:
    """Labels (cost, hops, last) of requests x nodes, slot = request * nodes + node, and their parents' nodes.

    settle relaxes nodes whose cost plus the straight line left is near the least of their request, all requests at once, until labels don't get
    less: what Dijkstra's algorithm settles, ties included. Limits fall as goals are reached.
    """

    def __init__(self, requests: int, nodes: int, limit: np.ndarray, gx: np.ndarray, gy: np.ndarray, x: np.ndarray, y: np.ndarray):
        self.nodes, self.limit, self.gx, self.gy, self.x, self.y = nodes, limit, gx, gy, x, y
        self.cost = np.full(requests * nodes, np.inf)
        self.hops, self.last, self.parent = (np.full(requests * nodes, v, np.int32) for v in (0, 0, NOTHING))

    def _take(self, slot: np.ndarray, cost: np.ndarray, hops: np.ndarray, last: np.ndarray, parent: np.ndarray) -> None:
        self.cost[slot], self.hops[slot], self.last[slot], self.parent[slot] = cost, hops, last, parent

    def settle(self, starts: tuple[np.ndarray, ...], edges: tuple[np.ndarray, ...], goals: tuple[np.ndarray, ...], width: float) -> None:
        """starts: (slot, cost, hops, last, left), the parent of the i-th is -2 - i; edges: (first of each node and the end, dst, weight, last) by
        source; goals: (slot, rest); width: how far above the least a node is relaxed."""
        n, limit = self.nodes, self.limit
        ptr, dst, weight, via = edges
        goal_slot, rest = goals
        slot, cost, hops, last, left = starts
        first = least(slot, cost, hops, last)
        self._take(slot[first], cost[first], hops[first], last[first], -2 - first)
        open_slot, open_cost, open_f = slot[first], cost[first], cost[first] + left[first]
        while len(open_slot):
            np.minimum.at(limit, goal_slot // n, self.cost[goal_slot] + rest)
            request = open_slot // n
            live = (open_cost == self.cost[open_slot]) & (open_f <= limit[request])
            open_slot, open_cost, open_f, request = open_slot[live], open_cost[live], open_f[live], request[live]
            low = np.full(len(limit), np.inf)
            np.minimum.at(low, request, open_f)
            now = open_f <= low[request] + width
            at = open_slot[now]
            open_slot, open_cost, open_f = open_slot[~now], open_cost[~now], open_f[~now]
            node = at % n
            degree = ptr[node + 1] - ptr[node]
            e = spans(ptr[node], degree)
            new, to = np.repeat(self.cost[at], degree) + weight[e], np.repeat(at - node, degree) + dst[e]
            step, had = np.repeat(self.hops[at] + 1, degree), self.cost[to]
            better = np.flatnonzero((new < had) | ((new == had) & ((step < self.hops[to]) | ((step == self.hops[to]) & (via[e] < self.last[to])))))
            new, to, step, e, parent = new[better], to[better], step[better], e[better], np.repeat(node, degree)[better]
            request = to // n
            f = new + remaining(self.x[dst[e]], self.y[dst[e]], self.gx[request], self.gy[request])
            kept = np.flatnonzero(f <= limit[request])
            kept = kept[least(to[kept], new[kept], step[kept], via[e[kept]])]
            self._take(to[kept], new[kept], step[kept], via[e[kept]], parent[kept])
            open_slot, open_cost, open_f = np.concatenate([open_slot, to[kept]]), np.concatenate([open_cost, new[kept]]), np.concatenate([open_f, f[kept]])
        np.minimum.at(limit, goal_slot // n, self.cost[goal_slot] + rest)

    def ways(self, ends: np.ndarray) -> np.ndarray:
        """The slots on the ways to these, themselves included."""
        on = np.zeros(len(self.cost), bool)
        while len(ends):
            ends = np.unique(ends[~on[ends]])
            on[ends] = True
            ends = ends[self.parent[ends] >= 0]
            ends = ends - ends % self.nodes + self.parent[ends]
        return np.flatnonzero(on)
