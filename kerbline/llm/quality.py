"""Quality scores by a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import mapped, slabs, tidy, word_hashes

MAX_TRAIN = 20_000
"""Labelled rows that a model is fitted on, at most: those of the least hash."""
BINS, ROUNDS, RATE, PAIRS, PAIR_BINS, PAIR_ROUNDS = 32, 200, 0.1, 6, 8, 60
LEAF_ROWS, SHRINK = 5, 2.0
FEATURES = ("log_words", "word_length", "letters", "digits", "upper", "symbols", "commas_stops", "spaces", "lines", "line_end_stops", "distinct_words", "distinct_pairs", "distinct_triples", "repeats", "upper_words", "symbol_ends", "wordless", "top_word")

_CLASS = np.zeros((256, 6), np.uint8)
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = (_b >= 128 or _c.isalpha(), 48 <= _b < 58, 65 <= _b < 91, _b < 128 and not _c.isalnum() and _b not in b" \t\r\n.,", _b in b".,", _b in b" \t\r\n")


def text_features(texts: list[str | None]) -> np.ndarray:
    """A row of FEATURES for each whole text; all zero for an empty one."""
    raw = [(t or "").encode() for t in texts]
    sizes = np.array([len(t) for t in raw])
    blob = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    chars = np.maximum(sizes, 1)
    share = [np.add.reduceat(_CLASS[:, k][blob], starts, dtype=np.int64) / chars for k in range(6)]
    share[5] -= 1 / chars  # the joining newline
    newline = blob == 10
    lines = np.add.reduceat(newline, starts, dtype=np.int64)
    ends = np.flatnonzero(newline)
    stopped = np.zeros(len(blob), bool)
    stopped[ends] = np.isin(blob[np.maximum(ends - 1, 0)], np.frombuffer(b".!?:;|", np.uint8))
    hashes, offsets = word_hashes(raw)
    space = _CLASS[blob, 5].astype(bool)
    turns = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(space) and not space[0]:
        turns = np.concatenate(([0], turns))
    first, last = turns.reshape(-1, 2).T
    letter = np.concatenate(([0], np.cumsum(_CLASS[blob, 0], dtype=np.int64)))
    upper = np.concatenate(([0], np.cumsum(_CLASS[blob, 2], dtype=np.int64)))
    has = letter[last] - letter[first]
    words = np.searchsorted(first, starts[1:])
    words = np.concatenate(([0], words, [len(first)]))
    n = np.diff(words)
    many = np.maximum(n, 1)

    def per_word(flags: np.ndarray) -> np.ndarray:
        run = np.concatenate(([0], np.cumsum(flags)))
        return (run[words[1:]] - run[words[:-1]]) / many

    out = np.zeros((len(texts), len(FEATURES)))
    out[:, 0], out[:, 1] = np.log1p(n), per_word(last - first)
    out[:, 2:8] = np.stack(share, 1)
    out[:, 8] = lines / many
    out[:, 9] = np.add.reduceat(stopped, starts, dtype=np.int64) / np.maximum(lines, 1)
    out[:, 14] = per_word((upper[last] - upper[first] == has) & (has > 1))
    out[:, 15] = per_word(_CLASS[blob[np.maximum(last - 1, 0)], 3].astype(bool))
    out[:, 16] = per_word(has == 0)
    for i in range(len(texts)):
        h = hashes[offsets[i] : offsets[i + 1]]
        m = len(h)
        if m > 1:
            _, counts = np.unique(h, return_counts=True)
            pairs = h[1:] * np.uint64(0x9E3779B97F4A7C15) + h[:-1]
            out[i, 10], out[i, 17] = len(counts) / m**0.8, counts.max() / m
            out[i, 11] = len(np.unique(pairs)) / len(pairs)
            out[i, 12] = len(np.unique(pairs[1:] * np.uint64(0xC2B2AE3D27D4EB4F) + h[:-2])) / (m - 2) if m > 2 else 1.0
            out[i, 13] = (h[1:] == h[:-1]).mean()
    out[sizes == 0] = 0
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Gam:
    """intercept + a lookup table for each feature + one for each chosen pair of features, on the log-odds scale."""

    edges: list[np.ndarray]
    intercept: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1: bins are looked up and table entries added, a column at a time."""
        z = np.full(len(x), self.intercept)
        for j, table in enumerate(self.tables):
            z += table[np.searchsorted(self.edges[j], x[:, j], side="right")]
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return _sigmoid(z)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int = 2) -> np.ndarray:
    """The update of each bin by a tree of that depth over ordered bins: split where the gain is highest."""
    def leaf(a: int, b: int) -> float:
        return g[a:b].sum() / (h[a:b].sum() + SHRINK)

    def grow(a: int, b: int, d: int) -> None:
        gs, hs, ns = g[a:b].cumsum(), h[a:b].cumsum(), n[a:b].cumsum()
        if d and b - a > 1:
            left, right = gs[:-1] ** 2 / (hs[:-1] + SHRINK), (gs[-1] - gs[:-1]) ** 2 / (hs[-1] - hs[:-1] + SHRINK)
            gain = np.where((ns[:-1] >= LEAF_ROWS) & (ns[-1] - ns[:-1] >= LEAF_ROWS), left + right - gs[-1] ** 2 / (hs[-1] + SHRINK), -1.0)
            best = int(gain.argmax())
            if gain[best] > 1e-6:
                grow(a, a + best + 1, d - 1)
                grow(a + best + 1, b, d - 1)
                return
        out[a:b] = leaf(a, b)

    out = np.zeros(len(g))
    grow(0, len(g), depth)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and update of the best cut of a grid into four quadrants."""
    G, H = (np.pad(m, ((1, 0), (1, 0))).cumsum(0).cumsum(1) for m in (g, h))
    best, out = 0.0, np.zeros_like(g)
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [(S[i, j], S[i, -1] - S[i, j], S[-1, j] - S[i, j], S[-1, -1] - S[i, -1] - S[-1, j] + S[i, j]) for S in (G, H)]
            gain = sum(a * a / (b + SHRINK) for a, b in zip(*parts, strict=True))
            if gain > best:
                v = [a / (b + SHRINK) for a, b in zip(*parts, strict=True)]
                best, out = gain, np.empty_like(g)
                out[:i, :j], out[:i, j:], out[i:, :j], out[i:, j:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting: each round gives every feature in turn a small step by a shallow tree over its bins; then the pairs
    that would gain most from the residuals are boosted in the same way on coarse grids. Without both labels the model is the base rate."""
    model = Gam([_edges(x[:, j], BINS) for j in range(x.shape[1])])
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model.intercept = float(np.log(rate / (1 - rate)))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    model.pair_edges = [_edges(x[:, j], PAIR_BINS) for j in range(x.shape[1])]
    if not len(y) or y.min() == y.max():
        return model
    bins = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    counts = [np.bincount(b, minlength=len(t)) for b, t in zip(bins, model.tables, strict=True)]
    z = np.full(len(y), model.intercept)
    for _ in range(ROUNDS):
        for j, table in enumerate(model.tables):
            p = _sigmoid(z)
            step = RATE * _shallow_tree(np.bincount(bins[j], y - p, len(table)), np.bincount(bins[j], p * (1 - p), len(table)), counts[j])
            table += step
            z += step[bins[j]]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, cell = _sigmoid(z), coarse[a] * sizes[b] + coarse[b]
        return cell, *(np.bincount(cell, w, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b]) for w in (y - p, p * (1 - p)))

    gains = {(a, b): _quadrants(*grids(a, b)[1:])[0] for a in range(len(sizes)) for b in range(a)}
    model.pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            cell, g, h = grids(a, b)
            step = RATE * _quadrants(g, h)[1]
            table += step
            z += step.ravel()[cell]
    return model


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_rows: int = MAX_TRAIN, held_out: bool = True) -> DataFrame:
    """(doc_id, text, y) of at most max_rows labelled documents, those of the least hash, without held-out ones.

    Ids are chosen from labels alone, so the broadcast has max_rows ids at most. A repeated label counts once, with its largest value; of
    repeated documents the text of the least hash does, so there is one row an id.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if held_out:
        known = known.filter(~is_held_out(F.col("doc_id")))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    known_texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    one = known_texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min(F.struct(F.xxhash64("text").alias("turn"), "text")).alias("d"))
    return one.select("doc_id", "d.text", "y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", max_rows: int = MAX_TRAIN) -> Gam:
    """A model of label, from the features of at most max_rows documents (a few MB) that the driver gathers.

    The sample is bounded by max_rows labels (see training_rows). Without labelled documents, as in empty tables, the model is a base rate of 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            x = text_features(slab.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([slab.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    rows = training_rows(docs, labels, label, max_rows).mapInArrow(tidy(run), "y int, x array<double>").toArrow()
    x = np.array(rows.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    y = np.array(rows.column("y").to_pylist(), float)
    order = np.lexsort((*x.T, y))  # the fit doesn't depend on the order of rows
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Gam, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= threshold) in place of the text.

    The model is some 10 kB, whatever the corpus. A null text scores like an empty one. Very long texts are scored whole. Each row is
    scored by itself: repeated rows get equal scores, an empty table gives none. Columns of docs with these names are
    replaced, others stay. One map over the rows.
    """

    def compute(slab: pa.RecordBatch) -> list[pa.Array]:
        s = model.score(text_features(slab.column(text_col).to_pylist()))
        return [pa.array(s), pa.array((s >= threshold).astype(np.int32))]

    return mapped(docs, text_col, "score double, predicted int", compute, drop=(text_col,))
