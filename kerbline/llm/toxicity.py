"""Toxicity severity by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import mapped, plain_words, scratch, slabs, stored, tidy, word_hashes
from .quality import training_rows

MAX_TRAIN = 20_000
"""Labelled rows that a model is fitted on, at most."""
PREFIXES = (4, 5)
"""Besides whole words, word beginnings of these many bytes are features."""
MAX_FEATURES = 4096
MIN_CHI2, MIN_LIFT = 20.0, 3.0
"""A feature is kept if its presence and the label depend on each other at least this much and it is that much commoner in toxic texts."""
GRADES = 4
"""Severity 0 (not toxic) to 3. Labels only tell toxic texts from others, so toxic training texts are graded by the terciles of their margin
under binary models that were fitted without them."""
FOLDS = 3
STEPS, STEP, RIDGE = 400, 0.1, 1e-4
LEAST_CUT = 0.02
"""A document is toxic if its score reaches the cut that is best on the training texts (by F1), but never below this."""


def _present(texts: list[str | None], keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of all features in whole texts, or of those in the sorted keys (then their places there), once each."""
    words, offsets, *parts = word_hashes([plain_words(t) for t in texts], PREFIXES)
    text = np.tile(np.repeat(np.arange(len(texts)), np.diff(offsets)), 1 + len(PREFIXES))
    feature = np.concatenate((words, *parts))
    if keys is not None:
        at = np.searchsorted(keys, feature)
        at[at == len(keys)] = 0
        hit = keys[at] == feature if len(keys) else np.zeros(len(feature), bool)
        feature, text = at[hit].astype(np.uint64), text[hit]
    order = np.lexsort((feature, text))
    text, feature = text[order], feature[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])
    return text[new], feature[new]


@dataclass
class Ordinal:
    """P(grade > k) = sigmoid(w . x - threshold_k): one weight vector for all thresholds, which increase with k."""

    keys: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    cut: float = 0.5

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) of each text, for each threshold."""
        text, feature = _present(texts, self.keys)
        z = np.bincount(text, self.weights[feature.astype(np.int64)], len(texts))
        return _sigmoid(z[:, None] - self.thresholds[None, :])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(row: np.ndarray, feature: np.ndarray, grade: np.ndarray, n_features: int, k: int = GRADES - 1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that minimise the cumulative-link loss with a ridge, by accelerated gradient steps.

    row, feature: where the binary features are; k: number of thresholds. Weights don't go below 0, as all features speak for toxicity; increments
    between thresholds don't go below 0.1.
    """
    over = (grade[:, None] > np.arange(k)[None, :]).astype(float)
    rate = np.clip(over.mean(0), 1e-3, 1 - 1e-3) if len(grade) else np.full(k, 1e-3)
    w, t = np.zeros(n_features), -np.log(rate / (1 - rate))
    t = np.maximum.accumulate(t + 0.1 * np.arange(k))
    mw, vw, mt, vt = np.zeros(n_features), np.zeros(n_features), np.zeros(k), np.zeros(k)
    for i in range(1, STEPS + 1 if len(grade) and over.any() else 1):
        z = np.bincount(row, w[feature], len(grade))
        miss = _sigmoid(z[:, None] - t[None, :]) - over
        gw = np.bincount(feature, miss.sum(1)[row], n_features) / len(grade) + RIDGE * w / k
        gt = -miss.mean(0)
        mw, mt = 0.9 * mw + 0.1 * gw, 0.9 * mt + 0.1 * gt
        vw, vt = 0.99 * vw + 0.01 * gw**2, 0.99 * vt + 0.01 * gt**2
        fix = np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
        w = np.maximum(0, w - STEP * fix * mw / (np.sqrt(vw) + 1e-8))
        t = t - STEP * fix * mt / (np.sqrt(vt) + 1e-8)
        t = np.concatenate((t[:1], np.maximum(t[1:], t[:-1] + 0.1)))
    return w, t


def cross_fitted_grades(row: np.ndarray, feature: np.ndarray, toxic: np.ndarray, fold: np.ndarray, n_features: int) -> np.ndarray:
    """0 for texts that aren't toxic; toxic ones get 1 to GRADES - 1 by the quantiles of their margin under a model of the other folds."""
    margin = np.zeros(len(toxic))
    for f in range(FOLDS):
        use = fold != f
        inside = use[row]
        w, t = fit((np.cumsum(use) - 1)[row[inside]], feature[inside], toxic[use].astype(int), n_features, 1)
        margin[~use] = (np.bincount(row, w[feature], len(toxic)) - t[0])[~use]
    cuts = np.quantile(margin[toxic], np.arange(1, GRADES - 1) / (GRADES - 1)) if toxic.any() else np.zeros(GRADES - 2)
    return np.where(toxic, 1 + np.searchsorted(cuts, margin, side="right"), 0)


def best_cut(score: np.ndarray, toxic: np.ndarray) -> float:
    """The score at which F1 is highest, in the middle (on the log-odds scale) of the gap to the next lower score."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(toxic[order])
    last = np.append(s[1:] != s[:-1], True)[: len(s)]
    f1 = np.where(last, 2 * hits / (np.arange(1, len(s) + 1) + max(1, toxic.sum())), -1.0)
    if not len(s) or not toxic.any():
        return 0.5
    at = int(f1.argmax())
    below = s[at + 1] if at + 1 < len(s) else 1e-6
    z = [np.log(p / (1 - p)) for p in np.clip((s[at], below), 1e-6, 1 - 1e-6)]
    return float(np.clip(_sigmoid(np.array(sum(z) / 2)), LEAST_CUT, 0.5))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", max_rows: int = MAX_TRAIN, held_out: bool = False) -> Ordinal:
    """Chooses features and fits a model on at most max_rows labelled documents, with held_out without those that quality.is_held_out keeps back.

    Texts with each feature are counted by label in the cluster; at most MAX_FEATURES features and, for the fit, their places in
    max_rows texts reach the driver. Without toxic labels, as in empty tables, there are no features and nothing is rejected. Of repeated
    documents one text counts (see training_rows).
    """
    with scratch(docs.sparkSession):
        return _trained(stored(training_rows(docs, labels, label, max_rows, held_out)))


def _trained(rows: DataFrame) -> Ordinal:
    """A model of rows (doc_id, text, y)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            y = np.asarray(slab.column("y"))
            text, feature = _present(slab.column("text").to_pylist())
            toxic = y[text] > 0
            keys, at = np.unique(feature, return_inverse=True)
            yes, no = (np.bincount(at, toxic == side, len(keys)).astype(np.int64) for side in (True, False))
            # One row without a feature counts the texts themselves.
            keys, yes, no = np.append(keys.astype(np.int64), 0), np.append(yes, (y > 0).sum()), np.append(no, (y == 0).sum())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(yes), pa.array(no)], names=["feature", "yes", "no"])

    counts = rows.mapInArrow(tidy(count), "feature long, yes long, no long").groupBy("feature").agg(F.sum("yes").cast("double").alias("yes"), F.sum("no").cast("double").alias("no"))
    counts = stored(counts.filter("feature = 0 or yes >= 2"))
    all_yes, all_no = counts.filter("feature = 0").agg(F.coalesce(F.sum("yes"), F.lit(0.0)), F.coalesce(F.sum("no"), F.lit(0.0))).first()
    a, b, c, d = F.col("yes"), F.col("no"), all_yes - F.col("yes"), all_no - F.col("no")
    chi2 = (a + b + c + d) * (a * d - b * c) * (a * d - b * c) / F.greatest(F.lit(1e-9), (a + b) * (c + d) * (a + c) * (b + d))
    lift = F.try_divide(a, a + c) / ((b + 0.5) / (b + d + 1))
    chosen = counts.filter("feature != 0").withColumn("chi2", chi2).filter((F.col("chi2") >= MIN_CHI2) & (lift >= MIN_LIFT))
    keys = np.array([r[0] for r in chosen.orderBy(F.col("chi2").desc(), "feature").limit(MAX_FEATURES).select("feature").collect()], np.int64)
    keys = np.sort(keys.astype(np.uint64))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slab in slabs(batches, "text"):
            text, feature = _present(slab.column("text").to_pylist(), keys)
            cuts = np.searchsorted(text, np.arange(slab.num_rows + 1)).tolist()
            f = [feature[x:y].astype(np.int64).tolist() for x, y in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([slab.column("doc_id").cast(pa.int64()), slab.column("y"), pa.array(f, pa.list_(pa.int64()))], names=["doc_id", "y", "features"])

    got = rows.mapInArrow(tidy(places), "doc_id long, y int, features array<long>").toArrow()
    found = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "y", "features")), strict=True))  # the fit doesn't depend on the order of rows
    fold = np.array([zlib.crc32(str(f[0]).encode()) % FOLDS for f in found], int)
    y, lists = np.array([f[1] for f in found], int), [f[2] for f in found]
    n = np.array([len(x) for x in lists], int)
    toxic = y > 0
    row = np.repeat(np.arange(len(y)), n)
    feature = np.array([f for x in lists for f in x], np.int64)
    grade = cross_fitted_grades(row, feature, toxic, fold, len(keys))
    weights, thresholds = fit(row, feature, grade, len(keys))
    return Ordinal(keys, weights, thresholds, best_cut(_sigmoid(np.bincount(row, weights[feature], len(y)) - thresholds[0]), toxic))


def severity(docs: DataFrame, model: Ordinal, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs with tox_score (probability of any grade above 0), tox_severity (expected grade, 0 to 3), toxic (tox_score >= the model's cut) and tox_grade
    (0 if not toxic, else the likeliest grade above 0).

    Features are looked up in whole texts, however long. Null and empty texts have none and score as the base rate. Each row is scored by
    itself: repeated rows get equal scores, an empty table gives none. Columns of docs with these names are replaced, others stay. One map
    over the rows; the model has MAX_FEATURES keys at most.
    """

    def compute(slab: pa.RecordBatch) -> list[pa.Array]:
        above = model.above(slab.column(text_col).to_pylist())
        steps = -np.diff(np.concatenate((np.ones((len(above), 1)), above, np.zeros((len(above), 1))), axis=1), axis=1)
        toxic = above[:, 0] >= model.cut
        grade = np.where(toxic, 1 + steps[:, 1:].argmax(1), 0).astype(np.int32)
        return [pa.array(above[:, 0]), pa.array(above.sum(1)), pa.array(grade), pa.array(toxic)]

    return mapped(docs, text_col, "tox_score double, tox_severity double, tox_grade int, toxic boolean", compute, drop=() if keep_text else (text_col,))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the model doesn't find toxic, with their own columns: rows with null ids or texts, repeated rows and any extra
    columns stay as they are; an empty table gives none."""
    clash = {c: f"docs_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    scored = severity(docs.withColumnsRenamed(clash), train(docs, labels), keep_text=True)
    return scored.filter(~F.col("toxic")).select(*(F.col(clash.get(c, c)).alias(c) for c in docs.columns))
