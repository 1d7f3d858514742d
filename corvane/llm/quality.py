"""Quality by naive Bayes support vectors.

Indicators are n-grams of words and of word shapes.  Each is scaled by the log
ratio of its counts in the classes, and a linear hinge-loss model is fitted on
the scaled indicators by dual coordinate descent.  A logistic curve, fitted on
a part that the descent did not see, turns margins into scores.

Defined results: as in toxicity: null texts score as empty ones, repeated rows
alike, and without labels of both classes every score is the share of label 1.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame

from . import linear as L

#: Labelled rows of each class that the model is fitted on at most.
PER_CLASS = 3000
_TOKEN = re.compile(rb"[A-Za-z\x80-\xff]+|[0-9]+|\n+|[^\sA-Za-z0-9\x80-\xff]+")


def _shape(token: bytes) -> bytes:
    first = token[0]
    if first == 10:
        return b"_"
    if 48 <= first <= 57:
        return b"9"
    if first < 128 and not token[:1].isalpha():
        return token[:4]
    text = token.decode("utf-8", "replace")
    return b"X" if text.isupper() and len(text) > 1 else b"Xx" if text[0].isupper() else b"x"


def features(text: bytes) -> np.ndarray:
    """Distinct hashed n-grams of a whole text: words 1 and 2 long, shapes 1 to 3 long."""
    crc, tokens, shapes = zlib.crc32, _TOKEN.findall(text), {}
    for token in set(tokens):
        shapes[token] = _shape(token)
    row = [shapes[t] for t in tokens]
    found = {crc(t, 1) for t in {t.lower() for t in shapes}}
    found.update(crc(b" ".join(p), 2) for p in set(zip(tokens, tokens[1:], strict=False)))
    for k in (1, 2, 3):
        found.update(crc(b" ".join(p), 3) for p in set(zip(*(row[i:] for i in range(k)), strict=False)))
    return np.fromiter(found, np.int64, len(found)) & (L.BINS - 1)


def log_count_ratios(x: L.Rows, y: np.ndarray, smoothing: float = 1.0) -> np.ndarray:
    p, q = x.of(y == 1) + smoothing, x.of(y == 0) + smoothing
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: np.ndarray, passes: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Linear hinge-loss model: one dual variable at a time, its weights kept in step; the offset is an indicator that is always on."""
    rng, sign = np.random.default_rng(seed), np.where(y == 1, 1.0, -1.0)
    w, b, alpha = np.zeros(width), 0.0, np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(passes):
        for i in rng.permutation(len(rows)):
            slack = sign[i] * (w[rows[i]] @ values[i] + b) - 1
            new = min(max(alpha[i] - slack / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * sign[i]
                w[rows[i]] += step * values[i]
                b += step
                alpha[i] = new
    return w, b


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, cost: float = 0.05) -> L.Model:
    """Fit on the training fold of labels (column quality) and whole texts of docs."""
    training = L.training_labels(labels, "quality")
    counts = {r["label"]: r["count"] for r in training.groupBy("label").count().collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    found = L.sampled_features(L.sampled_texts(docs, training, per_class), features)
    y = found["label"].to_numpy().astype(np.int64)
    if not len(y) or y.min() == y.max():
        p = min(max(share, 1e-9), 1 - 1e-9)
        return L.Model(np.zeros(L.BINS), 0.0, 1.0, float(np.log(p / (1 - p))))
    rows = L.Rows.of_column(found["features"]).split()

    def trained(part: np.ndarray) -> tuple[np.ndarray, float]:
        own = [rows[i] for i in np.flatnonzero(part)]
        x, labels_ = L.Rows(np.concatenate(own), np.array([len(r) for r in own])), y[part]
        ratio = log_count_ratios(x, labels_)
        seen = x.of(np.ones(len(own), bool)) >= 2
        ratio = np.where(seen, ratio, 0.0)
        scale = [ratio[r] / np.sqrt(max(1, len(r))) for r in own]
        each = np.where(labels_ == 1, cost * len(own) / 2 / max(1, (labels_ == 1).sum()), cost * len(own) / 2 / max(1, (labels_ == 0).sum()))
        w, b = dual_descent(own, scale, labels_, L.BINS, each)
        return w * ratio, b

    inner = np.arange(len(y)) % 5 != 0
    w, b = trained(inner)
    test = ~inner
    margin = np.array([w[r].sum() / np.sqrt(max(1, len(r))) for r, t in zip(rows, test, strict=True) if t]) + b
    slope, shift = L.platt(margin, y[test].astype(float))
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    shift += float(np.log((max(share, 1e-6) / max(1 - share, 1e-6)) / (n1 / n0)))
    w, b = trained(np.ones(len(y), bool))
    return RootModel(w, b, slope, shift)


class RootModel(L.Model):
    """Indicators of a text count by one over the square root of their number, so long texts have no larger margins."""

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[r].sum(dtype=np.float64)) / np.sqrt(max(1, len(r))) for r in rows]) + self.offset


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, per_class: int = PER_CLASS) -> DataFrame:
    return L.scored(docs, fit(docs, labels, per_class), features, threshold)
