"""What the two text classifiers share: labelled samples, hashed indicators, scoring by one table of weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Hashed indicator space; the table of weights has one float for each, 4 MB in all.
BINS = 1 << 20
_SAMPLE = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("features", pa.list_(pa.int32())), ("swapped", pa.list_(pa.int32()))])

Features = Callable[[bytes], np.ndarray]


def training_labels(labels: DataFrame, column: str, use_all: bool = False) -> DataFrame:
    """(doc_id, label) outside the held-out fold; of several labels of a document the greatest counts, nulls do not."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(column).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    return (rows if use_all else rows.filter(~C.held_out())).groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_sample(training: DataFrame, per_class: int) -> DataFrame:
    """At most per_class rows of each label, those with the least hashes of doc_id."""
    parts = [training.filter(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for y in (0, 1)]
    return parts[0].union(parts[1])


def sampled_texts(docs: DataFrame, training: DataFrame, per_class: int) -> DataFrame:
    """(doc_id, label, text) of the sampled documents, one row for each: of a doc_id's several texts the one with the least digest."""
    sample = bounded_sample(training, per_class)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    return rows.groupBy("doc_id", "label").agg(F.min_by("text", F.md5("text")).alias("text"))


def sampled_features(sample: DataFrame, features: Features, swap: Callable[[bytes], bytes] | None = None) -> pa.Table:
    """doc_id, label, features and, of those that have one, the swapped twin's: one row for each sampled document comes to the driver, in order of doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, other = [], []
            for text in C.raw(batch):
                own.append(features(text))
                changed = swap(text) if swap else text
                other.append(features(changed) if changed != text else None)
            yield C.record(_SAMPLE, batch.column(0), batch.column(1), own, other)

    return C.map_arrow(sample.select("doc_id", "label", "text"), run, "doc_id long, label int, features array<int>, swapped array<int>").toArrow().sort_by("doc_id")


class Rows:
    """Binary rows in compressed form: the flat feature numbers and the row of each."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes = flat.astype(np.int32, copy=False), sizes
        self.row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)

    @classmethod
    def of_column(cls, column: pa.ChunkedArray, chosen: np.ndarray | None = None) -> Rows:
        """Rows of a list column, or the chosen ones of them."""
        lists = column.combine_chunks() if chosen is None else column.take(pa.array(np.flatnonzero(chosen))).combine_chunks()
        lists = lists if isinstance(lists, pa.Array) else pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], column.type)
        return cls(lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy()).astype(np.int64))

    def split(self) -> list[np.ndarray]:
        return np.split(self.flat, np.cumsum(self.sizes)[:-1]) if len(self.sizes) else []

    def renamed(self, place: np.ndarray) -> Rows:
        """The rows over the indicators that have a place, numbered by it."""
        at = place[self.flat]
        return Rows(at[at >= 0], np.bincount(self.row[at >= 0], minlength=len(self.sizes)))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.flat], len(self.sizes))

    def back(self, g: np.ndarray, width: int) -> np.ndarray:
        return np.bincount(self.flat, g[self.row], width)

    def of(self, mask: np.ndarray) -> np.ndarray:
        """In how many of the chosen rows each indicator is on."""
        return np.bincount(self.flat[mask[self.row]], minlength=BINS)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def platt(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve of the margins, with smoothed targets, by Newton steps."""
    pos, neg = y.sum(), len(y) - y.sum()
    t, a, b = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2)), 1.0, 0.0
    for _ in range(rounds):
        p = sigmoid(a * margin + b)
        g, w = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[np.sum(w * margin * margin) + 1e-3, np.sum(w * margin)], [np.sum(w * margin), np.sum(w) + 1e-3]])
        step = np.linalg.solve(h, [np.sum(g * margin) + 1e-3 * a, np.sum(g) + 1e-3 * b])
        a, b = a - np.clip(step[0], -1, 1), b - np.clip(step[1], -1, 1)
    return float(a), float(b)


class Model:
    """A weight for each hashed indicator, an offset, and the logistic curve of the sum."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float, swapped: int = 0, terms: list | None = None):
        self.weights, self.offset, self.slope, self.shift = weights.astype(np.float32), offset, slope, shift
        self.swapped, self.terms = swapped, terms or []  # labelled rows with a swapped twin, and the group terms

    def margins(self, rows: list[np.ndarray]) -> np.ndarray:
        return np.array([float(self.weights[r].sum(dtype=np.float64)) for r in rows]) + self.offset

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * margins + self.shift)


def score_column(docs: DataFrame, model: Model, features: Features, text: Column) -> Column:
    """The score of a text column, computed batch by batch; a null text scores as an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(own.scores(own.margins([features((t or "").encode()) for t in texts])), dtype="float64")

    return score(text)


def scored(docs: DataFrame, model: Model, features: Features, threshold: float) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    rows = docs.select(F.col("doc_id"), C.held_out().alias("held_out"), score_column(docs, model, features, docs["text"]).alias("score"))
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
