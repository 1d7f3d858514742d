"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi.

Entries become whole numbers, so the sums of the dimensions are exact at any size.
One pass gives the sums, one the scatter of the vectors about their mean, added up
per task and then over tasks: what reaches the driver is one number for each
pair of dimensions.  There the scatter is factored with pivoting, A = G G', and
G's columns are rotated by Jacobi's method from the right until they are
orthogonal; the scatter itself is not touched again.  Squared column norms are
then its eigenvalues and the normalised columns its eigenvectors.  A pass
whitens the rows, another adds up the covariance of what came out.

The rows are read four times, so hand over a stored table rather than a long plan.

Defined results: rows whose vector is null or has a null, non-finite or larger entry than 2**52 are dropped; a
shorter vector counts as filled up with zeros; a null id stays null; repeated rows
count and are returned each on their own; components whose eigenvalue is under 1e-12 of
the trace do not exist (so an empty table, one row, or rows that are all equal
give no rows); deviation is null where a long can't hold it.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C
from . import vectors as V

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 32
#: Part of the trace under which an eigenvalue is rounding.
LEAST = 1e-12


def cholesky(scatter: np.ndarray) -> np.ndarray:
    """G with G G' = scatter, rows in the order of the dimensions: with rows in the order of the pivots it is lower triangular."""
    size = len(scatter)
    rest, free, g = np.diag(scatter).copy(), np.ones(size, bool), np.zeros((size, 0))
    while free.any():
        at = int(np.argmax(np.where(free, rest, -1.0)))
        if not rest[at] > LEAST * np.trace(scatter) / size:
            break
        top = np.sqrt(rest[at])
        free[at] = False
        column = np.where(free, (scatter[:, at] - g @ g[at]) / top, 0.0)
        column[at] = top
        g, rest = np.column_stack([g, column]), rest - column**2
    return g


def jacobi(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated, two at a time, until all are orthogonal to double precision."""
    g = factor.copy()
    size = g.shape[1]
    players = list(range(size + size % 2))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(players) - 1):
            # a round of pairs that share no column
            pairs = [(min(a, b), max(a, b)) for a, b in zip(players[: len(players) // 2], reversed(players[len(players) // 2 :]), strict=True) if max(a, b) < size]
            p, q = (np.array(x, int) for x in zip(*pairs, strict=True)) if pairs else (np.zeros(0, int),) * 2
            players = [players[0], players[-1], *players[1:-1]]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            size_of = np.sqrt(a * b)
            turn = np.abs(c) > 1e-16 * size_of
            worst = max(worst, float((np.abs(c[turn]) / size_of[turn]).max(initial=0.0)))
            if not turn.any():
                continue
            p, q, a, b, c = p[turn], q[turn], a[turn], b[turn], c[turn]
            z = (b - a) / (2 * c)
            t = np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.sqrt(1 + z * z))
            cos = 1 / np.sqrt(1 + t * t)
            sin = cos * t
            g[:, p], g[:, q] = cos * g[:, p] - sin * g[:, q], sin * g[:, p] + cos * g[:, q]
        if worst < 1e-15:
            break
    return g


def components(scatter: np.ndarray, n: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues of scatter / n by falling size, a unit eigenvector in each column)."""
    g = jacobi(cholesky(scatter))
    norms = (g**2).sum(0)
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > LEAST * max(np.trace(scatter), 1e-300)][:most]
    return norms[order] / n, g[:, order] / np.sqrt(norms[order])


class Centre:
    """Number of vectors, and exact sums by dimension as the whole part of the mean and what is left over."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.width = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.part = np.array([r / n for r in self.rest])

    def moved(self, x: np.ndarray) -> np.ndarray:
        """x less the whole part of the mean."""
        return x - self.whole

    def deviations(self, y: np.ndarray) -> list[int | None]:
        """Of each row moved to the whole mean, the sum of (n * x - sums) ** 2, exact; None beyond a long."""
        most = self.n * (int(np.abs(y).max(initial=0)) + 1)
        if self.width * most * most < 1 << 63:
            return ((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(1).tolist()
        out = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest, strict=True)) for row in y.tolist()]
        return [v if v < 1 << 63 else None for v in out]


def _rows(batch: pa.RecordBatch, width: int) -> tuple[pa.Array, np.ndarray]:
    good, lengths, flat = V.whole(batch.column(1), SCALE)
    return batch.column(0).filter(pa.array(good)), V.padded(lengths, flat + SHIFT, width, SHIFT)


def _sums(rows: DataFrame) -> Centre | None:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, seen = 0, np.zeros((2, 0), object), np.zeros(0, object)
        for batch in batches:
            _, lengths, flat = V.whole(batch.column(1), SCALE)
            width = int(lengths.max(initial=0))
            if width > len(seen):
                sums, seen = np.pad(sums, ((0, 0), (0, width - len(seen)))), np.pad(seen, (0, width - len(seen)))
            x = V.padded(lengths, flat, width)
            n += len(lengths)
            # halves of the numbers, so that a batch's sum fits
            sums[0, :width] += (x >> 26).sum(0).astype(object)
            sums[1, :width] += (x & ((1 << 26) - 1)).sum(0).astype(object)
        totals = [int(h) * (1 << 26) + int(low) for h, low in sums.T]
        schema = pa.schema([("place", pa.int32()), ("total", pa.decimal128(38, 0))])
        yield C.record(schema, range(-1, len(totals)), [Decimal(n), *map(Decimal, totals)])

    found = {r["place"]: int(r["total"]) for r in rows.mapInArrow(run, "place int, total decimal(38,0)").groupBy("place").agg(F.sum("total").alias("total")).collect()}
    n = found.pop(-1, 0)
    return Centre(n, [found[i] + n * SHIFT for i in range(len(found))]) if n and found else None


def _scatter(batches: Iterator[np.ndarray], width: int) -> Iterator[pa.RecordBatch]:
    """Sums of products of every pair of columns, and of each column (numbered after the pairs), over a task's rows."""
    products, sums = np.zeros((width, width)), np.zeros(width)
    for z in batches:
        products += z.T @ z
        sums += z.sum(0)
    values = np.concatenate([products[np.triu_indices(width)], sums])
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values)), pa.int32()), pa.array(values)], names=["cell", "total"])


def _gathered(parts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(products, sums) over all tasks; a number for each pair of dimensions."""
    values = np.zeros(width * (width + 1) // 2 + width)
    for r in parts.groupBy("cell").agg(F.sum("total").alias("total")).collect():
        values[r["cell"]] = r["total"]
    products = np.zeros((width, width))
    products[np.triu_indices(width)] = values[:-width]
    return np.triu(products) + np.triu(products, 1).T, values[-width:]


def whiten(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """A row for each vector and component: the id, component, n, deviation, whitened, explained, identity_error."""
    rows = vectors.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    nothing = rows.sparkSession.createDataFrame([], schema)
    centre = _sums(rows)
    if centre is None:
        return nothing
    width, cells = centre.width, "cell int, total double"

    def centred(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for batch in batches:
            yield centre.moved(_rows(batch, width)[1]) - centre.part

    scatter, _ = _gathered(rows.mapInArrow(lambda batches: _scatter(centred(batches), width), cells), width)
    values, axes = components(scatter, centre.n, most)
    if not len(values):
        return nothing
    explained, project, size = values / (np.trace(scatter) / centre.n), axes / np.sqrt(values), len(values)
    products, sums = _gathered(rows.mapInArrow(lambda batches: _scatter((z @ project for z in centred(batches)), size), cells), size)
    error = float(np.abs(products / centre.n - np.outer(sums, sums) / centre.n**2 - np.eye(size)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, x = _rows(batch, width)
            y = centre.moved(x)
            count = len(x)
            each = pa.array(np.repeat(np.arange(count), size))
            yield pa.RecordBatch.from_arrays(
                [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, size + 1, dtype=np.int32), count)),
                    pa.array(np.full(count * size, centre.n, np.int64)),
                    pa.array(centre.deviations(y), pa.int64()).take(each),
                    pa.array(((y - centre.part) @ project).ravel()),
                    pa.array(np.tile(explained, count)),
                    pa.array(np.full(count * size, error)),
                ],
                names=[f.split()[0] for f in schema.split(", ")],
            )

    return rows.mapInArrow(run, schema)
