"""Embedding columns as numpy arrays inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Entries are held as whole numbers in doubles on the way; a vector with an entry beyond this counts as not finite.
WIDEST = float(1 << 52)


def whole(column: pa.Array, scale: float, widest: float = WIDEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(takes part, lengths, entries) of a list column: floor(scale * entry) of the rows that take part, one row after the other.

    A row takes part if its vector is not null and every entry is there, finite and no larger than `widest`.
    """
    there = ~np.asarray(column.is_null())
    lengths = np.where(there, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        flat = np.floor(scale * flat)
        bad = ~(np.abs(flat) <= widest)
    upto = np.concatenate([[0], np.cumsum(lengths)])
    found = np.concatenate([[0], np.cumsum(bad)])
    good = there & (found[upto[1:]] == found[upto[:-1]])
    return good, lengths[good], flat[np.repeat(good, lengths)].astype(np.int64)


def padded(lengths: np.ndarray, flat: np.ndarray, width: int, fill: int = 0) -> np.ndarray:
    """A matrix with a row for each vector; what a shorter vector lacks is `fill`."""
    out = np.full((len(lengths), width), fill, np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out
