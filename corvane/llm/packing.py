"""Packing into optimal length buckets.

The global histogram of lengths is the only thing the driver sees: a bin for each length
that occurs, at most as many as the longest document has words.  Dynamic programming over the
histogram chooses the bucket boundaries with the least padding; batches of a token
budget form inside each bucket.

Defined results: a null text and a text without words have length 0 and are
packed like any other; a document longer than the budget is a batch of its own;
repeated rows are packed each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

BUDGET, BUCKETS = 16_384, 16


def boundaries(tops: list[int], counts: list[int], sums: list[int], buckets: int) -> list[int]:
    """Tops of the buckets that pad least: cost of bins i..j is top_j * count - sum of lengths.

    best[k][j] is found by divide and conquer, since the best split point does not fall as j grows.
    """
    order = np.argsort(tops)
    top, n, s = (np.asarray(x, np.int64)[order] for x in (tops, counts, sums))
    cn, cs, size = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(s)]), len(top)
    if not size:
        return []
    best = top * cn[1:] - cs[1:]
    splits = []
    for _ in range(min(buckets, size) - 1):
        new, at = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
        stack = [(0, size - 1, -1, size - 1)]
        while stack:
            lo, hi, a, b = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(max(a, -1), min(b, j - 1) + 1)  # the bucket holds bins i + 1 .. j
            cost = np.where(i >= 0, best[np.maximum(i, 0)], 0) + top[j] * (cn[j + 1] - cn[i + 1]) - (cs[j + 1] - cs[i + 1])
            k = int(np.argmin(cost))
            new[j], at[j] = cost[k], i[k]
            stack += [(lo, j - 1, a, int(i[k])), (j + 1, hi, int(i[k]), b)]
        best = new
        splits.append(at)
    out, j = [], size - 1
    for at in reversed(splits):
        out.append(int(top[j]))
        j = int(at[j])
        if j < 0:
            return out[::-1]
    return [*out, int(top[j])][::-1]


def histogram(lengths: DataFrame) -> DataFrame:
    """(top, n, tokens) of the lengths in column n_tokens; a row for each length."""
    return lengths.groupBy(F.col("n_tokens").alias("top")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("tokens"))


def pack(docs: DataFrame, budget: int = BUDGET, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_tokens, bucket, boundary (padded length), batch_id, slot, padding."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.n_words(F.col("text")).alias("n_tokens"), C.dealt_key(F.col("doc_id"), F.length("text")).alias("__key"))
    rows = C.stored(rows)
    bins = histogram(rows).collect()
    tops = boundaries([r["top"] for r in bins], [r["n"] for r in bins], [r["tokens"] for r in bins], buckets)
    edges = F.array(*[F.lit(t) for t in tops]) if tops else F.array().cast("array<bigint>")
    place = F.size(F.filter(edges, lambda e: e < F.col("n_tokens"))).cast("int")
    rows = rows.withColumn("bucket", place).withColumn("boundary", F.element_at(edges, place + 1).cast("long"))
    rows = C.ranked(rows.withColumn("__one", F.lit(1)), ["bucket"], "__key", "__one", ["doc_id", "n_tokens"])
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1)))).cast("long")
    batch = F.floor(F.col("before") / room).cast("long")
    return rows.select("doc_id", "n_tokens", "bucket", "boundary", F.concat_ws("-", "bucket", batch).alias("batch_id"), F.pmod("before", room).cast("int").alias("slot"), (F.col("boundary") - F.col("n_tokens")).alias("padding"))
