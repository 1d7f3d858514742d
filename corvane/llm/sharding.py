"""Sharding by extendible hashing, with DataFrame functions only.

The directory is indexed by the leading bits of a document's hash.  A bucket
that is over its byte limit is split on one more bit, and only such a bucket, until every
shard fits.  Sizes are aggregated once by a fixed number of leading bits; the sizes
at all coarser depths follow from those cells, and only rows of cells that are
still too large are looked at again with more bits.

Defined results: a null text has no bytes; a null doc_id is hashed as an empty
one; rows that agree in doc_id and text have one hash and stay together, so a
shard of such rows may stay over the limit, as does one document that is larger
than it; both have fits = false; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

LIMIT = 1 << 20
BITS = 60
#: Bits of a cell beyond what evenly dealt bytes would need, and bits added in each later round.
SPARE, MORE = 5, 8
#: Levels that are rolled up at a time: the spare ones, and one to see that a parent is too large, with one to spare.
LEVELS = 7


def hash_key() -> Column:
    return C.dealt_key(F.col("doc_id"), F.md5(F.coalesce(F.col("text"), F.lit(""))))


def _prefix(key: Column, depth: Column | int) -> Column:
    return F.floor(key / F.pow(F.lit(2.0), F.lit(BITS) - depth)).cast("long") if not isinstance(depth, int) else F.shiftright(key, BITS - depth)


def _leaves(cells: DataFrame, base: int, top: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes) of the cells that have a leaf: the shallowest prefix, from base on, that fits.

    Sums are rolled up from the cells, a few levels at a time.  Even keys have their leaves among the first few; only
    what still fits at the last of them goes on, with the sums of that level.
    """
    nodes, pending, low, found = cells.select(F.col("cell").alias("node"), "n_bytes", "n"), cells.select("cell", F.col("cell").alias("node")), top, None
    while True:
        high, low = low, max(base, low - LEVELS)
        levels = nodes.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(high)))).withColumn("prefix", F.expr(f"shiftright(node, {high} - depth)"))
        sums = C.stored(levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("shard_bytes"), F.sum("n").alias("n")))
        fit = sums.filter((F.col("shard_bytes") <= limit) | (F.col("n") == 1) | (F.col("depth") == BITS)).drop("n")
        leaf = levels.select("node", "depth", "prefix").join(fit, ["depth", "prefix"]).groupBy("node").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
        here = pending.join(leaf, "node").select("cell", "leaf.*")
        if low == base:
            return here if found is None else found.union(here)
        here = C.stored(here)
        done, going_on = here.filter(F.col("depth") > low), here.filter(F.col("depth") == low)
        found = done if found is None else found.union(done)
        if going_on.isEmpty():
            return found
        nodes, pending = sums.filter(F.col("depth") == low).select(F.col("prefix").alias("node"), F.col("shard_bytes").alias("n_bytes"), "n"), going_on.select("cell", F.col("prefix").alias("node"))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """Leaves of the directory by cell: (cell_depth, cell, depth, prefix, shard_bytes, fits), from rows of (key, n_bytes)."""
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, top, open_, found = 0, min(BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE), rows, None
    while True:
        cells = C.stored(open_.groupBy(F.shiftright("key", BITS - top).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"), F.count(F.lit(1)).alias("n")))
        leaves = C.stored(_leaves(cells, base, top, limit).select(F.lit(top).alias("cell_depth"), "cell", "depth", "prefix", "shard_bytes", (F.col("shard_bytes") <= limit).alias("fits")))
        found = leaves if found is None else found.union(leaves)
        large = cells.join(leaves, "cell", "left_anti").select("cell")
        if top == BITS or not large.limit(1).count():
            return found
        open_ = C.stored(open_.withColumn("cell", F.shiftright("key", BITS - top)).join(C.hinted(large), "cell", "left_semi").drop("cell"))
        base, top = top + 1, min(BITS, top + MORE)


def assign(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_bytes, shard (its bits), depth, shard_bytes, fits."""
    rows = C.stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), hash_key().alias("key")))
    leaves = C.stored(directory(rows.select("key", "n_bytes"), limit))
    depths = [r[0] for r in leaves.select("cell_depth").distinct().collect()]  # at most one for each round
    out = None
    for d in sorted(depths):
        part = rows.withColumn("cell", F.shiftright("key", BITS - d)).join(C.hinted(leaves.filter(F.col("cell_depth") == d).drop("cell_depth")), "cell")
        out = part if out is None else out.union(part)
    if out is None:
        out = rows.withColumn("cell", F.lit(0)).join(leaves.drop("cell_depth"), "cell")
    bits = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("doc_id", "n_bytes", bits.alias("shard"), F.col("depth").cast("int").alias("depth"), "shard_bytes", "fits")
