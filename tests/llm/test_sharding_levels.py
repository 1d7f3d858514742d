"""Directories whose leaves lie far above the cells: a few rows hold nearly all bytes, so most shards are shallow."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import sharding


def plain(rows, limit, prefix=""):
    """{doc_id: (shard, bytes)} by splitting from the root, rows (id, bytes, key bits)."""
    total = sum(n for _, n, _ in rows)
    if total <= limit or len(rows) == 1 or len(prefix) == sharding.BITS:
        return {i: (prefix, total) for i, _, _ in rows}
    out = {}
    for bit in "01":
        part = [r for r in rows if r[2][len(prefix)] == bit]
        if part:
            out |= plain(part, limit, prefix + bit)
    return out


@pytest.mark.parametrize("levels", [1, 2, 7])
def test_shallow_and_deep_leaves(spark, monkeypatch, levels):
    monkeypatch.setattr(sharding, "LEVELS", levels)
    rng = random.Random(levels)
    texts = [(i, "x" * (rng.choice([1, 2, 3]) if i % 50 else 40_000)) for i in range(600)]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    keys = {r["doc_id"]: format(r["k"], "060b") for r in df.select("doc_id", sharding.hash_key().alias("k")).collect()}
    limit = 400
    want = plain([(i, len(t), keys[i]) for i, t in texts], limit)
    got = {r["doc_id"]: (r["shard"], r["shard_bytes"]) for r in sharding.assign(df, limit).collect()}
    assert got == want and len({len(s) for s, _ in want.values()}) > 3


def test_a_single_shard_and_repeats(spark):
    df = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    assert {(r["depth"], r["shard_bytes"], r["fits"]) for r in sharding.assign(df, 10).collect()} == {(60, 200, False)}
    assert sharding.assign(df).select("shard", F.col("depth")).distinct().collect()[0][1] == 0
