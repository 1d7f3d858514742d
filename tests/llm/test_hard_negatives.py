"""Hard negatives against comparing every anchor with every row."""

from __future__ import annotations

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives as N

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, scale=256, k=5):
    held = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            held.append((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label))
    width = max([len(v) for _, v, _ in held], default=0)
    held = [(i, v + [0] * (width - len(v)), label) for i, v, label in held]
    out = collections.Counter()
    for at, (i, v, label) in enumerate(held):
        if i % 100:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, n, other) for n, (j, w, other) in enumerate(held) if n != at]
        for s, j, _, _ in sorted(x for x in scores if x[3] == label)[:k]:
            found = [x for x in sorted(scores) if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s]
            for rank, (t, m, _, _) in enumerate(found[:k]):
                out[i, j, rank + 1, m, -s, -t] += 1
    return out


def answers(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).select("*", *[F.lit("x").alias(c) for c in ("row", "x", "part", "anchor", "query", "score", "rank", "low")])
    got = N.mine(df, anchor=F.col("vec_id") % 100 == 0, **more).collect()
    return collections.Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in got)


def table(seed, n, width=6, labels=4, clustered=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = rng.normal(size=width) * (0.05 if clustered else 0.3) + (centres[i % 8] if clustered else 0)
        rows.append((i * 10, [float(x) for x in np.round(v, 2)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize("clustered", [False, True])
def test_against_every_row(spark, clustered):
    rows = table(1, 700, clustered=clustered)
    got = answers(spark, rows, part_rows=150)
    assert got == brute(rows) and len(got) > 100


def test_rows_that_break_things(spark):
    rows = table(2, 150, width=3)
    rows += [(None, [1.0, 1.0, 1.0], 1), (100, None, 1), (300, [1.0, None, 0.0], 2), (200, [1.0, float("nan"), 0.0], 2), (400, [float("inf"), 0.0, 0.0], 1), (500, [0.5, 0.5, 0.5], None)]
    rows += [(7, [], 1), (9, [0.5], 2), (11, [0.1, 0.2, 0.3, 0.4], 0), (600, [], 1)]
    rows += [(100, [0.4, 0.1, 0.2], 1)] * 3 + [(13, [0.4, 0.1, 0.2], 2)] * 8
    got = answers(spark, rows, part_rows=40)
    assert got == brute(rows)


def test_a_hot_label_and_a_hot_vector(spark):
    rows = [(i, [0.25, 0.5, -0.5] if i % 3 else [float(i % 7) / 8, 0.5, float(i % 11) / 16], 0 if i % 10 < 8 else i % 5) for i in range(1500)]
    got = answers(spark, rows, part_rows=100)
    assert got == brute(rows)


def test_scores_that_doubles_cannot_hold(spark):
    rng = np.random.default_rng(4)
    rows = [(i * 10, [float(np.float32(x)) for x in rng.normal(size=3) * 2e6], int(rng.integers(3))) for i in range(80)]
    assert max(abs(k[4]) for k in brute(rows)) > 1 << 53
    assert answers(spark, rows) == brute(rows)
    rows.append((100, [1e30, 0.0, 0.0], 1))
    assert answers(spark, rows) == brute(rows[:-1])


def test_few_rows(spark):
    assert not answers(spark, [])
    assert not answers(spark, [(100, [1.0], 1)])
    rows = [(0, [1.0, 0.5], 1), (1, [1.0, 0.25], 1), (2, [1.0, 0.1], 2)]
    assert answers(spark, rows) == brute(rows) and len(brute(rows)) == 1


def test_boxes_are_left_out():
    """On clustered rows most leaves are never verified."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.integers(-20, 20, (64, 8)) + c for c in rng.integers(-2000, 2000, (100, 8))])
    ids = np.arange(len(x))
    leaves = N.tiles(x, [0, 1, 2], ids, 100)
    tree = N.Tree(8, [(ids[r].tobytes(), ids[r].tobytes(), N.narrow(x[r]).tobytes()) for r in leaves])
    none = np.full(1, N.NONE), np.full(1, -N.NONE)
    q = N.Block(x[:1].astype(np.int64), *none, np.array([0]), 5)
    taken = []
    whole, q.take = q.take, lambda *a: (taken.append(1), whole(*a))
    q.search(tree, np.array([0]))
    scores = x @ x[0]
    assert q.scores[0].tolist() == sorted(scores[1:].tolist(), reverse=True)[:5]
    assert len(taken) < len(leaves) // 3
