"""Whitening against exact sums and a direct eigensolver."""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm import whitening as W

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("label", T.IntegerType())])


def whitened(spark, rows):
    df = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA).repartition(3).select("*", *[F.lit("x").alias(c) for c in ("n", "component", "deviation", "whitened", "explained", "vector")])
    return W.whiten(df).collect()


def brute(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max(len(v) for _, v in kept)
    x = [[math.floor(64 * c) + 1_000_000 for c in list(v) + [0.0] * (width - len(v))] for _, v in kept]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in kept], n, deviation, centred, values[::-1], axes[:, ::-1]


def compare(got, rows, most=32):
    ids, n, deviation, centred, values, axes = brute(rows)
    rank = min(most, int((values > 1e-10 * values.sum()).sum()))
    assert len(got) == len(ids) * rank and {r["component"] for r in got} == set(range(1, rank + 1))
    assert {r["n"] for r in got} == {n}
    assert sorted((r["vec_id"] is not None, r["vec_id"] or 0, r["deviation"]) for r in got if r["component"] == 1) == sorted((i is not None, i or 0, d if d < 1 << 63 else None) for i, d in zip(ids, deviation, strict=True))
    for k in range(rank):
        want = centred @ axes[:, k] / math.sqrt(values[k])
        mine = [r for r in got if r["component"] == k + 1]
        assert {r["explained"] for r in mine} == {mine[0]["explained"]}
        assert mine[0]["explained"] == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert mine[0]["identity_error"] < 1e-9
        if len(set(ids)) == len(ids) and None not in ids:
            by_id = {r["vec_id"]: r["whitened"] for r in mine}
            have = np.array([by_id[i] for i in ids])
            sign = np.sign(have @ want)
            assert np.allclose(have * sign, want, atol=1e-7)


def test_random_vectors(spark):
    rng = np.random.default_rng(1)
    mixing = rng.normal(size=(40, 40))
    rows = [(i, [float(c) for c in rng.normal(size=40) @ mixing]) for i in range(400)]
    compare(whitened(spark, rows), rows)


def test_rows_that_break_things(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.normal(size=4) * 3]) for i in range(60)]
    rows += [(100, None), (101, [1.0, None, 0.0, 0.0]), (102, [math.nan, 0.0, 0.0, 0.0]), (103, [math.inf, 0.0, 0.0, 0.0]), (104, []), (105, [2.0]), (None, [1.0, 2.0, 3.0, 4.0]), (None, None)]
    rows += [(7, rows[7][1])] * 5 + [(200 + i, [0.5, 0.5, 0.25, 0.0]) for i in range(40)]
    compare(whitened(spark, rows), rows)


def test_dependent_dimensions_have_no_component(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-50, 50, (50, 3)) / 8
    rows = [(i, [float(c) for c in (a, b, c, a + b, 2 * c, 5.0)]) for i, (a, b, c) in enumerate(base)]
    got = whitened(spark, rows)
    assert {r["component"] for r in got} == {1, 2, 3}
    compare(got, rows)


def test_nothing_to_whiten(spark):
    assert not whitened(spark, []) and not whitened(spark, [(1, None)]) and not whitened(spark, [(1, [1.0, 2.0])]) and not whitened(spark, [(i, [1.0, 2.0]) for i in range(9)])


def test_large_numbers(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=3) * 1e9]) for i in range(30)]
    got = whitened(spark, rows)
    assert all(r["deviation"] is None for r in got)
    compare(got, rows)


def test_factor_and_rotation():
    rng = np.random.default_rng(6)
    a = rng.normal(size=(30, 12))
    scatter = a.T @ a
    g = W.cholesky(scatter)
    assert np.allclose(g @ g.T, scatter)
    turned = W.jacobi(g)
    assert np.allclose(turned @ turned.T, scatter)
    off = turned.T @ turned
    assert np.abs(off - np.diag(np.diag(off))).max() < 1e-10
    assert np.allclose(np.sort(np.diag(off)), np.linalg.eigvalsh(scatter))
