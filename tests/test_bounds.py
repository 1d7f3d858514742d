"""Exact one-sided bounds over a grid, against tail sums in fractions; pooled rounds and certificates on the same."""

from __future__ import annotations

from fractions import Fraction
from math import comb

from corvane.operators import review


def tail(k: int, n: int, p: Fraction) -> Fraction:
    """Probability of at most k errors of n, exact."""
    return sum((comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)), Fraction(0))


GRID = [(k, n) for n in (1, 2, 3, 7, 20, 59, 150) for k in sorted({0, 1, 2, n // 3, n - 1, n}) if k <= n]


def holds(bound: float, k: int, n: int, rest: Fraction) -> bool:
    """The bound is where the tail falls to `rest`, to its ninth digit; with nothing right it is 1."""
    if k == n:
        return bound == 1.0
    off = Fraction(2, 10**9)
    return tail(k, n, Fraction(bound) - off) > rest > tail(k, n, Fraction(bound) + off)


def test_bounds(spark):
    df = spark.createDataFrame(GRID + [(0, 0)], "wrong int, read int")
    for confidence, rest in ((0.95, Fraction(1, 20)), (0.5, Fraction(1, 2)), (0.99, Fraction(1, 100))):
        got = {(r["wrong"], r["read"]): r["b"] for r in df.withColumn("b", review.upper_bound(df["wrong"], df["read"], confidence)).collect()}
        assert all(holds(got[k, n], k, n, rest) for k, n in GRID)
        assert got[0, 0] == 1.0


def test_pooled_rounds(spark):
    rounds = [("a", k, n) for k, n in GRID[:8]] + [("b", 0, 59)]
    got = {r["kind"]: r for r in review.pooled(spark.createDataFrame(rounds, "kind string, wrong int, read int"), "kind").collect()}
    k, n = sum(x[1] for x in rounds[:8]), sum(x[2] for x in rounds[:8])
    assert (got["a"]["wrong"], got["a"]["read"]) == (k, n) and holds(got["a"]["bound"], k, n, Fraction(1, 20))
    assert holds(got["b"]["bound"], 0, 59, Fraction(1, 20)) and got["b"]["bound"] < 0.05


def test_certificates(spark):
    rows = [(f"{k}/{n}", k, n) for k, n in GRID]
    df = spark.createDataFrame(rows, "value string, wrong int, read int")
    stated = {"0/59": 0.049508, "0/20": 0.5}
    bar = Fraction(1, 10)
    for r in review.certificate(df, float(bar), stated).collect():
        k, n = r["wrong"], r["read"]
        under = k < n and tail(k, n, bar) <= Fraction(1, 20)
        want = "refused: stated bound differs" if r["value"] == "0/20" else "granted" if under else "refused: misses its bar"
        if r["value"] == "0/59":
            want = "granted" if abs(0.049508 - r["bound"]) <= 1e-6 else "refused: stated bound differs"
        assert r["verdict"] == want
