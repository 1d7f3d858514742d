"""The quality classifier's solver against a plain solver of the same objective."""

from __future__ import annotations

import numpy as np

from corvane.llm import quality


def problem(seed, n=50, width=20):
    rng = np.random.default_rng(seed)
    rows = [np.sort(rng.choice(width, rng.integers(0, 9), replace=False)) for _ in range(n)]
    values = [rng.normal(size=len(r)) for r in rows]
    y = (rng.random(n) < 0.4).astype(int)
    return rows, values, y, width, np.where(y == 1, 0.7, 0.3)


def dense(rows, values, width):
    x = np.zeros((len(rows), width + 1))
    for i, (r, v) in enumerate(zip(rows, values, strict=True)):
        x[i, r] = v
    x[:, -1] = 1.0  # the offset is an indicator that is always on, and is held small like the others
    return x


def loss(x, sign, cost, w):
    return 0.5 * w @ w + (cost * np.maximum(0.0, 1 - sign * (x @ w))).sum()


def plain(x, sign, cost, rounds=60_000):
    """Projected gradient on the dual, all variables at once."""
    q = (sign[:, None] * x) @ (sign[:, None] * x).T
    alpha, step = np.zeros(len(sign)), 1 / np.linalg.eigvalsh(q)[-1]
    for _ in range(rounds):
        alpha = np.clip(alpha - step * (q @ alpha - 1), 0, cost)
    w = (alpha * sign) @ x
    return w, alpha.sum() - 0.5 * w @ w


def test_dual_descent_finds_the_least_loss():
    for seed in range(4):
        rows, values, y, width, cost = problem(seed)
        x, sign = dense(rows, values, width), np.where(y == 1, 1.0, -1.0)
        want, bound = plain(x, sign, cost)
        assert loss(x, sign, cost, want) - bound < 1e-6  # the plain solver has closed the gap, so its loss is the least
        w, b = quality.dual_descent(rows, values, y, width, cost, passes=3000)
        got = np.append(w, b)
        assert np.abs(got - want).max() < 1e-3
        assert loss(x, sign, cost, got) - bound < 1e-5


def test_production_passes_come_near_the_least_loss():
    for seed in range(4, 8):
        rows, values, y, width, cost = problem(seed)
        x, sign = dense(rows, values, width), np.where(y == 1, 1.0, -1.0)
        _, bound = plain(x, sign, cost)
        w, b = quality.dual_descent(rows, values, y, width, cost)
        none = loss(x, sign, cost, np.zeros(width + 1))
        assert loss(x, sign, cost, np.append(w, b)) - bound < 0.05 * (none - bound)
