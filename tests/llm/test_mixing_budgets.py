"""Budgets far under and over the tokens there are, against plain counting: totals within a document, per source."""

from __future__ import annotations

import collections
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import mixing

from .test_operators import text


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(12)
    rows = [(i, text(rng, rng.randint(1, 9)), rng.choice(["big"] * 8 + ["mid", "small"])) for i in range(4000)] + [(None, "no id", "mid")] * 30 + [(9000 + i, None, "none") for i in range(5)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).cache()


@pytest.mark.parametrize("budget", [1, 20, 200, 19_999, 60_000])
def test_totals_within_one_document(docs, budget):
    rows, df = docs
    got = mixing.plan(df, repetition=2.0, budget=budget).collect()
    weight = {r["source"]: r["weight"] for r in mixing.plan(df, repetition=2.0).collect()}
    tokens = collections.Counter()
    for r in got:
        tokens[r["source"]] += r["n_tokens"]
    for s in ("big", "mid", "small"):
        assert weight[s] * budget - 1 <= tokens[s] <= weight[s] * budget + 9
    passes = collections.Counter((r["doc_id"], r["pass"]) for r in got if r["doc_id"] is not None)
    assert not passes or max(passes.values()) == 1
    assert all(0 <= r["rank"] <= 1 for r in got)


def test_targets_of_ten_million_million_tokens(spark):
    """Shares of a budget that is a ten-millionth of the tokens stay whole."""
    rows = spark.createDataFrame([("a", 9 * 10**12, 0.9), ("b", 10**12, 0.1)], "__source string, tokens long, share double")
    for budget in (10, 10**6, 6 * 10**6, 10**13):
        got = {r["__source"]: r["target"] for r in mixing.weights(rows, 1.0, budget).collect()}
        assert abs(got["a"] - 0.9 * budget) <= 1 and abs(got["b"] - 0.1 * budget) <= 1
    whole = {r["__source"]: r["target"] for r in mixing.weights(rows, 1.0, None).collect()}
    assert whole == {"a": 9 * 10**12, "b": 10**12}
    assert mixing.weights(rows.filter(F.lit(False)), 1.0, 5).count() == 0
