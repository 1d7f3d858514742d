"""First rows of groups one of which holds nine tenths of the rows; percentiles of a common value; suppression along one key."""

from __future__ import annotations

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import models, outputs, picks
from corvane.operators import sets as S


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(6)
    out = [(i, rng.choice([1] * 18 + [2, None]), rng.randrange(40) if i % 3 else None, round(rng.random(), 3)) for i in range(4000)] + [(9000 + i, 3, i, 0.5) for i in range(3)]
    return out, spark.createDataFrame(out, "k int, g int, v int, p double").repartition(6).cache()


def grouped(rows):
    out = collections.defaultdict(list)
    for r in rows:
        out[r[1]].append(r)
    return out


def test_pick(rows):
    data, df = rows
    got = collections.defaultdict(list)
    for r in S.pick(df.filter("v is not null"), "g", [F.desc("v")], "k", 7).collect():
        got[r["g"]].append((r["k"], r["pick_rank"], r["pick_candidates"], r["pick_tied"]))
    for g, own in grouped([r for r in data if r[2] is not None]).items():
        count = collections.Counter(r[2] for r in own)
        want = [(r[0], i + 1, len(own), count[r[2]] > 1) for i, r in enumerate(sorted(own, key=lambda r: (-r[2], r[0]))[:7])]
        assert sorted(got[g], key=lambda x: x[1]) == want


@pytest.mark.parametrize("threshold", [0.2, 0.999])
def test_gate(rows, threshold):
    data, df = rows
    got = {r["k"] for r in models.threshold_gate(df, "g", "p", threshold, 20).collect()}
    want = set()
    for own in grouped(data).values():
        over, need = [r for r in own if r[3] >= threshold], min(20, len(own))
        want |= {r[0] for r in (over if len(over) >= need else sorted(own, key=lambda r: (-r[3], r[0]))[:need])}
    assert got == want


def test_pools(rows):
    data, df = rows
    got = {r["k"] for r in models.pools(df, "g", "v", "k", 0.7, 50).collect()}
    want = set()
    for own in grouped(data).values():
        one, none = [r for r in own if r[2] is not None], [r for r in own if r[2] is None]
        take = min(len(one), 35 + max(0, 50 - 35 - len(none)))
        want |= {r[0] for r in sorted(one, key=lambda r: (-r[2], r[0]))[:take]} | {r[0] for r in sorted(none, key=lambda r: r[0])[: min(len(none), 50 - take)]}
    assert got == want


@pytest.mark.parametrize("cap", [1, 300, 3000, 9000])
def test_stratified(rows, cap):
    data, df = rows
    got = {r["k"] for r in models.stratified(df, ["g"], "k", cap, "s").collect()}
    want = set()
    for own in grouped(data).values():
        n = max(1, int(len(own) * cap / len(data) + 0.5))
        want |= {r[0] for r in sorted(own, key=lambda r: (hashlib.md5(f"s:{r[0]}".encode()).hexdigest(), r[0]))[:n]}
    assert got == want


def test_percentiles_of_a_common_value(spark):
    rng = random.Random(7)
    data = [(1, 5 if rng.random() < 0.99 else rng.randrange(10)) for _ in range(5000)] + [(2, rng.randrange(100)) for _ in range(77)] + [(3, 1), (3, 2)] + [(None, i) for i in range(9)]
    got = {r["g"]: tuple(r)[1:] for r in picks.percentiles(spark.createDataFrame(data, "g int, v int"), "g", "v").collect()}
    own = collections.defaultdict(list)
    for g, v in data:
        own[g].append(v)
    assert got == {g: tuple(sorted(v)[int(q * (len(v) - 1) + 0.5)] for q in picks.POINTS) for g, v in own.items() if len(v) >= 3}


def test_suppression_of_one_line(spark):
    """A hundred thousand groups of one key: as over the whole list, with no window over all of it."""
    for lone in (True, False):
        df = spark.range(100_000).select("id", F.when((F.col("id") == 77) | ((F.col("id") == 78) & F.lit(not lone)), 2).when(F.col("id") % 5 == 0, 0).otherwise(6 + F.col("id") % 50).alias("n"))
        out = outputs.suppress(df, ["id"], "n", "shown")
        assert "Window" not in out._jdf.queryExecution().executedPlan().toString()
        held = {r["id"] for r in out.filter("shown is null").collect()}
        small = {77} if lone else {77, 78}
        least = min((i for i in range(100_000) if i not in small and i % 5 and i % 50 == 50 * 0 + 1), default=None)
        candidates = [(6 + i % 50, i) for i in range(100_000) if i not in small and i % 5]
        assert held == small | {min(candidates)[1]} and (least is None or min(candidates)[1] <= least)
