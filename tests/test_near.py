"""As-of partners against comparing every pair: coarse partners, best, open windows, ties, a hot subject."""

from __future__ import annotations

import calendar
import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import sets as S

D = dt.date


def interval(day, precision):
    if precision == "year":
        return D(day.year, 1, 1), D(day.year, 12, 31)
    if precision == "month":
        return D(day.year, day.month, 1), D(day.year, day.month, calendar.monthrange(day.year, day.month)[1])
    return day, day


def brute(anchors, partners, lo, hi, policy, tie, strict):
    """{key: (partner key, date, offset, tied, candidates)} of anchors (key, subject, day) and partners (key, subject, day, precision, size)."""
    out = {}
    for k, s, day in anchors:
        found = []
        for pk, ps, pday, prec, size in partners:
            if day is None or pday is None or s is None or s != ps:
                continue
            a, b = ((x - day).days for x in interval(pday, prec))
            inside = ((lo is None or a >= lo) and (hi is None or b <= hi)) if strict else ((lo is None or b >= lo) and (hi is None or a <= hi))
            if inside:
                o = a if a > 0 else b if b < 0 else 0
                n = pday.toordinal()
                order = {"nearest": (abs(o), n if tie == "earlier" else -n), "first": (n,), "any": (n,), "last": (-n,), "best": (-size, pk % 3)}[policy]
                found.append((order, pk, pday, o))
        if found:
            best = min(found)
            out[k] = (*best[1:], sum(f[0] == best[0] for f in found) > 1, len(found))
    return out


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    day = lambda: D(2019, 11, 1) + dt.timedelta(rng.choice([rng.randrange(900), 30 * rng.randrange(30), 0]))
    anchors = [(i, rng.choice([1, 2, 3, None]), None if i % 29 == 0 else day()) for i in range(150)]
    partners = [(1000 + i, rng.choice([1, 2, 3, 4, None]), None if i % 31 == 0 else day(), rng.choice(["day", "month", "year", None, "other"]), rng.randrange(5)) for i in range(120)]
    a = spark.createDataFrame(anchors, "k int, s int, day date").cache()
    p = spark.createDataFrame(partners, "pk int, s int, day date, prec string, size int").withColumn("third", F.col("pk") % 3).cache()
    return anchors, partners, a, p


WINDOWS = [(-40, 40), (None, 0), (0, None), (None, None), (10, 60), (-90, -20), (-3, 20), (None, -30), (15, None), (-400, 400), (0, 0)]


def got(df):
    return {r["k"]: (r["near_key"], r["near_date"], r["near_offset"], r["near_tied"], r["near_candidates"]) for r in df.collect()}


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize(("policy", "tie"), [("nearest", "earlier"), ("nearest", "later"), ("first", "earlier"), ("last", "earlier")])
def test_coarse_partners(rows, policy, tie, strict):
    anchors, partners, a, p = rows
    some = WINDOWS[policy == "last" :: 3 - strict]
    parts = [S.near(a, p, key="k", subject="s", day="day", partner_key="pk", partner_day="day", lo=lo, hi=hi, policy=policy, tie=tie, precision="prec", strict=strict, keep=["size"]).withColumn("w", F.lit(i)) for i, (lo, hi) in enumerate(some)]
    for i, (lo, hi) in enumerate(some):
        want = brute(anchors, partners, lo, hi, policy, tie, strict)
        assert got(parts[i]) == want, (lo, hi)


@pytest.mark.parametrize(("lo", "hi"), WINDOWS[:3] + WINDOWS[3:11:2])
def test_best(rows, lo, hi):
    anchors, partners, a, p = rows
    days = [(*x[:3], "day", x[4]) for x in partners]
    want = brute(anchors, days, lo, hi, "best", "earlier", False)
    how = dict(key="k", subject="s", day="day", partner_key="pk", partner_day="day", lo=lo, hi=hi, policy="best")
    assert got(S.near(a, p, best=[("size", True), ("third", False)], **how)) == want
    assert got(S.near(a, p, best=[(lambda x, y: y("size"), True), ("third", False)], **how)) == want
    assert S.near(a, p, best=[("size", True)], optional=True, **how).count() == len(anchors)


def test_best_of_both_sides(rows):
    anchors, partners, a, p = rows
    out = S.near(a, p, key="k", subject="s", day="day", partner_key="pk", partner_day="day", lo=-100, hi=100, policy="best", best=[(lambda x, y: F.abs(x("k") % 5 - y("size")), False)], bucket=50)
    subject = {pk: s for pk, s, *_ in partners}
    size = {x[0]: x[4] for x in partners}
    for r in out.collect():
        pool = [x for x in partners if x[1] == r["s"] and x[2] and abs((x[2] - r["day"]).days) <= 100]
        assert subject[r["near_key"]] == r["s"] and len(pool) == r["near_candidates"]
        assert abs(r["k"] % 5 - size[r["near_key"]]) == min(abs(r["k"] % 5 - x[4]) for x in pool)


def test_a_hot_subject_forms_no_pairs(spark):
    """A third of the rows in one subject, on few days: pairs would be hundreds of millions."""
    n = 60_000
    base = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id")).alias("s"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 50).cast("int")).alias("day"), F.when(F.col("id") % 2 == 0, "month").otherwise("day").alias("prec"), (F.col("id") % 97).alias("size"))
    how = dict(key="k", subject="s", day="day", partner_key="k", partner_day="day", lo=-10, hi=10)
    for out in (S.near(base, base, precision="prec", **how), S.near(base, base, precision="prec", strict=True, policy="last", **how), S.near(base, base, policy="best", best=[("size", True)], **how)):
        hot = out.filter("s = 0")
        assert hot.agg(F.max("near_candidates")).first()[0] > 1000
        for r, k in itertools.product(hot.filter("k < 30").collect(), ["near_key"]):
            assert r[k] % 3 == 0
    best = S.near(base, base, policy="best", best=[("size", True)], **how).filter("k = 0").first()
    pool = [i for i in range(0, n, 3) if i % 50 <= 10]
    top = max(i % 97 for i in pool)
    assert best["near_key"] == min(i for i in pool if i % 97 == top) and best["near_candidates"] == len(pool)
