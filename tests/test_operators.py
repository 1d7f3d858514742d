"""Planted rows for the corners that the tables do not hold."""

from __future__ import annotations

import datetime as dt
import hashlib
import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import scalars as X
from corvane.operators import derive, identity, models, outputs, release, review, rules, sets, timelines


def day(n: int) -> dt.date:
    return dt.date(2020, 1, 1) + dt.timedelta(days=n)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def one(df):
    return df.collect()[0]


def test_sessions_are_bounded_by_their_first_day(spark):
    df = spark.createDataFrame([(1, day(n)) for n in (0, 6, 12)], "s int, d date")
    assert rows(timelines.sessions(df, "s", "d", 7)) == [(1, day(0), day(6), 2), (1, day(12), day(12), 1)]


def near(spark, partners, **how):
    a = spark.createDataFrame([(1, 1, day(10))], "k int, s int, d date")
    b = spark.createDataFrame(partners, "k int, s int, d date, p string")
    return sets.near(a, b, key="k", subject="s", day="d", partner_key="k", partner_day="d", **how).collect()


def test_near_ties_edges_and_none(spark):
    both = [(7, 1, day(7), "day"), (8, 1, day(13), "day")]
    assert near(spark, both, lo=-5, hi=5)[0]["near_key"] == 7
    assert near(spark, both, lo=-5, hi=5, tie="later")[0]["near_key"] == 8
    assert near(spark, both, lo=-3, hi=3)[0]["near_candidates"] == 2  # both edges count
    assert near(spark, both, lo=-2, hi=2) == []
    assert near(spark, both, lo=-2, hi=2, optional=True)[0]["near_key"] is None
    assert near(spark, [(7, 1, day(7), "day"), (9, 1, day(7), "day")], lo=-5, hi=5)[0]["near_tied"]


def test_near_coarse_date_forgiving_and_strict(spark):
    year = [(7, 1, dt.date(2020, 6, 1), "year")]
    assert near(spark, year, lo=-5, hi=5, precision="p")[0]["near_offset"] == 0
    assert near(spark, year, lo=-5, hi=5, precision="p", strict=True) == []


def test_near_bucketed_is_the_same(spark):
    a = spark.createDataFrame([(i, i % 3, day(i * 7 % 50)) for i in range(40)], "k int, s int, d date")
    how = dict(key="k", subject="s", day="d", partner_key="k", partner_day="d", lo=-9, hi=4)
    assert rows(sets.near(a, a, **how)) == rows(sets.near(a, a, bucket=5, **how))


@pytest.mark.parametrize(("values", "adjacent", "found"), [("AB", True, True), ("ACB", True, False), ("ACB", False, True), ("BA", False, False)])
def test_change(spark, values, adjacent, found):
    df = spark.createDataFrame([(1, day(i // 2), i, v) for i, v in enumerate(values)], "s int, d date, k int, v string")
    assert bool(sets.change(df, "s", "d", "k", "v", "A", "B", adjacent).count()) is found


def test_subject_of_two_cohorts_counts_once_and_closed_intervals_do_not(spark):
    subjects = spark.createDataFrame([(1,), (2,)], "s int")
    members = spark.createDataFrame([(1, 1, None), (1, 2, None), (2, 1, day(1))], "s int, c int, left date")
    cohorts = spark.createDataFrame([(1,), (2,)], "c int")
    assert rows(sets.in_cohorts(subjects, members, cohorts, "s", "c", "left")) == [(1,)]


def test_union_fills_what_the_right_lacks(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1,), (2,)], "k int")
    assert rows(sets.union(a, b)) == rows(spark.createDataFrame([(1, "x"), (1, None), (2, None)], "k int, v string"))


def test_refused_ties(spark):
    df = spark.createDataFrame([(1, 1, 5), (2, 1, 5), (3, 2, 5)], "k int, p int, v int")
    assert [r["k"] for r in sets.pick(df, "p", [F.desc("v")], "k", ties="refuse").collect()] == [3]


@pytest.mark.parametrize(("a", "b", "months"), [("2021-01-31", "2021-02-28", 0), ("2021-01-31", "2021-03-01", 1), ("2021-03-01", "2021-01-31", -2), ("2021-03-01", "2021-02-28", -1)])
def test_whole_months(spark, a, b, months):
    d = lambda x: F.lit(x).cast("date")
    assert one(spark.range(1).select(X.months_between(d(a), d(b))))[0] == months


def test_age_of_a_leap_day(spark):
    d = lambda x: F.lit(x).cast("date")
    r = one(spark.range(1).select(X.age_at(d("2000-02-29"), d("2021-02-28")), X.age_at(d("2000-02-29"), d("2021-03-01"))))
    assert tuple(r) == (20, 21)


def test_coarse_comparison(spark):
    c = lambda op, s: X.coarse_compare(op, F.lit("2020-01-01").cast("date"), F.lit("year"), F.lit("2020-06-15").cast("date"), s)
    some = one(spark.range(1).select(*[c(op, False) for op in ("<", ">", "=")], *[c(op, True) for op in ("<", ">", "=")]))
    assert tuple(some) == (True, True, True, False, False, False)


def test_small_counts_and_complement(spark):
    grid = spark.createDataFrame([("a", 3), ("b", 9), ("c", 0), ("d", 20)], "k string, n int")
    out = {r["k"]: r["shown"] for r in outputs.suppress(grid, ["k"], "n", "shown").collect()}
    assert out == {"a": None, "b": None, "c": 0, "d": 20}
    for counts, left in (((1, 1, 40), set()), ((3, 0), set()), ((1, 1, 6, 40), {40}), ((9, 40), {9, 40})):
        grid = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "k string, n int")
        assert {r["shown"] for r in outputs.suppress(grid, ["k"], "n", "shown").collect()} - {None} == left
    assert one(spark.range(1).select(*[outputs.held(F.lit(n)) for n in (0, 1, 4, 5)])) == (0, None, None, 5)


def test_one_pass_funnel_equals_staged(spark):
    df = spark.range(100).withColumn("s", F.col("id") % 7)
    steps = {"even": F.col("id") % 2 == 0, "big": F.col("id") > 40, "third": F.col("id") % 3 == 0}
    got = {r["name"]: (r["rows"], r["subjects"]) for r in outputs.funnel(df, "s", steps).collect()}
    d = df
    for name, c in steps.items():
        d = d.filter(c)
        assert got[name] == (d.count(), d.select("s").distinct().count())


def test_positions_within_tolerance(spark):
    df = spark.createDataFrame([(1, 12.5), (1, 12.499999), (1, 15.0)], "k int, x double")
    assert one(derive.positions(df, "k", "x"))["n_positions"] == 2


def test_neighbour_vote_ties_are_silent_and_zero_is_absent(spark):
    ref = spark.createDataFrame([(5.0, 1.0, "a")] * 3 + [(25.0, 1.0, "a")] * 3 + [(25.0, 1.0, "b")] * 3 + [(45.0, 0.0, "z")] * 3, "x double, y double, ans string")
    asked = spark.createDataFrame([(1, 5.0, 1.0), (2, 25.0, 1.0), (3, 45.0, 1.0), (4, 45.0, 0.0)], "k int, x double, y double")
    got = {r["k"]: (r["voted"], r["method"]) for r in rules.neighbour_vote(asked, ref, "k", {"x": 10, "y": 1}, "ans").collect()}
    assert got == {1: ("a", "exact_bin"), 2: (None, "tie"), 3: (None, "no_match"), 4: ("z", "exact_bin")}


def test_neighbour_vote_passes_over_what_does_not_fit_and_asks_its_own_partition_first(spark):
    ref = [(20.0, "a", "one")] * 4 + [(20.0, "b", "one")] * 3 + [(20.0, "c", "two")] * 9 + [(40.0, "d", "two")] * 2
    ref = spark.createDataFrame(ref, "x double, ans string, site string")
    asked = spark.createDataFrame([(1, 20.0, "one", "p"), (2, 20.0, "one", "q"), (3, 40.0, "one", "p"), (4, 40.0, "two", "p"), (5, 20.0, "new", "p"), (6, 90.0, "one", "p"), (7, 11.0, "one", "p"), (8, 20.0, "two", "r")], "k int, x double, site string, s string")
    fits = lambda s, a: ~((s == "q") & (a == "a")) & (s != "r")
    got = rules.neighbour_vote(asked, ref, "k", {"x": ("ceil", 10)}, "ans", partition="site", subject="s", fits=fits, alone=["one"])
    got = {r["k"]: (r["voted"], r["method"], r["scope"]) for r in got.collect()}
    assert got[1] == ("a", "exact_bin", "scoped") and got[2] == ("b", "exact_bin", "scoped")
    assert got[3] == (None, "no_match", "scoped")  # its partition asks no other
    assert got[4] == (None, "insufficient_matches", "global") and got[5] == ("c", "exact_bin", "global")
    assert got[6] == (None, "no_match", "scoped") and got[7] == ("a", "exact_bin", "scoped") and got[8] == (None, "no_compatible_match", "global")


def test_half_bins_round_to_even(spark):
    ref = spark.createDataFrame([(15.0, "a")] * 3, "x double, ans string")
    asked = spark.createDataFrame([(1, 25.0), (2, 35.0), (3, 5.0)], "k int, x double")
    got = {r["k"]: r["method"] for r in rules.neighbour_vote(asked, ref, "k", {"x": 10}, "ans").collect()}
    assert got == {1: "exact_bin", 2: "no_match", 3: "no_match"}


def test_ordered_rules(spark):
    df = spark.createDataFrame([("red big",), ("red",), ("none",), (None,)], "t string")
    rs = [rules.Rule("1", "a", "x", {"token": ("t", "big")}), rules.Rule("2", "a", "y", {"token": ("t", "red")}, "name"), rules.Rule("3", "b", "of x", {"is": ("a", "x")})]
    assert [(r["a"] and r["a"]["value"], r["b"] and r["b"]["value"]) for r in rules.classify(df, rs).collect()] == [("x", "of x"), ("y", None), (None, None), (None, None)]


def test_bracket(spark):
    df = spark.createDataFrame([(1, 1, -1), (1, 2, None), (1, 3, 1), (1, 4, None), (2, 1, 1), (2, 2, -1)], "g int, at int, sign int")
    df = df.union(spark.createDataFrame([(1, 0, None), (2, 3, None), (3, 5, None)], df.schema)).withColumn("n", F.col("at")).withColumn("region", F.lit(None).cast("string")).withColumn("day", F.lit(1))
    no = F.lit(False)
    how = dict(trusted=F.lit(True), bolus=no, region="region", day="day", untimed=no, model=no, tagged=no, split_gap=10)
    got = {(r["g"], r["at"]): (r["label"], r["reason"]) for r in rules.bracket(df, "g", "at", "sign", "n", **how).collect()}
    assert got == {(1, 0): ("pre", None), (1, 1): ("pre", None), (1, 2): (None, "window"), (1, 3): ("post", None), (1, 4): ("post", None), (2, 1): ("post", None), (2, 2): ("pre", None), (2, 3): (None, "crossed"), (3, 5): (None, "no_answer")}
    bolus = rules.bracket(df, "g", "at", "sign", "n", **(how | {"bolus": (F.col("g") == 1) & (F.col("at") == 0)}))
    assert {(r["at"], r["label"], r["reason"]) for r in bolus.filter("g = 1 and sign is null").collect()} == {(0, None, "C3_bolus_before_last"), (2, None, "window"), (4, None, "C3_bolus_before_last")}


def test_draw_ignores_order(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    assert rows(review.draw(df, "s", "w", "k", share=0.1)) == rows(review.draw(df.orderBy(F.desc("k")), "s", "w", "k", share=0.1))
    assert review.draw(df, "s", "w", "k", share=0.1).count() == 20


def test_exact_bound(spark):
    df = spark.createDataFrame([(0, 299), (5, 5), (0, 0)], "k int, n int").select(review.upper_bound(F.col("k"), F.col("n")).alias("b"))
    b = [r["b"] for r in df.collect()]
    assert 0.0099 < b[0] < 0.01 and b[1:] == [1.0, 1.0]


def test_identifier_map_chain_and_conflict(spark):
    df = spark.createDataFrame([(1, "A", None, "p"), (2, "A", "x", "p"), (3, "C", "x", "q"), (4, "D", "y", None), (5, None, " ", "r")], "r int, a string, b string, code string")
    subjects, conflicts, report = identity.identifier_map(df, "r", ["a", "b"], "code")
    assert rows(subjects) == [(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)]
    assert rows(conflicts) == [(3, "repeated"), (5, "empty")]
    assert rows(report) == [(3, 2, False)]
    known = spark.createDataFrame([("a", "A", "p"), ("b", "x", "z"), ("a", "D", "t")], "type string, value string, subject string")
    merged = spark.createDataFrame([("q", "p")], "code string, into string")
    conflicts, report = identity.identifier_map(df, "r", ["a", "b"], "code", known, merged)[1:]
    assert rows(conflicts) == [(2, "mapped"), (2, "two subjects"), (3, "mapped"), (3, "merged"), (3, "repeated"), (5, "empty")]
    assert one(report)["known"] == 2


def test_number_check(spark):
    df = spark.createDataFrame([("811218-9876",), ("811218-9875",), ("811318-9876",), ("81",), ("111218+9878",), (None,)], "x string")
    number, reason = identity.check_number(F.col("x"), dt.date(2024, 6, 15))
    got = [tuple(r) for r in df.select(number, reason).collect()]
    more = spark.createDataFrame([("701063-2391",), ("240614-0007",), ("240616-0005",)], "x string").select(number, reason).collect()
    assert [r[0][:8] for r in more if r[0]] == ["19701063", "20240614", "19240616"][: sum(r[0] is not None for r in more)]
    assert got[0] == ("198112189876", None) and [g[1] for g in got[1:4]] == ["check digit", "date", "form"] and got[5][1] == "missing"


def test_keyed_blake_code(spark):
    got = one(spark.createDataFrame([("v",)], "x string").select(identity.blake_code("k", F.col("x"))))[0]
    assert got == hashlib.blake2b(b"v", key=b"k", digest_size=10).hexdigest()


def test_natural_order(spark):
    df = spark.createDataFrame([(1, "s10"), (1, "s9"), (1, "s09")], "g int, l string")
    assert {r["l"]: r["place"] for r in identity.natural_places(df, "g", "l").collect()} == {"s9": 1, "s09": 1, "s10": 2}


def test_repeat_needs_every_pair(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.015), ("a", 1.03), ("b", 1.0), ("b", None)], "g string, t double")
    got = {r["g"]: r["repeat"] for r in release.repeats(df, ["g"], {"t": 0.02}, {}, []).collect()}
    assert got == {"a": False, "b": True}


def test_version_changes(spark):
    old = spark.createDataFrame([(1, "d", "p"), (2, "d", "p"), (3, "d", "p"), (4, "d", "p")], "k int, d string, p string")
    new = spark.createDataFrame([(1, "d", "p"), (2, "d", "q"), (3, "e", "p"), (5, "d", "p")], "k int, d string, p string")
    assert rows(release.versions(old, new, "k", "d", "p")) == [(1, "unchanged"), (2, "moved"), (3, "rewritten"), (4, "removed"), (5, "added")]


def settled(spark, months, how, relax=True, cadence=(0, 6, 12), tolerance=3.5):
    df = spark.createDataFrame([(1, day(i), m) for i, m in enumerate(months)], "s int, d date, m double")
    return [(r["label"], r["flagged"]) for r in timelines.settle(df, "s", "d", "m", list(cadence), tolerance, how, relax).orderBy("d").collect()]


def test_sessions_that_want_one_label(spark):
    assert settled(spark, [5.0, 6.1], "date", relax=False) == [(None, True), (None, True)]
    assert settled(spark, [5.0, 6.1], "merge", relax=False) == [("M06", False), ("M06", False)]
    assert settled(spark, [5.0, 6.1], "demote", relax=False) == [("M05", True), ("M06", False)]
    assert settled(spark, [6.2, 6.1], "demote", relax=False) == [(None, True), ("M06", False)]
    assert settled(spark, [6.2, 6.1, 6.3], "suffix", relax=False) == [("M06b", True), ("M06", False), ("M06c", True)]
    assert settled(spark, [8.9, 6.1], "date") == [("M12", False), ("M06", False)]  # the free point in reach
    assert settled(spark, [-6.2, -5.9, 6.0], "suffix") == [("PRE06", False), ("PRE06b", True), ("M06", False)]
    assert settled(spark, [20.2, -0.3, None], "date") == [("M20", False), ("M00", False), (None, False)]


def test_draw_ends_in_its_cell(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    want = sorted(range(3000), key=lambda i: hashlib.sha256(f"s:w:{i}".encode()).hexdigest())
    for n in (0, 1, 299, 3000, 4000):
        assert {r["k"] for r in review.draw(df, "s", "w", "k", count=n).collect()} == set(want[:n])
    assert review.draw(df.limit(0), "s", "w", "k", share=0.1).count() == 0


def test_duplicates_end_a_diverse_pick_and_its_choice_is_greedy(spark):
    df = spark.createDataFrame([(i, [float(i % 3 == k) for k in range(3)]) for i in range(12)], "k int, v array<double>")
    assert models.diverse(df, "k", "v", 9).count() == 3
    assert models.diverse(df.limit(0), "k", "v", 3).count() == 0


def test_numbers_of_groups_run_over_ranges(spark):
    df = spark.createDataFrame([(None if i % 11 == 0 else i % 40, i % 7) for i in range(400)], "a int, s int")
    got = rows(sets.group(df, ["a"], "s").select("_group", "a"))
    assert [r[1] for r in sorted(got)] == [*range(40), None]


def test_near_of_a_busy_subject_with_tied_days_and_timestamps(spark):
    anchors = spark.createDataFrame([(i, 1, day(i % 50)) for i in range(200)] + [(900, 2, day(3)), (901, 1, None)], "k int, s int, d date")
    partners = spark.createDataFrame([(i, 1, day(i * 3 % 60)) for i in range(300)], "k int, s int, d date")
    for policy in ("nearest", "first", "last"):
        for lo, hi in ((-5, 5), (2, 9), (-9, -2), (None, 0), (1, None)):
            how = dict(key="k", subject="s", day="d", partner_key="k", partner_day="d", lo=lo, hi=hi, optional=True)
            coarse = partners.withColumn("p", F.lit("day"))  # forms the pairs
            assert rows(sets.near(anchors, partners, policy=policy, **how)) == rows(sets.near(anchors, coarse, policy=policy, precision="p", **how))


def test_diverse_pick_spreads(spark):
    df = spark.createDataFrame([(i, [math.cos(i % 4 * 1.5) + i / 1e4, math.sin(i % 4 * 1.5)]) for i in range(40)], "k int, v array<double>")
    got = {r["k"] % 4 for r in models.diverse(df, "k", "v", 4).collect()}
    assert got == {0, 1, 2, 3}


def test_platt_orders_scores(spark):
    df = spark.createDataFrame([("s", i / 50.0, int(i + (i * 7 % 11) > 55)) for i in range(100)] + [("t", 0.5, 1)], "site string, x double, y int")
    fitted, left = models.platt(df, "site", "x", "y")
    assert one(fitted)["a"] > 0 and rows(left.select("site")) == [("t",)]


def test_empty_tables(spark):
    e = spark.createDataFrame([], "k int, s int, d date, v string")
    assert timelines.sessions(e, "s", "d", 7).count() == 0
    assert sets.change(e, "s", "d", "k", "v", "A", "B").count() == 0
    assert sets.near(e, e, key="k", subject="s", day="d", partner_key="k", partner_day="d", lo=-1, hi=1).count() == 0
