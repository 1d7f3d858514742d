"""The bracket's clock, derived and second-study checks on planted sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import rules

SCHEMA = "g int, subject int, n int, at double, sign int, series int, begins double, ends double, stale boolean, derived boolean, bolus boolean"


def session(g, subject=None, start=0.0, **changes):
    """Silent, negative, positive, silent: the first is pre, the last post.  changes: {number: {column: value}}."""
    rows = []
    for n, at, sign in ((10, 0.0, None), (20, 100.0, -1), (30, 200.0, 1), (40, 300.0, None)):
        row = dict(g=g, subject=subject or g, n=n, at=start + at, sign=sign, series=n, begins=start + at, ends=start + at + 50, stale=False, derived=False, bolus=False)
        rows.append(tuple((row | changes.get(f"r{n}", {})).values()))
    return rows


def labelled(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    how = dict(trusted=F.lit(True), bolus=F.col("bolus"), region="region", day="day", untimed=F.lit(False), model=F.lit(False), tagged=F.lit(False), split_gap=400)
    out = rules.bracket(df.withColumn("region", F.lit("head")).withColumn("day", F.lit(1)), "g", "at", "sign", "n", series="series", images=("begins", "ends"), content_early=F.col("stale"), derived=F.col("derived"), study=("subject", "at", 1440), **how)
    return {(r["g"], r["n"]): (r["label"], r["reason"], set(filter(None, r["flags"].split(",")))) for r in out.collect()}


def test_clock_checks(spark):
    rows = session(1) + session(2, r30={"stale": True}) + session(3, r40={"begins": 200.0}) + session(4, r10={"ends": 100.0}) + session(5, r20={"stale": True}) + session(6, r40={"stale": True})
    got = labelled(spark, rows)
    assert (got[1, 10], got[1, 20], got[1, 30], got[1, 40]) == (("pre", None, set()), ("pre", None, set()), ("post", None, set()), ("post", None, set()))
    assert got[2, 40][:2] == (None, "C5_content") and got[2, 10][0] == "pre" and got[2, 30][0] == "post"
    assert got[3, 40] == (None, "C5_straddle", {"C5_straddle"}) and got[3, 10][0] == "pre"
    assert got[4, 10] == (None, "C5_straddle", {"C5_straddle"}) and got[4, 40][0] == "post"
    assert got[5, 10][:2] == (None, "C5_content") and got[5, 40][0] == "post"
    assert got[6, 40] == (None, "C5_content", {"C5_content"})


def test_derived_rows(spark):
    got = labelled(spark, session(1, r40={"derived": True}) + session(2, r30={"derived": True}))
    assert got[1, 40] == (None, "C6_derived", {"C6_derived"}) and got[1, 10][0] == "pre"
    assert got[2, 30][:2] == (None, "C6_derived")  # its answer counts for nothing, so the last row is not post
    assert got[2, 40][0] is None and got[2, 10][0] == "pre"


def test_a_series_is_one_dose(spark):
    late = {"r40": {"bolus": True, "at": 900.0}}
    one = session(1, r30={"bolus": True, "series": 7}, **{"r40": late["r40"] | {"series": 7}})
    two = session(2, r30={"bolus": True}, **late)
    got = labelled(spark, one + two)
    assert "C4_split_session" not in got[1, 10][2] and "C4_split_session" in got[2, 10][2]


def test_second_studies(spark):
    rows = session(1, 5) + session(2, 5, 1400.0) + session(3, 5, 2840.0) + session(4, 6) + session(5, 7) + session(6, 7, 1440.0)
    got = labelled(spark, rows)
    assert {g for g in range(1, 7) if "C2_second_study" in got[g, 10][2]} == {1, 2}
