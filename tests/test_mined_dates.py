"""Days read out of values, unique ids and paths, and the vote over them."""

from __future__ import annotations

import datetime as dt
import random
import re

from pyspark.sql import functions as F

from corvane.operators import dates, timelines


def read(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_values(spark):
    texts = ["20220115", "2022-01-15", " 2022/01/15 ", "00000000", "19000101", "", None, "20221345", "20220230", "17000101", "20200229", "20210229", "202201155", "UNKNOWN", "21001231", "21010101", "19791231"]
    day = dt.date(2022, 1, 15)
    assert read(spark, dates.stated_day, texts) == [day, day, day, None, None, None, None, None, None, None, dt.date(2020, 2, 29), None, None, None, dt.date(2100, 12, 31), None, None]


def test_runs_within(spark):
    texts = ["1.2.826.0.1.3680043.8.498.10.4.20220519.1", "1.2.826.20221345.1", "1.2.826.202205191234.1", "1.2.840.113619.2.55.3.12869.1572249167.550", "1.2.840.9999999999.1", "/a/20220519/20220519_20190101.dcm", "", None]
    assert read(spark, dates.days_within, texts) == [[dt.date(2022, 5, 19)], [], [], [], [], [dt.date(2022, 5, 19), dt.date(2022, 5, 19), dt.date(2019, 1, 1)], [], None]
    assert read(spark, dates.epochs_within, texts) == [[], [], [], [dt.date(2019, 10, 28)], [], [], [], None]


def test_runs_against_plain_reading(spark):
    rng = random.Random(5)
    piece = lambda: rng.choice([str(rng.randrange(10**8, 10**10)), f"{rng.randrange(1975, 2105)}{rng.randrange(0, 14):02d}{rng.randrange(0, 33):02d}", "x", str(rng.randrange(10**9))])
    texts = ["".join(piece() + rng.choice(["", ".", "_", "/"]) for _ in range(6)) for _ in range(600)]

    def plain(text):
        days, epochs = [], []
        for run in re.findall(r"[0-9]+", text):
            if len(run) == 8:
                try:
                    days.append(dt.date(int(run[:4]), int(run[4:6]), int(run[6:])))
                except ValueError:
                    pass
            if len(run) == 10:
                epochs.append((dt.datetime(1970, 1, 1) + dt.timedelta(seconds=int(run))).date())
        return tuple([d for d in found if 1980 <= d.year <= 2100] for found in (days, epochs))

    want = [plain(t) for t in texts]
    assert sum(len(a) for a, _ in want) > 100 and sum(len(b) for _, b in want) > 50
    assert read(spark, dates.days_within, texts) == [a for a, _ in want]
    assert read(spark, dates.epochs_within, texts) == [b for _, b in want]


def vote(spark, rows):
    """rows: (key, stated, created, uid)."""
    df = spark.createDataFrame(rows, "k int, stated string, created string, uid string")
    readings = [dates.Reading("stated", 2, F.col("stated")), dates.Reading("created", 3, F.col("created")), dates.Reading("uid", 1, F.col("uid"), "days"), dates.Reading("uid_epoch", 1, F.col("uid"), "epochs")]
    out = timelines.vote_dates(dates.candidates(df, "k", readings), "k", "day", "weight", source="source")
    return {r["k"]: (str(r["voted"]), r["weight"], r["margin"], r["source"]) for r in out.collect()}


def test_votes(spark):
    got = vote(spark, [
        (1, "20230301", None, None), (1, "20230301", None, "1.20230415.2"),  # two rows outweigh one id
        (2, "20220615", "20220101", None),  # a first of January loses to any other day
        (3, None, "20220101", None),  # and wins alone
        (4, "20220301", None, None), (4, "20220115", None, None),  # the earlier of equals
        (5, "00000000", None, "1.2.826.0.1"),  # nothing named
        (6, "20220115", "20220115", "1.1642204800.20220115"),  # 2022-01-15 as seconds too
    ])
    assert got == {1: ("2023-03-01", 4.0, 3.0, "stated"), 2: ("2022-06-15", 2.0, -1.0, "stated"), 3: ("2022-01-01", 3.0, 3.0, "created"), 4: ("2022-01-15", 2.0, 0.0, "stated"), 6: ("2022-01-15", 7.0, 7.0, "created")}


def test_empty_and_busy_keys(spark):
    assert vote(spark, []) == {}
    rows = [(1, f"2001{1 + i % 12:02d}05", None, "20010305") for i in range(3000)] + [(2, "20010101", None, None)]
    assert vote(spark, rows) == {1: ("2001-03-05", 3500.0, 3000.0, "stated"), 2: ("2001-01-01", 2.0, 2.0, "stated")}


def test_reading_needs_no_shuffle(spark):
    df = spark.createDataFrame([(1, "20220115")], "k int, t string")
    plan = dates.candidates(df, "k", [dates.Reading("t", 1, F.col("t"), "days")])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
