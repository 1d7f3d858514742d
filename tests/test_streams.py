"""Streams of several batches: late, repeated and out-of-order rows, a restart from the checkpoint, equality with the batch operators."""

from __future__ import annotations

import collections
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.operators.timelines import sessions
from corvane.streaming import arrivals as A

D = dt.date
SCHEMA = "s long, kind string, day date"


class Folder:
    """Rows arrive as files, one a batch, in the order in which they are written."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, str(path)
        self.like = spark.createDataFrame([], SCHEMA)

    def arrive(self, rows):
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return A.read_stream(self.spark, self.like, self.path, files_per_batch=1)


@pytest.fixture
def folder(spark, tmp_path):
    return Folder(spark, tmp_path / "in")


def day(n):
    return D(2020, 1, 1) + dt.timedelta(n)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_sessions_of_many_batches(spark, folder, tmp_path):
    """Each file brings later days, some of the last 40 days again; sessions are let go on the way and the run is taken up twice."""
    rng = random.Random(3)
    where = {"path": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    held = []
    for part in range(6):
        new = [(rng.randrange(4), "a", day(50 * part + rng.randrange(-40, 50))) for _ in range(60)] + [(9, "hot", day(50 * part))] * 100
        new += new[:5] + [(5, "none", None)] + [(None, "x", day(50 * part))]
        held += new
        folder.arrive(new)
        if part in (1, 3, 5):
            got = A.keep_sessions(folder.stream(), "s", "day", 20, "120 days", **where)
            assert rows_of(got.filter("s is not null")) == rows_of(sessions(spark.createDataFrame(held, SCHEMA), "s", "day", 20).filter("s is not null"))
    every = spark.read.option("basePath", where["path"]).parquet(where["path"])
    assert every.select("batch").distinct().count() >= 6
    assert every.filter("final").count() > 0
    assert rows_of(every.filter("final").groupBy("s", "session_first").count().filter("count > 1")) == []


def test_late_rows_are_dropped(spark, folder, tmp_path):
    where = {"path": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    for rows in ([(1, "a", day(0)), (1, "a", day(5))], [(2, "a", day(400))], [(1, "late", day(3)), (1, "new", day(390))], [(2, "a", day(401))]):
        folder.arrive(rows)
        got = A.keep_sessions(folder.stream(), "s", "day", 20, "30 days", **where)
    assert rows_of(got) == [(1, day(0), day(5), 2), (1, day(390), day(390), 1), (2, day(400), day(401), 2)]


def test_copies_over_batches_and_a_restart(folder, tmp_path):
    where = {"path": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    rng = random.Random(4)
    held = []
    for part in range(4):
        new = [(rng.randrange(6), rng.choice("ab"), day(10 * part + rng.randrange(-20, 10))) for _ in range(30)] + [(77, "h", day(10 * part))] * 50
        held += new
        folder.arrive(new)
        if part % 2:
            got = A.count_copies(folder.stream(), ["s", "kind"], "day", "100 days", **where).collect()
            want = collections.Counter((s, k) for s, k, _ in held)
            assert {(r["s"], r["kind"]): r["copies"] + 1 for r in got} == want and len(got) == len(want)
            assert all(r["first_seen"].date() == min(d for s, k, d in held if (s, k) == (r["s"], r["kind"])) for r in got)


def test_an_identity_let_go_starts_over(folder, tmp_path):
    where = {"path": str(tmp_path / "out"), "state": str(tmp_path / "state")}
    for rows in ([(1, "a", day(0))] * 3, [(2, "a", day(300))], [(2, "a", day(301))], [(1, "a", day(302))] * 2):
        folder.arrive(rows)
        got = A.count_copies(folder.stream(), ["s", "kind"], "day", "10 days", **where)
    assert sorted((r["s"], r["first_seen"].date(), r["copies"]) for r in got.collect()) == [(1, day(0), 2), (1, day(302), 1), (2, day(300), 1)]


def test_first_seen_and_report(folder):
    for part in range(3):
        folder.arrive([(i % 5, "ab"[i % 2], day(i)) for i in range(part, part + 20)])
    assert A.to_table(A.first_seen(folder.stream(), ["s", "kind"], "day", "900 days").select("s", "kind")).count() == 10
    report = A.to_table(A.running_report(folder.stream(), ["kind"]), "complete")
    assert rows_of(report) == [("a", 30), ("b", 30)]
    assert report.agg(F.sum("rows")).first()[0] == 60
