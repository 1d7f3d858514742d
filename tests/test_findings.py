"""Faults found by running the queries on odd inputs and larger tables."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import functions as F

from corvane.operators import outputs as O
from corvane.operators import review as V
from corvane.operators import rules as R
from corvane.operators import sets as S
from corvane.operators.timelines import sessions
from corvane.plans import storage
from corvane.queries import QUERIES
from corvane.streaming import arrivals as A


def test_a_filter_on_an_answer_does_not_repeat_its_formula(spark):
    rules = [R.Rule(f"r{i}", axis, f"v{i}", {"above": ("n", i)} if axis == "a" else {"count": {"of": [{"is": ("a", f"v{i}")}, {"below": ("n", i + 3)}], "least": 1}}) for axis in "ab" for i in (5, 3, 1)]
    out = R.classify(spark.range(8).select(F.col("id").alias("n")), rules).select("n", F.col("a.value").alias("a"), F.col("b.value").alias("b")).filter("a is not null and b is not null")
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 20_000
    assert [tuple(r) for r in out.orderBy("n").collect()] == [(2, "v1", "v5"), (3, "v1", "v5"), (4, "v3", "v5"), (5, "v3", "v5"), (6, "v5", "v5"), (7, "v5", "v5")]


def test_a_column_that_holds_nothing_back_is_reported(spark):
    rows = spark.createDataFrame([(1, None), (2, 7)], "shown int, other int")
    assert sorted(map(tuple, O.held_report(rows, ["shown", "other"]).collect())) == [("other", 1), ("shown", 0)]


def _decided(spark, rows):
    return spark.createDataFrame([(1, "x", v, "person", "stack", "2020-01-01", 5, True, False) for v in rows], "unit int, axis string, value string, author string, scope string, decided_at string, decision_id int, committed boolean, withdrawn boolean").coalesce(1)


def test_rows_of_one_decision_give_one_answer_in_any_order(spark):
    got = [V.in_force(_decided(spark, rows), "unit", "axis").first()["value"] for rows in ("ab", "ba", "bab", "aab")]
    assert got == ["b"] * 4


def test_equally_new_suggestions_of_an_author(spark):
    rows = [(1, 1, v, 7, -i) for i, v in enumerate("bca")] + [(2, 1, "a", 7, -9), (2, 2, "b", 7, -10)]
    for order in (rows, rows[::-1]):
        got = V.suggestions(spark.createDataFrame(order, "item int, author int, v string, at int, first int").coalesce(1), "item", "author", "v", "at", "first")
        assert sorted(map(tuple, got.collect())) == [(1, "b", False), (2, "b", True)]


def test_streams_call_python_by_group_and_not_by_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(A, "GROUPS", 2)
    rows = [(k, d) for i, k in enumerate(['a"b', "", None, "null", "é\\", *map(str, range(20))]) for d in range(0, 90 + i, 30)]
    df = spark.createDataFrame(rows, "k string, d int").select("k", F.date_add(F.lit("2020-01-01").cast("date"), F.col("d")).alias("day"))
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = lambda: A.read_stream(spark, df, str(tmp_path / "in"), files_per_batch=1)
    want = sorted((str(k), n) for k, n in Counter(k for k, _ in rows).items())
    got = A.count_copies(stream(), ["k"], "day", "900 days", state=str(tmp_path / "state")).collect()
    assert sorted((str(r["k"]), r["copies"] + 1) for r in got) == want
    out = A.keep_sessions(stream(), "k", "day", 45, "900 days")
    assert sorted(map(str, out.collect())) == sorted(map(str, sessions(df, "k", "day", 45).select(out.columns).collect()))


def test_parts_grow_with_rows(spark, monkeypatch):
    monkeypatch.setattr(storage, "PART_ROWS", 10)
    df = spark.range(200).withColumn("s", F.col("id") % 60)
    assert storage.dealt(df, 200, "s").rdd.getNumPartitions() == 20 and storage.dealt(df, 30, "s") is df
    days = df.select("id", "s", F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("day"))
    out = S.pairs(days, "id", "s", "day", 1, 365).select("id", "later_key")
    assert sorted(map(tuple, out.collect())) == [(i, i + 60) for i in range(140)]


def test_all_borders_put_order_lines_together_once(spark):
    folder = "/root/testdata/sf0.001"
    assert "_linenumber" not in QUERIES["pick_5_all_borders"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
