"""Names made unique until none is shared: own suffixes, names that meet settled ones, a hot name; suffixes past z."""

from __future__ import annotations

import random

import pytest

from corvane.operators import release, timelines

SCHEMA = "g int, k int, nm string, echo int, ti double, p string, q string, own string"


def named(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = release.disambiguate(df, ["g"], "nm", "k", "echo", "ti", [("p", "p"), ("q", "q")], own="own").collect()
    assert len(out) == len(rows) and len({(r["g"], r["unique_name"]) for r in out}) == len(rows)
    return {(r["g"], r["k"]): r["unique_name"] for r in out}


def test_rounds(spark):
    rows = [(1, 1, "a", 1, None, None, None, None), (1, 2, "a", 2, None, None, None, None), (1, 3, "b", None, None, None, None, "e9"), (1, 4, "c", 7, None, None, None, None)]
    rows += [(2, 1, "a", None, 3.0, "x", None, None), (2, 2, "a", None, 1.0, "x", None, None), (2, 3, "b", None, 1.0, "X", "u", None), (2, 4, "b", None, 1.0, "x", "v", None), (2, 5, "b", None, None, "y", None, None)]
    rows += [(3, i, "n", None, None, "same", None, None) for i in range(4)]
    got = named(spark, rows)
    assert [got[1, k] for k in (1, 2, 3, 4)] == ["a_e1", "a_e2", "b_e9", "c"]
    assert (got[2, 1], got[2, 2]) == ("a_ti2", "a_ti1")
    assert [got[2, k] for k in (3, 4, 5)] == ["b_px_qu", "b_px_qv", "b_py"]
    assert [got[3, k] for k in range(4)] == ["n_1", "n_2", "n_3", "n_4"]


def test_new_names_meet_settled_ones(spark):
    """A counter makes a name that stood there already; both go on until none is shared."""
    rows = [(1, 1, "n", None, None, None, None, None), (1, 2, "n", None, None, None, None, None), (1, 3, "n_1", None, None, None, None, None), (1, 4, "n_1_1", None, None, None, None, None), (1, 5, "n_2_1", None, None, None, None, None)]
    rows += [(None, 1, "m", None, None, None, None, None), (None, 2, "m", None, None, "w", None, None), (1, 6, "m", None, None, None, None, None)]
    got = named(spark, rows)
    assert got[1, 6] == "m" and {got[None, 1], got[None, 2]} == {"m", "m_pw"}


def test_a_hot_name(spark):
    rows = [(1, i, "hot", None, None, "p" if i % 2 else "o", None, None) for i in range(100_000)] + [(1, -1, "cold", None, None, None, None, None)]
    got = named(spark, rows)
    assert got[1, 1] == "hot_pp_1" and got[1, 99_998] == "hot_po_50000" and got[1, -1] == "cold"


@pytest.mark.parametrize("n", [30, 60])
def test_suffixes_past_z(spark, n):
    rows = [(1, f"2020-01-{1 + i % 28:02d}", round(6 + i / 1000, 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "s int, d string, m double").selectExpr("s", "cast(d as date) + cast(m * 1000 - 6000 as int) * 40 as d", "m")
    got = [r["label"] for r in timelines.settle(df, "s", "d", "m", [0, 6], 1.0, "suffix", relax=False).collect()]
    letters = "abcdefghijklmnopqrstuvwxyz"
    assert sorted(got) == sorted(["M06"] + [f"M06{x}" for x in [*letters[1:], *(a + b for a in letters for b in letters)][: n - 1]])


def test_small_groups_are_settled_where_they_lie(spark, monkeypatch):
    """In place or round by round, names are the same; in place few tables are stored, however many rounds a group takes."""
    rng = random.Random(5)
    pick = lambda *of: rng.choice([None, *of])
    rows = [(pick(1, 2, *range(3, 30)), i, rng.choice(["n", "n_1", "m"]), pick(1, 2), pick(1.0, 2.0, float("nan")), pick("x", "y"), pick("u"), pick("e9")) for i in range(200)]
    rows.append((1, 900, None, None, None, None, None, None))
    df, calls, real = spark.createDataFrame(rows, SCHEMA).coalesce(1), [], release.stored
    monkeypatch.setattr(release, "stored", lambda x: calls.append(1) or real(x))
    run = lambda: sorted(map(str, release.disambiguate(df, ["g"], "nm", "k", "echo", "ti", [("p", "p"), ("q", "q")], own="own").collect()))
    monkeypatch.setattr(release, "AT_ONCE", 8)
    got, few = run(), len(calls)
    monkeypatch.setattr(release, "WHOLE_GROUP", 0)
    assert got == run() and few == 3 and len(calls) - few > 6
    monkeypatch.setattr(release, "WHOLE_GROUP", 8)
    monkeypatch.setattr(release, "AT_ONCE", 1)
    assert got == run()
