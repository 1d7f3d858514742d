"""Diffusion facts of planted units: weightings, ways, directions, and where each was read."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from corvane.operators import diffusion as DF

SCHEMA = "unit int, a int, c double, std string, grad string, kind string, counted int, iop string, plane string, pos int, text string"
FIELDS = DF.Fields(private=("a", "c"), standard="std", gradient="grad", directionality=("kind",), counted="counted", cosines="iop", in_plane="plane", positive="pos", text="text")
NAMES = SCHEMA.replace(" int", "").replace(" double", "").replace(" string", "").split(", ")


def facts(spark, units):
    """units: a list of units, each a list of rows given as dictionaries."""
    rows = [tuple(({n: None for n in NAMES} | r | {"unit": i})[n] for n in NAMES) for i, unit in enumerate(units) for r in unit]
    got = {r["unit"]: r.asDict() for r in DF.facts(spark.createDataFrame(rows, SCHEMA), "unit", FIELDS).collect()}
    return [got[i] for i in range(len(units))]


def text_column(spark, expression, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["x"] for r in df.select("i", expression(F.col("t")).alias("x")).orderBy("i").collect()]


def test_weightings_in_names(spark):
    want = {"ax dwi b1000": [1000], "ax dwi b=1000": [1000], "ax dwi b-1000": [1000], "ax dwi b 1000": [1000], "ax_dwi_b1000": [1000], "iso_b1000": [1000], "isob1000": [1000], "*ep_b1000t": [1000], "*ep_b1000#32": [1000], "B0-500-1000": [0, 500, 1000], "*ep_b0_1000": [0, 1000], "dwi b0 b1000": [0, 1000], "b700-AP": [700], "t1 mprage": [], "slab1000": [], "b1000mm": [], "b99999": [], "b0_1000mm": [], "b0-500x b300": [300], "": []}
    assert text_column(spark, DF.shells_within, list(want)) == list(want.values())


def test_ways_and_counts_in_names(spark):
    ways = {"ep2d_diff_b1000_AP": "AP", "DWI-PA": "PA", "ep2d diff RL 32dir": "RL", "ap_dwi": "AP", "ax dwi": None, "ax_grappa_dwi": None, "lr pa": "LR", "AP2": None, "": None}
    assert text_column(spark, DF.way_within, list(ways)) == list(ways.values())
    counts = {"ep2d_diff 32 directions": 32, "ep2d_diff 32dir": 32, "ep2d_diff dir32": 32, "ep2d_diff dir_32": 32, "dti 6 riktningar": 6, "ep2d_diff": None, "1 dir 12 dir": 12, "1234dir": None, "dir 1": None, "300dir dir64": None, "300dir64": 64, "": None}
    assert text_column(spark, DF.count_within, list(counts)) == list(counts.values())


def test_measured_weightings(spark):
    got = facts(spark, [
        [{"std": v, "text": "dwi"} for v in ("0", "0", "1000", "1000")],
        [{"std": "0", "a": 0, "text": "ep2d_diff"}, {"std": "1000", "a": 1000, "text": "ep2d_diff"}],
        [{"c": 1000.0}, {"c": 1.7e38}, {"c": float("nan")}],
        [{"std": "0", "text": "ax dwi trace *re_b1000t"}],
        [{"std": "800", "text": "ax dwi b1000"}],
        [{"text": "t1_mprage_32_sag"}],
        [{"std": r"0\500.4\x\20000\ 1e3 ", "text": None}],
        [{"text": "32 directions, b1000"}],
    ])
    assert [(g["shell"], g["shells"], g["shell_source"]) for g in got] == [(1000, "0,1000", "standard"), (1000, "0,1000", "private,standard"), (1000, "1000", "private"), (1000, "0,1000", "standard,text"), (800, "800", "standard"), (None, None, None), (1000, "0,500,1000", "standard"), (1000, "1000", "text")]
    assert all(v is None for k, v in got[5].items() if k != "unit")
    assert (got[7]["directions"], got[7]["directions_source"]) == (32, "text")


def test_ways_by_geometry(spark):
    axes = {"x": "1\\0\\0", "y": "0\\1\\0", "z": "0\\0\\1", "-x": "-1\\0\\0", "-y": "0\\-1\\0", "-z": "0\\0\\-1"}
    along = {"x": "RL", "y": "AP", "z": "IS", "-x": "LR", "-y": "PA", "-z": "SI"}
    against = {w: w[::-1] for w in ("RL", "AP", "IS", "LR", "PA", "SI")}
    cases = list(itertools.product(axes, ("ROW", "col "), (1, 0)))
    other = lambda a: "y" if a[-1] != "y" else "z"
    units = [[{"grad": "1\\0\\0", "pos": pos, "plane": plane, "iop": "\\".join((axes[a], axes[other(a)]) if plane == "ROW" else (axes[other(a)], axes[a]))}] for a, plane, pos in cases]
    got = facts(spark, units)
    assert [g["way"] for g in got] == [along[a] if pos == 1 else against[along[a]] for a, _, pos in cases]
    assert {g["way_source"] for g in got} == {"geometry"} and {g["way"] for g in got} == set(against)


def test_oblique_missing_and_conflicting(spark):
    one = {"grad": "1\\0\\0", "plane": "COL", "pos": 1}
    got = facts(spark, [
        [one | {"iop": "0.9,0.1,0.42,-0.2,0.93,-0.3"}],  # oblique, commas
        [one | {"iop": "1\\0\\0\\0\\-0.6\\0.8"}],  # steeper towards z
        [one | {"iop": "1\\0\\0\\0\\0.70710678\\0.70710678"}],  # equals: the later axis
        [one | {"iop": "1\\0\\0\\0\\1\\0", "plane": None}],  # no axis named, no guess
        *[[one | {"iop": iop, "text": "dwi_PA"}] for iop in ("1\\0\\0", "", "a\\b\\c\\d\\e\\f", "1\\0\\0\\0\\0\\0", None)],
        [one | {"iop": "1\\0\\0\\0\\1\\0", "text": "dwi_AP"}, one | {"iop": "1\\0\\0\\0\\1\\0", "pos": 0, "text": "dwi_AP"}],  # rows contradict each other
        [{"std": "0", "text": "dwi_AP"}, {"std": "0", "text": "dwi_PA"}],  # texts too
        [{"iop": "1\\0\\0\\0\\1\\0", "plane": "COL", "pos": 1, "text": "t2_RL"}],  # nothing says diffusion
        [{"iop": "1\\0\\0\\0\\1\\0", "plane": "COL", "pos": 1, "text": "b1000 RL"}],  # only the text does: the geometry is not used
    ])
    assert [(g["way"], g["way_source"]) for g in got] == [("AP", "geometry"), ("IS", "geometry"), ("IS", "geometry"), (None, None), *[("PA", "text")] * 5, (None, "conflict"), (None, "conflict"), (None, None), ("RL", "text")]


def test_directions(spark):
    grad = lambda g, kind="DIRECTIONAL", **more: {"grad": g, "kind": kind, "text": "ep2d_diff_32_dir", **more}
    got = facts(spark, [
        [grad("0\\0\\0", "NONE"), grad("1\\0\\0"), grad("0\\1\\0"), grad("0\\0\\1"), grad("0\\0\\1")],
        [grad("0.577\\0.577\\0.577", "ISOTROPIC"), grad("1\\0\\0", None)],
        [grad("0.70710678\\0.70710678\\0"), grad("0.7071\\0.7071\\0.0"), grad("-0.7071\\-0.7071\\0")],
        [grad("1\\0\\0", counted=25)],
        [grad("1\\0\\0", counted=0), grad("0\\1\\0", counted=5000)],
        [grad("1\\0\\0", counted=25), grad("1\\0\\0", counted=26)],
        [{"a": 1000, "text": "dti 6 riktningar"}],
        [{"counted": 2000, "text": "ax_12dir"}],
        [grad("0.0001\\0\\0"), grad("1\\0")],
    ])
    assert [(g["directions"], g["directions_source"]) for g in got] == [(3, "gradients"), (1, "gradients"), (2, "gradients"), (25, "vendor_count"), (2, "gradients"), (1, "gradients"), (6, "text"), (12, "text"), (None, None)]


def test_written_out(spark):
    rows = spark.createDataFrame([(1, "0.70710678\\0.70710678\\0", None), (1, "0.7071\\0.7071\\0.0", None), (2, "-1\\0\\0", None), (3, None, None), (4, "1\\0\\0", "NONE"), (5, "-0.00501\\0\\1", None)], "unit int, g string, k string")
    got = {(r["unit"], r["direction"]) for r in DF.directions_played(rows, "unit", "g", ["k"]).collect()}
    assert got == {(1, "0.7071,0.7071,0.0000"), (2, "-1.0000,0.0000,0.0000"), (5, "-0.0050,0.0000,1.0000")}


def test_empty_and_busy_units(spark):
    assert DF.facts(spark.createDataFrame([], SCHEMA), "unit", FIELDS).collect() == []
    busy = [{"std": str(i % 3 * 500), "grad": f"{i % 50 / 50 + 0.1}\\0.3\\0.2", "text": "x"} for i in range(2000)]
    got = facts(spark, [busy, [{"std": "5"}]])
    assert (got[0]["shells"], got[0]["directions"]) == ("0,500,1000", 50) and got[1]["shells"] == "5"
