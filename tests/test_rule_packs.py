"""Rule packs as bit sets against rules read one by one: negation, counts, nulls, scopes, pins, axes that read axes, a pack of a thousand rules."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corvane.operators import rules as R


def holds(spec, row):
    """True, False or None (unknown), as SQL has it."""
    (op, arg), *_ = spec.items()
    if op in ("all", "any"):
        got = [holds(x, row) for x in arg]
        stop = op == "any"
        return stop if stop in got else None if None in got else not stop
    if op == "not":
        got = holds(arg, row)
        return None if got is None else not got
    if op == "count":
        return sum(holds(x, row) is True for x in arg["of"]) >= arg["least"]
    column, value = (arg, None) if isinstance(arg, str) else arg
    if op == "present":
        return row[column] is not None
    if op == "is":
        return None if row.get(column) is None else row[column][0] == value
    v = row[column]
    if v is None:
        return None
    return {"equals": lambda: v == value, "above": lambda: v > value, "below": lambda: v < value, "contains": lambda: value.lower() in v.lower(), "prefix": lambda: v.lower().startswith(value.lower()), "token": lambda: value.lower() in re.split("[^a-z0-9#]+", v.lower())}[op]()


def decided(rules, row, pins=None):
    row = dict(row)
    for axis in dict.fromkeys(r.axis for r in rules):
        if pins and row.get(pins.get(axis)) is not None:
            row[axis] = (row[pins[axis]], 1.0, "pin", "pin")
            continue
        first = next((r for r in rules if r.axis == axis and holds(r.when, row) is True and (r.scope is None or holds(r.scope, row) is True)), None)
        row[axis] = first and (first.value, *R.TIERS[first.tier], first.name)
    return row


def leaf(rng):
    return rng.choice(
        [
            lambda: {"above": ("a", rng.randrange(12))},
            lambda: {"below": ("b", rng.randrange(12))},
            lambda: {"equals": ("a", rng.randrange(12))},
            lambda: {"contains": ("t", rng.choice(["x", "yz", "q"]))},
            lambda: {"token": ("t", rng.choice(["x", "yz"]))},
            lambda: {"prefix": ("t", rng.choice(["x", "y"]))},
            lambda: {"present": rng.choice(["a", "b", "t"])},
        ]
    )()


def condition(rng, depth=3):
    kind = rng.choice(["leaf", "leaf", "all", "any", "not", "count"]) if depth else "leaf"
    if kind == "leaf":
        return leaf(rng)
    if kind == "not":
        return {"not": condition(rng, depth - 1)}
    some = [condition(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {kind: some} if kind != "count" else {"count": {"of": some + some[:1], "least": rng.randrange(4)}}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(8)
    rows = [{"k": i, "a": rng.choice([None, *range(12)]), "b": rng.choice([None, *range(12)]), "t": rng.choice([None, "x yz", "Y z", "q-x", "yz", ""]), "pin": rng.choice([None, None, None, "held"])} for i in range(300)]
    return rows, spark.createDataFrame([tuple(r.values()) for r in rows], "k int, a int, b int, t string, pin string").withColumn("__bits0", F.lit("kept")).withColumn("__fired", F.lit(1)).cache()


def compare(table, rules, pins=None):
    rows, df = table
    out = R.classify(df, rules, pins and {a: F.col(c) for a, c in pins.items()})
    axes = list(dict.fromkeys(r.axis for r in rules))
    assert out.columns == [*df.columns, *axes]
    got = {r["k"]: r for r in out.collect()}
    for row in rows:
        want = decided(rules, row, pins)
        for axis in axes:
            have = got[row["k"]][axis]
            assert (None if have is None else tuple(have)) == want[axis], (row, axis)


@pytest.mark.parametrize("seed", range(3))
def test_any_conditions(table, seed):
    rng = random.Random(seed)
    rules = [R.Rule(f"r{i}", f"x{i % 3}", f"v{i % 5}", condition(rng), rng.choice(list(R.TIERS)), condition(rng, 1) if i % 4 == 0 else None) for i in range(30)]
    compare(table, rules, {"x1": "pin"})


def test_axes_that_read_axes(table):
    rules = [R.Rule("a1", "one", "low", {"below": ("a", 5)}), R.Rule("a2", "one", "high", {"present": "a"}), R.Rule("b1", "two", "yes", {"all": [{"is": ("one", "low")}, {"not": {"above": ("b", 6)}}]}), R.Rule("b2", "two", "no", {"not": {"is": ("one", "low")}}), R.Rule("c1", "three", "z", {"count": {"of": [{"is": ("two", "yes")}, {"is": ("one", "high")}], "least": 1}})]
    compare(table, rules)


def test_a_rule_that_always_holds(table):
    compare(table, [R.Rule("every", "one", "v", {"all": []}), R.Rule("none", "two", "v", {"any": []}), R.Rule("not", "three", "v", {"not": {"any": []}})])


def test_a_pack_of_a_thousand_rules(spark, table):
    rng = random.Random(2)
    rules = [R.Rule(f"r{i}", f"x{i % 4}", f"v{i}", {"all": [{"equals": ("a", rng.randrange(40))}, {"above": ("b", rng.randrange(40))}, {"not": {"equals": ("b", rng.randrange(40))}}]}) for i in range(1000)]
    began = time.time()
    compare(table, rules)
    assert time.time() - began < 60
    plan = R.classify(table[1], rules)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("codegen"))
    assert max(int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", plan)) < 8000
