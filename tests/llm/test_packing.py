"""Buckets of long documents have the least padding that any boundaries give."""

from __future__ import annotations

import itertools

from corvane.llm import packing


def test_long_documents_are_packed_optimally(spark):
    lengths = [2100, 2101, 2150, 3000, 3001, 3040, 5000, 5003, 9001, 9100]
    df = spark.createDataFrame([(i, "w " * n) for i, n in enumerate(lengths)], "doc_id long, text string")
    got = packing.pack(df, budget=20_000, buckets=4).collect()
    best = min(sum(min(x for x in cut if x >= n) - n for n in lengths) for cut in itertools.combinations(lengths, 4) if cut[-1] == lengths[-1])
    assert sum(r["padding"] for r in got) == best and {r["boundary"] for r in got} <= set(lengths)
