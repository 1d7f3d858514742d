"""Pairs that bitmaps rule out go before their texts are sent; none that links is ruled out."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, ngram_join


def test_no_linked_pair_is_ruled_out():
    rng, ruled_out = np.random.default_rng(7), 0
    for n in [1, 2, 3, 31, 32, 33, 63, 64, 65, 500, 1030]:
        for share in (0.0, 0.02, 0.1, 0.2, 0.5, 0.9):
            one = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            other = np.unique(np.concatenate([one[rng.random(len(one)) >= share], rng.integers(0, 2**63, 1 + int(n * share), dtype=np.uint64)]))
            for a, b in ((one, other), (other, one)):
                may = ngram_join.may_link((ngram_join.bitmap(a), len(a)), [(ngram_join.bitmap(b), len(b))], 80)[0]
                assert may or not ngram_join.linked(a, [b], 80)[0]
                ruled_out += n > 60 and share >= 0.5 and not may
    assert ruled_out == 20  # all that are far apart


@pytest.mark.parametrize("inside", [True, False])
def test_texts_of_pairs_far_apart_are_not_sent(spark, inside):
    """Families of near copies that share a passage: of all pairs only those inside a family are left."""
    passage = " ".join(f"p{i}" for i in range(150))
    rows = [(f * 10 + i, f"{passage} " + " ".join(f"f{f}w{j}" if j != 40 + i else f"x{i}" for j in range(200))) for f in range(5) for i in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    base = common.stored(common.map_arrow(docs, ngram_join._nodes(5), "doc_id long, n_shingles long, h1 long, h2 long, point binary, bits binary"))
    nodes = base.select("h1", "h2", F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "point", "bits")
    of = {r["rep"]: r["h1"] for r in nodes.collect()}
    pairs = spark.createDataFrame([(of[a], of[b]) for a, b in itertools.combinations(sorted(of), 2)], "a long, b long")
    back = {v: k for k, v in of.items()}
    left = {(back[r["a"]], back[r["b"]]) for r in ngram_join._sifted(nodes, pairs, 80, inside).collect()}
    assert {(a, b) for a, b in itertools.combinations(sorted(of), 2) if a // 10 == b // 10} <= left
    assert all(a // 10 == b // 10 for a, b in left)
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.link_documents(docs, 5, 80).collect()}
    assert got == {i: i // 10 * 10 for i, _ in rows}
