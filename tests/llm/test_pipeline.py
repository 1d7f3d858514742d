"""The pipeline's stages one after the other, each held against what it must do to its own input."""

from __future__ import annotations

import collections
import random
import re

import pytest

import corpus_pipeline
from corvane.llm import toxicity
from corvane.llm.queries import QUERIES, SQL

from .. import compare
from .test_operators import classes, shingle_sets, text

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, rows, labels = random.Random(3), [], []
    for i in range(300):
        bad = i % 4 == 0
        t = ("scum " if bad else "fine ") + text(rng, 60)
        rows.append((i, t, "en", f"s{min(3, i % 10)}", len(t)))
        labels.append((i, 1, int(bad)))
    for i in range(300, 330):  # copies, then near copies of clean texts
        t = rows[(i - 300) * 4 + 1][1]
        t = t + " \n" if i < 315 else t.replace(t.split()[30], "changed", 1)
        rows.append((i, t, "en", "s0", len(t)))
    rows.append((330, None, None, None, None))
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, folder)
        seen[name] = before, docs
        if name != "packing":
            assert docs.columns == columns
            docs = spark.createDataFrame(docs.collect(), docs.schema)
    before, after = seen["toxicity"]
    assert {r["doc_id"] for r in after.collect()} == {r[0] for r in before if not (r[1] or "").startswith("scum")}
    before, after = seen["exact_dedup"]
    groups = collections.defaultdict(list)
    for r in before:
        groups[re.sub(r"[ \t-\r]", "", r[1] or "")].append(r)
    assert {r["doc_id"] for r in after.collect()} == {min(g, key=lambda r: (-len(r[1] or ""), r[0]))[0] for g in groups.values()}
    before, after = seen["ngram_jaccard"]
    sets = shingle_sets({r[0]: r[1] for r in before}.values(), 5)
    ids = [r[0] for r in before]
    want = classes({i: s for i, s in zip(ids, sets.values(), strict=True)}, 80)
    assert {r["doc_id"] for r in after.collect()} == {i for i, c in want.items() if i == c}
    before, after = seen["mixing"]
    assert {r["doc_id"] for r in after.collect()} == {r[0] for r in before}
    before, after = seen["packing"]
    assert collections.Counter(r["doc_id"] for r in after.collect()) == collections.Counter(r[0] for r in before)


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() > 200
    assert toxicity.PER_CLASS >= 1000


@pytest.mark.parametrize("name", list(SQL))
def test_sql(spark, name):
    got, want = compare.spark_rows(QUERIES[name](spark, FOLDER)), compare.sql_rows(compare.connect(FOLDER), SQL[name])
    keep = [got[0].index(c) for c in want[0]]
    assert sorted(tuple(r[i] for i in keep) for r in got[1]) == want[1]
