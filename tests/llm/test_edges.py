"""Rows that break things: clashing column names, repeated ids, nulls, a very long text, ties, empty tables, for every operator and stage."""

from __future__ import annotations

import collections
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import divergence, exact_dedup, katz, mixing, ngram_join, packing, pseudonyms, quality, sharding, toxicity
from corvane.llm.common import stored

from .test_operators import text

#: Names that operators use inside, or might.
NAMES = ["repeats", "n_replaced", "__n", "__source", "__sha", "__pass", "__copies", "__keep", "__values", "__new", "__text", "__gone", "__at", "__rows", "__key", "label", "score", "sha", "key", "n", "h1", "rep", "w", "row", "bucket", "linked_id", "copy_sha", "mix_at", "weight", "share", "total", "kept", "prediction", "features"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(41)
    long = text(rng, 100_000)
    out = [(1, long, "en", "a", len(long)), (1, long, "en", "a", len(long)), (1, "another text of the same id " + text(rng, 30), "fr", "b", 5), (None, text(rng, 40), None, None, None), (None, None, None, None, None)]
    out += [(7, text(rng, 50), "en", "a", 1)] * 3 + [(8, "", "en", "b", 0), (9, " \n ", "en", None, 3)]
    out += [(100 + i, text(rng, 60), "en", "ab"[i % 2], 60) for i in range(40)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return stored(df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(NAMES)]))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(100 + i, i % 2, i % 3 % 2, 5) for i in range(40)] + [(1, 1, 1, 5), (1, None, 0, 5), (None, 1, 1, 5)], "doc_id long, quality int, toxic int, score int")


def untouched(df):
    return df.filter(" and ".join(f"`{c}` = {i}" for i, c in enumerate(NAMES))).count() == df.count()


ROWWISE = {
    "toxicity": lambda d, y: toxicity.score_documents(d, y),
    "quality": lambda d, y: quality.score_documents(d, y),
    "divergence": lambda d, y: divergence.judge(d),
    "ngram_join": lambda d, y: ngram_join.link_documents(d),
    "copies": lambda d, y: exact_dedup.find_copies(d),
    "sharding": lambda d, y: sharding.assign(d),
    "packing": lambda d, y: packing.pack(d),
    "katz": lambda d, y: katz.score_documents(d),
    "pseudonyms": lambda d, y: pseudonyms.pseudonymise(d, "k"),
}


@pytest.mark.parametrize("name", list(ROWWISE))
def test_one_row_for_each_row(docs, labels, rows, name):
    out = ROWWISE[name](docs, labels)
    got = collections.Counter(r["doc_id"] for r in out.collect())
    assert got == collections.Counter(r[0] for r in rows)
    assert ROWWISE[name](docs.limit(0), labels).count() == 0
    assert ROWWISE[name](docs, labels.limit(0)).count() == len(rows)


def test_equal_rows_get_equal_results(docs, labels):
    for name in ("toxicity", "quality", "divergence", "katz", "pseudonyms"):
        out = ROWWISE[name](docs, labels).filter("doc_id = 7")
        assert out.distinct().count() == 1


KEEPING = {"toxicity": lambda d, y: toxicity.drop_toxic(d, y), "dedup": lambda d, y: exact_dedup.deduplicate(d), "keep_one": lambda d, y: ngram_join.keep_one(d), "mix": lambda d, y: mixing.mix(d), "pseudonyms": lambda d, y: pseudonyms.pseudonymise(d, "k").drop("n_replaced_")}


@pytest.mark.parametrize("name", list(KEEPING))
def test_columns_survive(docs, labels, name):
    out = KEEPING[name](docs, labels)
    assert out.columns == docs.columns and untouched(out) and out.count() > 0
    empty = KEEPING[name](docs.limit(0), labels)
    assert empty.columns == docs.columns and empty.count() == 0


def test_the_plan_counts_whole_texts(docs, rows):
    tokens = {len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert {r["n_tokens"] for r in mixing.plan(docs).collect()} == tokens == {r["n_tokens"] for r in packing.pack(docs).collect()}


def test_stages_on_rows_that_break_things(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage.__doc__
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        out = stage(spark, docs, str(tmp_path))
        assert out.count() > 0
        if name != "packing":
            assert out.columns == docs.columns and untouched(out)
