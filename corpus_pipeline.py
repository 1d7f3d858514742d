"""A corpus pipeline: toxic texts go, then copies, then near copies; sources are mixed and the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
keep the columns of documents.  run() writes each stage's result to the shared
folder and reads it back as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corvane.llm import exact_dedup, mixing, ngram_join, packing, toxicity
from corvane.llm.common import stored, table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that score under 0.5 for toxicity, learned from the labels of the tables; a null text scores as an empty one, rows score one by one, without labels nothing goes."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts (white space aside): the longest original, then the least doc_id, null ids last; null and empty texts are one group."""
    return exact_dedup.deduplicate(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group linked by 80 % of their five-word shingles; texts without words and rows without an id link with nothing and stay."""
    return ngram_join.keep_one(docs, width=5, percent=80)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs by block and rank of the mixture, each row as often as the plan places it, once at least; a null source is one of its own, texts without words are placed once."""
    return mixing.mix(docs, repetition=2.0)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batch, slot and padding of every row; texts without words have length 0, one longer than the budget is a batch of its own."""
    return packing.pack(docs)


STAGES = [("toxicity", toxic), ("exact_dedup", copies), ("ngram_jaccard", near_copies), ("mixing", mixed), ("packing", packed)]

#: The toxicity stage is a fitted model, which SQL cannot express; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
