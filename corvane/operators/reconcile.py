"""Reconciliation of two copies of a registry: fields, shapes, partitions, presence, axes; and dataset summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.scalars import shape


def _pairs(a: DataFrame, b: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    left = a.select(key, *[F.col(f).cast("string").alias(f"__a_{f}") for f in fields])
    right = b.select(key, *[F.col(f).cast("string").alias(f"__b_{f}") for f in fields])
    return left.join(right, key).select(key, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"__a_{f}").alias("a"), F.col(f"__b_{f}").alias("b")) for f in fields])))


def normal(x: Column) -> Column:
    return F.nullif(F.lower(F.trim(F.regexp_replace(x, r"\s+", " "))), F.lit(""))


def fields(a: DataFrame, b: DataFrame, key: str, names: Sequence[str], tolerance: Mapping[str, float]) -> DataFrame:
    """Per field over shared keys: compared, both null, one null, equal, equal after normalisation or within tolerance, different."""
    x, y = F.col("a"), F.col("b")
    tol = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for kv in {**tolerance, "": 0.0}.items() for v in kv]), F.col("field")), F.lit(-1.0))
    near = F.coalesce(F.abs(x.try_cast("double") - y.try_cast("double")) <= tol, F.lit(False))
    alike = (x != y) & (normal(x).eqNullSafe(normal(y)) | near)
    return _pairs(a, b, key, names).groupBy("field").agg(
        F.count(F.lit(1)).alias("compared"), F.count(F.when(x.isNull() & y.isNull(), 1)).alias("both_null"), F.count(F.when(x.isNull() != y.isNull(), 1)).alias("one_null"),
        F.count(F.when(x == y, 1)).alias("equal"), F.count(F.when(alike, 1)).alias("alike"), F.count(F.when((x != y) & ~alike, 1)).alias("different"),
    )


def shapes(a: DataFrame, b: DataFrame, key: str, names: Sequence[str]) -> DataFrame:
    """Differing pairs as masks, counted, with one sample key each."""
    diff = _pairs(a, b, key, names).filter("a != b")
    return diff.groupBy("field", shape(F.col("a")).alias("shape_a"), shape(F.col("b")).alias("shape_b")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("sample"))


def partitions(a: DataFrame, b: DataFrame, member: str, group_a: str, group_b: str) -> DataFrame:
    """Two groupings of the same members, by member set: groups in both, only in the first, only in the second.

    A set is told by size and two order-free digests.
    """
    sets = lambda d, g, n: d.select(g, member).distinct().groupBy(g).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(member)).alias("x"), F.sum(F.pmod(F.xxhash64(member, F.lit(1)), F.lit(1_000_000_007))).alias("s")).groupBy("n", "x", "s").agg(F.count(F.lit(1)).alias(n))
    both = sets(a, group_a, "ga").join(sets(b, group_b, "gb"), ["n", "x", "s"], "full_outer").fillna(0, ["ga", "gb"])
    return both.agg(F.sum(F.least("ga", "gb")).alias("matched"), F.sum(F.greatest(F.col("ga") - F.col("gb"), F.lit(0))).alias("only_first"), F.sum(F.greatest(F.col("gb") - F.col("ga"), F.lit(0))).alias("only_second"))


def presence(a: DataFrame, b: DataFrame, key: str, reason_a: Column, reason_b: Column) -> DataFrame:
    """Rows by where they are, with the reason that the side which has them gives."""
    x, y = a.select(key, reason_a.alias("__ra"), F.lit(1).alias("__a")), b.select(key, reason_b.alias("__rb"), F.lit(1).alias("__b"))
    both = x.join(y, key, "full_outer")
    side = F.when(F.col("__b").isNull(), "first").when(F.col("__a").isNull(), "second").otherwise("both")
    return both.groupBy(side.alias("side"), F.when(side == "first", F.col("__ra")).when(side == "second", F.col("__rb")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def matrix(a: DataFrame, b: DataFrame, key: str, axis: str) -> DataFrame:
    """How often each pair of values of an axis occurs."""
    return a.select(key, F.col(axis).alias("first")).join(b.select(key, F.col(axis).alias("second")), key).groupBy("first", "second").agg(F.count(F.lit(1)).alias("n"))


def holding(units: DataFrame, bridge: DataFrame, unit: str, dataset: str, subject: str) -> DataFrame:
    """Datasets by units and distinct subjects, a subject once per dataset through its units."""
    return units.join(bridge, unit).groupBy(dataset).agg(F.countDistinct(unit).alias("units"), F.countDistinct(subject).alias("subjects"))


def registry(df: DataFrame, subject: str, cohort: str, version: str, since: Column) -> DataFrame:
    """Subjects, units and units since a date: in all, by cohort and by rule version, in one pass."""
    out = df.groupingSets([[cohort], [version], []], cohort, version).agg(F.grouping(cohort).alias("__c"), F.grouping(version).alias("__v"), F.countDistinct(subject).alias("subjects"), F.count(F.lit(1)).alias("units"), F.count(F.when(since, 1)).alias("units_since"))
    what = F.when(F.col("__c") == 0, F.col(cohort)).when(F.col("__v") == 0, F.col(version)).otherwise("all")
    return out.select(what.alias("what"), "subjects", "units", "units_since")


def dataset(df: DataFrame, by: str, distinct: Mapping[str, str], counts: Mapping[str, str]) -> DataFrame:
    """A dataset in one row: distinct values of some columns (subjects, visits, kinds), and rows that have a value in others."""
    return df.groupBy(by).agg(*[F.countDistinct(c).alias(n) for n, c in distinct.items()], *[F.count(c).alias(n) for n, c in counts.items()])


def files(df: DataFrame, by: str, status: str, reason: str) -> DataFrame:
    """A dataset's files by status, and by reason where they have one."""
    return df.groupBy(by, status, reason).agg(F.count(F.lit(1)).alias("n"))


def cohort_review(df: DataFrame, cohort: str, open_question: Column, score: str) -> DataFrame:
    """Members of a cohort, those with an open question, and the mean score."""
    return df.groupBy(cohort).agg(F.count(F.lit(1)).alias("members"), F.count(F.when(open_question, 1)).alias("questions"), F.round(F.avg(score), 6).alias("mean"))


def accept_grid(df: DataFrame, unit: str, exceptions: DataFrame, value: Column, probable: Column, key: str, after, size: int, ties: Sequence[str] = ()) -> DataFrame:
    """A page of proposals by key: those of a value and a probability, without excepted units."""
    rows = df.filter(value & probable & (F.col(key) > F.lit(after))).join(exceptions.select(unit), unit, "left_anti")
    return rows.orderBy(key, *ties).limit(size)
