"""Identity rules, pseudonyms, identifier maps, merges and number checks."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.functions.scalars import shape
from corvane.plans.graphs import components
from corvane.plans.storage import small_or_shuffled


def identity(rules: Sequence[tuple[str, str | None]], fallback: str) -> tuple[Column, Column]:
    """(id, type): the first field that has a value (or whose pattern's group matches), else the fallback."""
    value, kind = F.col(fallback).cast("string"), F.lit("fallback")
    for field, pattern in reversed(rules):
        c = F.col(field).cast("string")
        got = F.nullif(F.trim(F.regexp_extract(c, pattern, 1) if pattern else c), F.lit(""))
        value, kind = F.when(got.isNotNull(), got).otherwise(value), F.when(got.isNotNull(), field).otherwise(kind)
    return value, kind


def probe(df: DataFrame, source: str, rules: Mapping[str, Sequence[tuple[str, str | None]]], fallback: str) -> DataFrame:
    """Per source and candidate rule: rows that answer, rows that fall through, subjects, shapes, and whether the id is constant."""
    parts = []
    for name, rule in rules.items():
        value, kind = identity(rule, fallback)
        parts.append(F.struct(F.lit(name).alias("rule"), value.alias("id"), (kind != "fallback").alias("answered")))
    rows = df.select(source, F.inline(F.array(*parts)))
    return rows.groupBy(source, "rule").agg(F.count(F.when(F.col("answered"), 1)).alias("answered"), F.count(F.when(~F.col("answered"), 1)).alias("fell_through"), F.countDistinct("id").alias("subjects"), F.countDistinct(shape(F.col("id"))).alias("shapes")).withColumn("constant", F.col("subjects") == 1)


def code(key: str, value: Column, length: int = 16) -> Column:
    """Keyed code of an identifier, JVM-side: hex of a keyed digest (inner and outer, so lengths cannot be extended)."""
    return F.substring(F.sha2(F.concat(F.lit(key), F.sha2(F.concat(F.lit(key), value.cast("string")), 256)), 256), 1, length)


def blake_code(key: str, value: Column, size: int = 10) -> Column:
    """Keyed BLAKE2b in hex, batch-wise in Python, for codes that must equal ones made elsewhere."""

    @F.pandas_udf("string")
    def coded(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else hashlib.blake2b(v.encode(), key=key.encode(), digest_size=size).hexdigest())

    return coded(value.cast("string"))


def identifier_map(rows: DataFrame, row: str, identifiers: Sequence[str], code: str | None = None, known: DataFrame | None = None, merged_codes: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A map whose rows each are one subject: (row, subject), (row, reason) conflicts, and the report's one row.

    Rows that share an identifier are one subject, the least row of them.  known is (type, value, subject) of what is
    filed, merged_codes (code, into).  Reasons: empty (no identifier), unresolved (no code and no known identifier, where
    `known` is given), two subjects (its identifiers are known on two), repeated (an identifier stood in an earlier row
    with another code), mapped (an identifier is filed on another subject than the row's code names), merged (its code was merged into another).  The report says how many subjects are named and how many
    of them are known, how many rows are in conflict, and whether it applies: with one conflict nothing does.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("type"), F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias("value")) for c in identifiers])
    own = F.lit(None).cast("string") if code is None else F.nullif(F.trim(F.col(code).cast("string")), F.lit(""))
    base = rows.select(F.col(row).alias("row"), own.alias("code"), F.filter(cells, lambda x: x["value"].isNotNull()).alias("__c"))
    long = base.select("row", "code", F.inline("__c"))
    first = long.groupBy("type", "value").agg(F.min("row").alias("a"), F.min(F.struct(F.col("row"), F.col("code"))).alias("f"))
    edges = long.join(first, ["type", "value"]).filter("row != a").select("a", F.col("row").alias("b")).distinct()
    found = components(edges)
    subjects = base.select("row").join(found.withColumnRenamed("node", "row"), "row", "left").select("row", F.coalesce("component", "row").alias("subject"))
    reasons = [base.filter((F.size("__c") == 0)).select("row", F.lit("empty").alias("reason"))]
    if code is not None:
        again = long.join(first, ["type", "value"]).filter((F.col("row") != F.col("f.row")) & F.col("code").isNotNull() & F.col("f.code").isNotNull() & (F.col("code") != F.col("f.code")))
        reasons.append(again.select("row", F.lit("repeated").alias("reason")))
    report = subjects.agg(F.countDistinct("subject").alias("subjects"))
    if known is not None:
        filed = long.join(known.select("type", F.col("value").cast("string").alias("value"), F.col("subject").cast("string").alias("__on")), ["type", "value"], "left")
        per = filed.groupBy("row", "code").agg(F.countDistinct("__on").alias("n"), F.min("__on").alias("lo"), F.max("__on").alias("hi"))
        reasons.append(per.filter("n = 0 and code is null").select("row", F.lit("unresolved").alias("reason")))
        reasons.append(per.filter("n > 1").select("row", F.lit("two subjects").alias("reason")))
        reasons.append(per.filter("code is not null and n > 0 and (lo != code or hi != code)").select("row", F.lit("mapped").alias("reason")))
        told = per.filter("n > 0").join(subjects, "row").agg(F.countDistinct("subject").alias("known"))
        report = report.crossJoin(told)
    if merged_codes is not None:
        gone = base.join(small_or_shuffled(merged_codes.select(F.col("code").cast("string").alias("code"))), "code", "left_semi")
        reasons.append(gone.select("row", F.lit("merged").alias("reason")))
    conflicts = reduce(lambda a, b: a.unionByName(b), reasons).distinct()
    counts = conflicts.agg(F.countDistinct("row").alias("conflicts")).withColumn("applies", F.col("conflicts") == 0)
    return subjects, conflicts, report.crossJoin(counts)


def merged(df: DataFrame, mapping: DataFrame, subject: str) -> DataFrame:
    """Child rows re-pointed from alias to canonical; mapping is (alias, canonical)."""
    return df.join(small_or_shuffled(mapping), df[subject] == mapping["alias"], "left").withColumn(subject, F.coalesce("canonical", subject)).drop("alias", "canonical")


def flattened(intervals: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of a group joined to one; a null end is open."""
    far = F.lit("9999-12-31").cast("date")
    w = Window.partitionBy(*by).orderBy(start, end)
    rows = intervals.select(*by, start, F.coalesce(end, far).alias("__e"))
    w = Window.partitionBy(*by).orderBy(start, "__e")
    rows = rows.withColumn("__reach", F.max("__e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("__new", (F.col("__reach").isNull() | (F.col(start) > F.col("__reach"))).cast("int")).withColumn("__g", F.sum("__new").over(w))
    out = rows.groupBy(*by, "__g").agg(F.min(start).alias(start), F.max("__e").alias("__e"))
    return out.select(*by, start, F.nullif("__e", far).alias(end))


def check_number(raw: Column, today: dt.date) -> tuple[Column, Column]:
    """(number, reason) of a ten- or twelve-digit number: separators dropped, check digit over the last ten.

    Without a century the latest year counts that is not ahead of today; + before the last four digits means
    a hundred years more, and a day of this year still to come a hundred years less.  A day above 60 is a
    coordination number's, 60 more than the day that must exist.  The number has twelve digits, the day as written;
    the reason is null where it is good.
    """
    text = F.regexp_replace(F.trim(raw), r"\s", "")
    digits = F.regexp_replace(text, "[-+]", "")
    short = F.length(digits) == 10
    date = F.substring(digits, F.lit(1), F.length(digits) - 4)
    yy, month, written = (F.substring(date, a, 2).try_cast("int") for a in (-6, -4, -2))
    day = F.when(written > 60, written - 60).otherwise(written)
    latest = today.year - F.pmod(F.lit(today.year) - yy, F.lit(100))
    ahead = (latest == today.year) & (month * 100 + day > today.month * 100 + today.day)
    year = F.when(short, latest - F.when(text.contains("+") | ahead, 100).otherwise(0)).otherwise(F.substring(date, 1, 4).try_cast("int"))
    ten = F.right(digits, F.lit(10))

    def part(i: Column) -> Column:
        d = F.try_element_at(F.split(ten, ""), i).try_cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(10)), part), F.lit(0), lambda a, x: a + x)
    exists = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd").isNotNull()
    reason = F.when(raw.isNull(), "missing").when(~text.rlike(r"^\d{6}(\d{2})?[-+]?\d{4}$"), "form").when(~exists, "date").when(total % 10 != 0, "check digit")
    return F.when(reason.isNull(), F.concat(F.lpad(year.cast("string"), 4, "0"), F.right(digits, F.lit(8)))), reason


def natural_key(label: Column) -> Column:
    """Sort key of a label with its digit runs as numbers."""
    padded = F.transform(F.regexp_extract_all(F.lower(label), F.lit(r"(\d+|\D+)"), F.lit(1)), lambda p: F.when(p.rlike(r"^\d"), F.lpad(F.regexp_replace(p, "^0+(?=.)", ""), 18, "0")).otherwise(p))
    return F.array_join(padded, "")


def natural_places(df: DataFrame, group: str, label: str) -> DataFrame:
    """Place of each label in natural order inside its group, shared by equal ones."""
    return df.withColumn("place", F.dense_rank().over(Window.partitionBy(group).orderBy(natural_key(F.col(label)))))


def uid(key: str, old: Column, root: str = "2.25") -> Column:
    """A new unique id for an old one: decimal digits of a keyed digest under a root, the same every time."""
    h = F.sha2(F.concat(F.lit(key), F.lit("|"), old), 256)
    part = lambda a: F.lpad(F.conv(F.substring(h, a, 14), 16, 10), 17, "0")
    return F.concat(F.lit(root + ".1"), part(1), part(15))


def scrub(text: Column, own: Sequence[Column], mark: str = "[removed]", least: int = 3) -> Column:
    """A row's own identifiers (of at least 3 characters) taken out of its free text, whatever their case."""
    longest = F.array_sort(F.filter(F.array(*[F.trim(c.cast("string")) for c in own]), lambda x: F.length(x) >= least), lambda a, b: F.length(b) - F.length(a))
    quoted = lambda x: F.regexp_replace(x, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
    return F.aggregate(longest, text, lambda acc, x: F.regexp_replace(acc, F.concat(F.lit("(?i)"), quoted(x)), F.lit(mark)))


