"""Row-relative functions: places in a time line, neighbours, ranks, running flags, line sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

_FINER = {"day": 0, "month": 1, "year": 2}


def timeline(subject: str, day: str, key: str, precision: str | None = None) -> WindowSpec:
    """A subject's rows by day, finer precision first, then key."""
    finer = [F.when(F.col(precision) == "day", 0).when(F.col(precision) == "month", 1).otherwise(2)] if precision else []
    return Window.partitionBy(subject).orderBy(F.col(day).asc_nulls_last(), *finer, F.col(key))


def ordinal(w: WindowSpec) -> Column:
    return F.row_number().over(w)


def prev(x: str, w: WindowSpec) -> Column:
    return F.lag(x).over(w)


def next_(x: str, w: WindowSpec) -> Column:
    return F.lead(x).over(w)


def ever_before(flag: Column, w: WindowSpec) -> Column:
    """Whether the flag held in an earlier row."""
    return F.coalesce(F.max(flag).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))


def line_sum(x: str, keys: Sequence[str], along: str) -> Column:
    """Sum over a line of a grid of groups: all keys but one."""
    return F.sum(x).over(Window.partitionBy(*[k for k in keys if k != along]))


def breakdowns(df: DataFrame, dimensions: Sequence[str], **aggregates: Column) -> DataFrame:
    """One-way breakdowns beside a total in one pass of grouping sets; dimension and value name the row."""
    out = df.groupingSets([[c] for c in dimensions] + [[]], *dimensions).agg(*[F.grouping(c).alias(f"__g_{c}") for c in dimensions], *[v.alias(k) for k, v in aggregates.items()])
    dimension, value = F.lit("total"), F.lit(None).cast("string")
    for c in dimensions:
        dimension, value = F.when(F.col(f"__g_{c}") == 0, c).otherwise(dimension), F.when(F.col(f"__g_{c}") == 0, F.col(c).cast("string")).otherwise(value)
    return out.select(dimension.alias("dimension"), value.alias("value"), *aggregates)
