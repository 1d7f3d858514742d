"""Scalar functions of the set language as columns; dates are whole days, division is always double."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.sets import interval_end, interval_start

#: Lists longer than this are joined, not written into the plan.
LONG_LIST = 1_000
UNIT_DAYS = {"day": 1, "week": 7, "month": 31, "year": 366}


def about(a: Column, b: Column, tolerance: float) -> Column:
    """Equal to within a tolerance."""
    return F.abs(a - b) <= tolerance


def about_days(a: Column, b: Column, days: int) -> Column:
    return F.abs(F.datediff(a, b)) <= days


def among(df: DataFrame, column: str, values: Sequence, negate: bool = False) -> DataFrame:
    """in / not_in; a long list becomes a join with a table."""
    if len(values) <= LONG_LIST:
        test = F.col(column).isin(list(values))
        return df.filter(~test if negate else test)
    listed = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return df.join(listed, column, "left_anti" if negate else "left_semi")


def contains(text: Column, part: str) -> Column:
    """Literal, case-insensitive."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def starts_with(text: Column, part: str) -> Column:
    return F.startswith(F.lower(text), F.lit(part.lower()))


def divide(a: Column, b: Column) -> Column:
    """Double division; null where the divisor is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def round_key(x: Column, digits: int) -> Column:
    """The rounded value as an integer key."""
    return F.round(x * 10**digits).cast("long")


def months_between(a: Column, b: Column) -> Column:
    """Whole months from a to b, a month being whole on a's day of the month; a floor, so a day short of a month back is -1."""
    return (F.year(b) * 12 + F.month(b)) - (F.year(a) * 12 + F.month(a)) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)


def years_between(a: Column, b: Column) -> Column:
    """Whole years from a to b, a year being whole on a's month and day; a floor too."""
    return age_at(a, b)


def shift(day: Column, n: Column | int, unit: str = "day") -> Column:
    return F.date_add(day, (F.lit(n) if isinstance(n, int) else n) * UNIT_DAYS[unit])


def age_at(birth: Column, day: Column) -> Column:
    """Whole years, exact to the birthday."""
    return F.year(day) - F.year(birth) - F.when(F.date_format(day, "MMdd") < F.date_format(birth, "MMdd"), 1).otherwise(0)


def safe_age(birth: Column, day: Column) -> Column:
    """The age where it lies in 0 to 150, else null."""
    age = age_at(birth, day)
    return F.when(age.between(0, 150), age)


def bucket(day: Column, unit: str) -> Column:
    return F.date_format(day, {"year": "yyyy", "month": "yyyy-MM", "day": "yyyy-MM-dd"}[unit])


def part(day: Column, unit: str) -> Column:
    """dow counts from Sunday = 0."""
    return {"year": F.year, "month": F.month, "day": F.dayofmonth, "dow": lambda d: F.dayofweek(d) - 1}[unit](day)


def json_text(text: Column, key: str) -> Column:
    return F.get_json_object(text, f"$.{key}")


def coarse_compare(op: str, day: Column, precision: Column, other: Column, strict: bool = False, other_precision: Column | None = None) -> Column:
    """Compare a coarse date with a day, or another coarse date: forgiving if some days of the intervals do, strict if all do.

    Forgiving, = is an overlap and <> is none; strict, = wants whole days on both sides and <> compares the first days.
    """
    lo, hi = interval_start(day, precision), interval_end(day, precision)
    a, b = (other, other) if other_precision is None else (interval_start(other, other_precision), interval_end(other, other_precision))
    exact = (precision == "day") & (F.lit(True) if other_precision is None else other_precision == "day")
    overlap = (lo <= b) & (hi >= a)
    some = {"<": lo < b, "<=": lo <= b, ">": hi > a, ">=": hi >= a, "=": overlap, "<>": ~overlap}
    all_ = {"<": hi < a, "<=": hi <= a, ">": lo > b, ">=": lo >= b, "=": exact & (lo == a), "<>": lo != a}
    return (all_ if strict else some)[op]


def utc_day(instant: Column) -> Column:
    return F.to_date(instant)


def joined_key(*parts: Column, digits: int = 3, sep: str = "x") -> Column:
    """Numbers as one text key, rounded; null if one is missing."""
    keys = [round_key(p, digits).cast("string") for p in parts]
    return F.when(reduce(lambda a, b: a & b, [p.isNotNull() for p in parts]), F.concat_ws(sep, *keys))


def signature(exact: Sequence[str], stepped: Mapping[str, float], sep: str = "|") -> Column:
    """Exact members and members rounded to a step, joined; a missing member is an empty place."""
    place = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    return F.concat_ws(sep, *[place(F.col(c)) for c in exact], *[place(F.round(F.col(c) / step).cast("long")) for c, step in stepped.items()])


def newest(value: str, day: str, key: str) -> Column:
    """Aggregate: the value of the newest row, the greatest key among equal days."""
    return F.max_by(F.col(value), F.struct(day, key))


def synonyms(df: DataFrame, column: str, names: Mapping[str, str], name: str) -> DataFrame:
    """Stored, shown and former names brought to one, by a map in the plan."""
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return df.withColumn(name, F.coalesce(F.try_element_at(F.create_map(*pairs), F.col(column)), F.col(column)))


def shape(text: Column, most: int = 40) -> Column:
    """Mask of a text: digits 9, letters a and A, other characters as they are; longer ones end in ~."""
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[a-z]", "a"), "[A-Z]", "A")
    return F.when(F.length(mask) > most, F.concat(F.substring(mask, 1, most), F.lit("~"))).otherwise(mask)


def fold(text: Column) -> Column:
    """White space runs to one blank, edges trimmed."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))
