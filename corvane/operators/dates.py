"""Days read out of texts that state one or merely hold one: values, unique ids, paths, free text.

Everything here is an expression over one row, so reading candidates needs no shuffle; the vote over them is
`timelines.vote_dates`.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARS = (1980, 2100)


def _runs(text: Column, length: int) -> Column:
    """The whole runs of digits of a text that are just so long; a part of a longer run is none."""
    return F.filter(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda run: F.length(run) == length)


def _believed(days: Column, years: tuple[int, int]) -> Column:
    """The days of an array that fall in the years; nulls go too."""
    return F.filter(days, lambda day: F.year(day).between(*years))


def _calendar_day(digits: Column, years: tuple[int, int]) -> Column:
    """The day of eight digits, null unless the calendar has it.  By arithmetic: parsing throws, slowly, at every run that is no day."""
    year, month, day = (F.substring(digits, at, n).cast("int") for at, n in ((1, 4), (5, 2), (7, 2)))
    first = F.when(year.between(*years) & month.between(1, 12), F.make_date(year, month, F.lit(1)))
    return F.when(day.between(1, F.dayofmonth(F.last_day(first))), F.date_add(first, day - 1))


def stated_day(text: Column, years: tuple[int, int] = YEARS) -> Column:
    """The day that a value states: eight digits, whatever stands between them; null unless it is a day of the calendar in the years."""
    digits = F.array(F.regexp_replace(text, "[^0-9]", ""))
    return F.get(F.transform(F.filter(digits, lambda x: F.length(x) == 8), lambda x: _calendar_day(x, years)), F.lit(0))


def days_within(text: Column, years: tuple[int, int] = YEARS) -> Column:
    """The days written as a run of eight digits somewhere in a text, in order, repeats kept; null for null."""
    return F.filter(F.transform(_runs(text, 8), lambda run: _calendar_day(run, years)), lambda day: day.isNotNull())


def epochs_within(text: Column, years: tuple[int, int] = YEARS) -> Column:
    """The days (UTC) of runs of ten digits read as seconds since 1970, in order, repeats kept; null for null."""
    return _believed(F.transform(_runs(text, 10), lambda run: F.date_from_unix_date(F.floor(run.cast("long") / 86400).cast("int"))), years)


class Reading(NamedTuple):
    """A source of days: its name, what a day of it weighs, the text, and how to read it (value, days or epochs)."""

    source: str
    weight: float
    text: Column
    how: str = "value"

    def days(self, years: tuple[int, int]) -> Column:
        if self.how == "value":
            return F.filter(F.array(stated_day(self.text, years)), lambda day: day.isNotNull())
        return {"days": days_within, "epochs": epochs_within}[self.how](self.text, years)

    def votes(self, years: tuple[int, int]) -> Column:
        """The days as (day, source, weight); none for a null text."""
        days = F.coalesce(self.days(years), F.array().cast("array<date>"))
        return F.transform(days, lambda day: F.struct(day.alias("day"), F.lit(self.source).alias("source"), F.lit(float(self.weight)).alias("weight")))


def candidates(df: DataFrame, key: str, readings: Sequence[Reading], years: tuple[int, int] = YEARS) -> DataFrame:
    """(key, day, source, weight): a row for every day that a reading finds in a row of df.

    Rows without any day give none; a text that holds a day twice votes twice; null texts are silent.
    """
    # the outer form: for the inner one Spark adds a filter on the size of the array, which reads every text once more
    found = df.select(key, F.inline_outer(F.concat(*[r.votes(years) for r in readings])))
    return found.filter(F.col("day").isNotNull())
