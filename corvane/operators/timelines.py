"""Sessions and time lines: bounded sessions, names, cadence, date votes, membership intervals."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def sessions(df: DataFrame, subject: str, day: str, window_days: int) -> DataFrame:
    """(subject, session_first, session_last, n): a day joins the open session if within window_days of its first day.

    A fold over each subject's distinct days, kept as one array per subject:
    session_window would chain gaps and merge what this keeps apart.
    """
    days = df.filter(F.col(day).isNotNull()).groupBy(subject, day).agg(F.count(F.lit(1)).alias("__n"))
    lines = days.groupBy(subject).agg(F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), F.col("__n").alias("n")))).alias("__days"))
    empty = F.array().cast("array<struct<first:date,last:date,n:bigint>>")

    def fold(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        fresh = F.struct(x["day"].alias("first"), x["day"].alias("last"), x["n"].alias("n"))
        grown = F.struct(last["first"].alias("first"), x["day"].alias("last"), (last["n"] + x["n"]).alias("n"))
        opens = (F.size(acc) == 0) | (F.datediff(x["day"], last["first"]) > window_days)
        return F.when(F.size(acc) == 0, F.array(fresh)).when(opens, F.concat(acc, F.array(fresh))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown)))

    out = lines.select(subject, F.explode(F.aggregate("__days", empty, fold)).alias("__session"))
    return out.select(subject, F.col("__session.first").alias("session_first"), F.col("__session.last").alias("session_last"), F.col("__session.n").alias("n"))


def any_yes(flag: Column) -> Column:
    """Aggregate of three-valued flags: one yes is yes, else one unknown is unknown, else no."""
    return F.when(F.coalesce(F.bool_or(flag), F.lit(False)), True).when(F.count(F.when(flag.isNull(), 1)) > 0, F.lit(None).cast("boolean")).otherwise(False)


def named(df: DataFrame, subject: str, first: str) -> DataFrame:
    """Session names by date and by place."""
    w = Window.partitionBy(subject).orderBy(first)
    return df.withColumn("by_date", F.date_format(first, "yyyyMMdd")).withColumn("by_place", F.format_string("%02d", F.row_number().over(w)))


#: Mean days of a month, a fixed value.
MEAN_MONTH = 30.44


def months_exact(a: Column, b: Column) -> Column:
    """Months from a to b: whole calendar months (a month's end stands for a missing day), and the days that are left by the mean month; negative if b is earlier."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    rough = (F.year(hi) * 12 + F.month(hi)) - (F.year(lo) * 12 + F.month(lo))
    whole = rough - F.when(F.add_months(lo, rough) > hi, 1).otherwise(0)
    return F.when(b < a, -1.0).otherwise(1.0) * (whole + F.datediff(hi, F.add_months(lo, whole)) / F.lit(MEAN_MONTH))


def cadence_names(df: DataFrame, first: str, anchor: str, cadence: Sequence[int], tolerance: float) -> DataFrame:
    """Months from the anchor (`months` exact, `month` rounded), the cadence `point` within tolerance (the earlier of two) and the label.

    PREnn before the anchor, where the rounded months are not 0; else Mnn, of the point or, off the cadence, of the
    rounded months.  Month 0 stays month 0.
    """
    exact = months_exact(F.col(anchor), F.col(first))
    rows = df.withColumn("months", exact).withColumn("month", F.round(F.abs("months")).cast("int"))
    points = F.array(*[F.struct(F.abs(F.lit(float(c)) - F.col("months")).alias("gap"), F.lit(c).alias("point")) for c in cadence])
    best, pre = F.array_min(points), (F.col("months") < 0) & (F.col("month") != 0)
    at_zero = F.lit(0) if 0 in cadence else F.lit(None).cast("int")
    point = F.when(~pre & (F.col("month") == 0), at_zero).when(~pre & (best["gap"] <= tolerance), best["point"])
    rows = rows.withColumn("point", point)
    label = F.when(pre, F.format_string("PRE%02d", "month")).otherwise(F.format_string("M%02d", F.coalesce("point", "month")))
    return rows.withColumn("label", F.when(F.col("months").isNotNull(), label)).withColumn("months", F.round("months", 4))


def anchors(sessions_: DataFrame, subject: str, first: str, events: DataFrame | None = None, event_day: str | None = None, explicit: DataFrame | None = None) -> DataFrame:
    """(subject, anchor): the explicit day, else the earliest event's, else the first session's."""
    out = sessions_.groupBy(subject).agg(F.min(first).alias("__s"))
    if events is not None:
        out = out.join(events.groupBy(subject).agg(F.min(event_day).alias("__e")), subject, "left")
    else:
        out = out.withColumn("__e", F.lit(None).cast("date"))
    out = out.join(explicit.select(subject, F.col("anchor").alias("__x")), subject, "left") if explicit is not None else out.withColumn("__x", F.lit(None).cast("date"))
    return out.select(subject, F.coalesce("__x", "__e", "__s").alias("anchor"))


def source_labels(df: DataFrame, key: str, path: str, segment: int, pattern: str) -> DataFrame:
    """Per key the label out of a path segment, null and flagged where its rows disagree."""
    label = F.nullif(F.regexp_extract(F.try_element_at(F.split(path, "/"), F.lit(segment + 1)), pattern, 1), F.lit(""))
    per = df.select(key, label.alias("__l")).groupBy(key).agg(F.min("__l").alias("__a"), F.max("__l").alias("__b"))
    return per.select(key, F.when(F.col("__a") == F.col("__b"), F.col("__a")).alias("label"), (F.col("__a") != F.col("__b")).alias("flagged"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Suffixes of labels that would be equal, in order: the first label has none, and two letters follow when one is not enough.
SUFFIXES = [*_LETTERS[1:], *(a + b for a in _LETTERS for b in _LETTERS)]


def settle(df: DataFrame, subject: str, first: str, months: str, cadence: Sequence[int], tolerance: float, how: str = "date", relax: bool = True) -> DataFrame:
    """(subject, first, months, label, flagged) after sessions of a subject that want one label are told apart.

    months are exact, from the anchor.  The nearest session has the claim on a cadence point, the earlier of two; relax gives others the nearest
    free point within tolerance.  Of those that still share a label: merge lets them; date leaves all
    without one; demote keeps the nearest and gives the others their own rounded month if it is free, else none; suffix
    gives them their own month with the next free letter.  Before the anchor labels are PREnn, and
    sessions off the cadence carry their own month.  What lost its label is flagged.

    A fold over each subject's sessions, which are few: the claims are taken in order in one array per subject.
    """
    exact, day = F.col(months), F.col(first)
    month = F.round(F.abs(exact)).cast("int")
    points = F.array_sort(F.array(*[F.struct(F.round(F.abs(F.lit(float(c)) - exact), 9).alias("gap"), F.lit(c).alias("point")) for c in cadence]))
    within = F.filter(points, lambda p: p["gap"] <= tolerance)
    at_zero = F.lit(0 in cadence)
    pre = (exact < 0) & (month != 0)
    nominal = F.when(pre | exact.isNull(), F.lit(None)).when(month == 0, F.when(at_zero, F.lit(0))).otherwise(F.try_element_at(within, F.lit(1))["point"])
    rows = df.select(subject, first, months).withColumn("__point", nominal).withColumn("__month", month).withColumn("__pre", pre).withColumn("__near", F.transform(within, lambda p: p["point"]))
    gap = lambda p: F.when(F.col(p).isNull(), F.lit(0.0)).otherwise(F.round(F.abs(exact - F.col(p)), 9))
    rows = rows.withColumn("__gap", gap("__point"))
    members = F.array_sort(F.collect_list(F.struct(F.col("__gap").alias("gap"), day.alias("day"), F.col(months).alias("m"), F.col("__month").alias("month"), F.col("__pre").alias("pre"), F.col("__point").alias("point"), F.col("__near").alias("near"))))
    lines = rows.groupBy(subject).agg(members.alias("__m"))
    if relax:
        held = F.struct(F.array().cast("array<int>").alias("held"), F.slice("__m", 1, 0).alias("out"))

        def take(s: Column, x: Column) -> Column:
            free = F.try_element_at(F.filter(x["near"], lambda p: ~F.array_contains(s["held"], p)), F.lit(1))
            point = F.when(x["point"].isNull() | ~F.array_contains(s["held"], x["point"]), x["point"]).otherwise(F.coalesce(free, x["point"]))
            left = F.when(point.isNull(), x["gap"]).otherwise(F.round(F.abs(x["m"] - point), 9))
            moved = F.struct(left.alias("gap"), x["day"].alias("day"), x["m"].alias("m"), x["month"].alias("month"), x["pre"].alias("pre"), point.alias("point"), x["near"].alias("near"))
            return F.struct(F.when(point.isNull(), s["held"]).otherwise(F.array_union(s["held"], F.array(point))).alias("held"), F.concat(s["out"], F.array(moved)).alias("out"))

        lines = lines.select(subject, F.array_sort(F.aggregate("__m", held, take)["out"]).alias("__m"))
    name = lambda x: F.when(x["m"].isNull(), F.lit(None)).when(x["pre"], F.format_string("PRE%02d", x["month"])).otherwise(F.format_string("M%02d", F.coalesce(x["point"], x["month"])))
    own = lambda x: F.when(x["pre"], F.format_string("PRE%02d", x["month"])).otherwise(F.format_string("M%02d", x["month"]))
    one = lines.select(subject, F.explode("__m").alias("__x")).withColumn("__want", name(F.col("__x")))
    w = Window.partitionBy(subject, "__want")
    one = one.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__r", F.row_number().over(w.orderBy("__x.gap", "__x.day")))
    lost = F.col("__want").isNotNull() & (F.col("__n") > 1) & F.lit(how != "merge") & (F.lit(how == "date") | (F.col("__r") > 1))
    one = one.withColumn("__lost", F.coalesce(lost, F.lit(False)))
    if how in ("merge", "date"):
        label = F.when(~F.col("__lost"), F.col("__want"))
        return one.select(subject, F.col("__x.day").alias(first), F.col("__x.m").alias(months), label.alias("label"), "__lost").withColumnRenamed("__lost", "flagged")
    # demotions come last, in order of the label lost and the claim, and never take a label that is held
    kept = F.collect_set(F.when(~F.col("__lost"), F.col("__want")))
    demoted = F.array_sort(F.collect_list(F.when(F.col("__lost"), F.struct(F.col("__want").alias("want"), F.col("__x.gap").alias("gap"), F.col("__x.day").alias("day"), F.col("__x.m").alias("m"), own(F.col("__x")).alias("own")))))
    stays = F.collect_list(F.when(~F.col("__lost"), F.struct(F.col("__x.day").alias("day"), F.col("__x.m").alias("m"), F.col("__want").alias("label"), F.lit(False).alias("flagged"))))
    per = one.groupBy(subject).agg(kept.alias("__taken"), demoted.alias("__d"), stays.alias("__s"))
    letters = F.split(F.lit(" ".join(SUFFIXES)), " ")

    def demote(s: Column, x: Column) -> Column:
        spare = F.try_element_at(F.filter(F.transform(letters, lambda c: F.concat(x["own"], c)), lambda n: ~F.array_contains(s["taken"], n)), F.lit(1))
        label = F.when(~F.array_contains(s["taken"], x["own"]), x["own"]).otherwise(spare if how == "suffix" else F.lit(None).cast("string"))
        row = F.struct(x["day"].alias("day"), x["m"].alias("m"), label.alias("label"), F.lit(True).alias("flagged"))
        return F.struct(F.when(label.isNull(), s["taken"]).otherwise(F.array_union(s["taken"], F.array(label))).alias("taken"), F.concat(s["out"], F.array(row)).alias("out"))

    out = per.select(subject, F.inline(F.aggregate("__d", F.struct(F.col("__taken").alias("taken"), F.col("__s").alias("out")), demote)["out"]))
    return out.select(subject, F.col("day").alias(first), F.col("m").alias(months), "label", "flagged")


def digest(df: DataFrame, subject: str, *columns: str) -> DataFrame:
    """(subject, digest): order-free digest of a subject's rows."""
    row = F.xxhash64(*columns)
    return df.groupBy(subject).agg(F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.bit_xor(row), F.sum(F.pmod(row, F.lit(1_000_003)))), 256).alias("digest"))


def refresh(old: DataFrame, old_digests: DataFrame, rows: DataFrame, subject: str, day: str, window_days: int) -> tuple[DataFrame, DataFrame]:
    """The session cache after new rows: only subjects whose digest moved are rebuilt.  Also (subject, state): new, changed, vanished."""
    now = digest(rows, subject, subject, day)
    state = old_digests.withColumnRenamed("digest", "__old").join(now, subject, "full_outer").select(subject, F.when(F.col("__old").isNull(), "new").when(F.col("digest").isNull(), "vanished").when(F.col("__old") != F.col("digest"), "changed").alias("state")).filter("state is not null")
    kept = old.join(state.select(subject), subject, "left_anti")
    moved = rows.join(state.filter("state != 'vanished'").select(subject), subject, "left_semi")
    return kept.unionByName(sessions(moved, subject, day, window_days)), state


def vote_dates(candidates: DataFrame, key: str, day: str, weight: str, placeholders: Sequence[str] = ("1900-01-01", "1970-01-01"), source: str | None = None) -> DataFrame:
    """Per key the date with the greatest summed weight, the earlier of equals, the next weight and the margin over it.

    Placeholder dates do not vote.  A first of January wins only where no other day was named; it may still be the next.
    With a source column also the source of the weightiest single vote for that date, the first by name of equals.
    """
    votes = candidates.filter(F.col(day).isNotNull() & ~F.col(day).cast("string").isin(list(placeholders)))
    heaviest = [F.min(F.struct((-F.col(weight)).alias("w"), F.col(source).alias("s"))).getField("s").alias("__s")] if source else []
    sums = votes.groupBy(key, day).agg(F.round(F.sum(weight), 9).alias("w"), *heaviest)
    new_year = ((F.month(day) == 1) & (F.dayofmonth(day) == 1)).cast("int")
    order = F.struct(new_year.alias("y"), (-F.col("w")).alias("w"), F.col(day).alias("d"), *([F.col("__s").alias("s")] if source else []))
    # a key's list holds each day once, whatever the rows, so one pass finds the best and the next without summing twice
    ranked = sums.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("r")).select(key, F.get("r", F.lit(0)).alias("best"), F.slice("r", F.lit(2), F.greatest(F.size("r") - 1, F.lit(0))).alias("rest"))
    weight_, next_ = -F.col("best.w"), F.coalesce(-F.array_min(F.transform("rest", lambda x: x["w"])), F.lit(0.0))
    return ranked.select(key, F.col("best.d").alias("voted"), weight_.alias("weight"), F.round(weight_ - next_, 9).alias("margin"), *([F.col("best.s").alias("source")] if source else []))


def history(parts: dict[str, tuple[DataFrame, str, str]]) -> DataFrame:
    """Events of an object from several tables, with their place in its line (by day, then kind; rows without a day last): parts are name: (rows, object column, day column)."""
    rows = [df.select(F.col(o).alias("object"), F.col(day).alias("day"), F.lit(name).alias("kind")) for name, (df, o, day) in parts.items()]
    every = reduce(lambda a, b: a.unionByName(b), rows)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("object").orderBy(F.col("day").asc_nulls_last(), "kind")))


def open_at(members: DataFrame, cohort: str, subject: str, joined: str, left: str, day: str) -> DataFrame:
    """Open members of each cohort on a day."""
    d = F.lit(day).cast("date")
    return members.filter((F.col(joined) <= d) & (F.col(left).isNull() | (F.col(left) > d))).groupBy(cohort).agg(F.countDistinct(subject).alias("members"))


def feed(members: DataFrame, cohort: str, subject: str) -> DataFrame:
    """Join intervals of (cohort, subject, day, joins): each join opens an interval that the next leave closes."""
    w = Window.partitionBy(cohort, subject).orderBy("day", F.desc("joins"))
    rows = members.withColumn("__before", F.lag("joins").over(w)).filter(F.col("__before").isNull() | (F.col("__before") != F.col("joins")))
    rows = rows.withColumn("left_at", F.lead("day").over(w)).filter("joins")
    return rows.select(cohort, subject, F.col("day").alias("joined_at"), "left_at")


def promote(answer: DataFrame, members: DataFrame, subject: str, cohort: int, day: str) -> DataFrame:
    """Intervals to append for an answer's distinct subjects that have no open one in the cohort."""
    standing = members.filter((F.col("cohort") == cohort) & F.col("left_at").isNull())
    return answer.select(subject).distinct().join(standing, subject, "left_anti").select(subject, F.lit(cohort).alias("cohort"), F.lit(day).cast("date").alias("joined_at"), F.lit(None).cast("date").alias("left_at"))
