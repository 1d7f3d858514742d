"""Set operators: sources, algebra, groups, links, as-of partners, picks and quantifiers over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.plans.storage import dealt, stored

from .firsts import beside, first_n

MONTH_DAYS, YEAR_DAYS = 31, 366


def of(child: DataFrame, ancestor: DataFrame, link: str, key: str, terms: Mapping[str, str] | None = None) -> DataFrame:
    """Rows of child whose ancestor is in the set; terms {ancestor column: name} become readable."""
    if not terms:
        return child.join(ancestor.select(F.col(key).alias(link)), link, "left_semi")
    return child.join(ancestor.select(F.col(key).alias(link), *[F.col(c).alias(n) for c, n in terms.items()]), link)


def in_cohorts(subjects: DataFrame, members: DataFrame, cohorts: DataFrame, subject: str, cohort: str, left: str) -> DataFrame:
    """Subjects with an open membership in one of the cohorts; each once, however many cohorts hold it."""
    standing = members.filter(F.col(left).isNull()).join(cohorts.select(cohort), cohort, "left_semi")
    return subjects.join(standing.select(subject), subject, "left_semi")


def among(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Start from a frozen answer or value list: rows whose key it names."""
    return df.join(keys.select(key), key, "left_semi")


def union(left: DataFrame, right: DataFrame) -> DataFrame:
    """Distinct rows of both over the left one's columns; what the right one lacks is null."""
    extra = [F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns if c not in right.columns]
    return left.unionByName(right.select(*[c for c in right.columns if c in left.columns], *extra)).distinct()


def union_tag(tag: str, parts: Mapping[str, DataFrame]) -> DataFrame:
    """One row per operand, with the operand's name."""
    return reduce(lambda a, b: a.unionByName(b), [df.withColumn(tag, F.lit(name)) for name, df in parts.items()])


def intersect(key: str, left: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(key), key, "left_semi"), others, left)


def except_(key: str, left: DataFrame, *others: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.join(b.select(key), key, "left_anti"), others, left)


def bind(df: DataFrame, terms: Mapping[str, Column | Callable[[], Column]]) -> DataFrame:
    """Ordered named expressions; a later one reads the earlier ones."""
    return reduce(lambda d, t: d.withColumn(t[0], t[1]), terms.items(), df)


def group(df: DataFrame, by: Sequence[str], subject: str, **totals: Column) -> DataFrame:
    """Distinct key tuples with _rows, _subjects and _group, their number in key order, nulls last (a null is a key)."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.countDistinct(subject).alias("_subjects"), *[v.alias(k) for k, v in totals.items()])
    return numbered(out, by, "_group")


def numbered(df: DataFrame, by: Sequence[str], name: str) -> DataFrame:
    """Rows numbered from 1 in order of some columns, nulls last."""
    if not by:
        return df.withColumn(name, F.lit(1).cast("long"))
    return cumulated(df.withColumn("__one", F.lit(1).cast("bigint")), by, "__one", name).drop("__one")


def cumulated(df: DataFrame, by: Sequence[str], weight: str, name: str) -> DataFrame:
    """Running sums of a weight in order of some columns, nulls last: ranges are summed each on its own, behind the sums of the ranges before."""
    order = [F.col(c).asc_nulls_last() for c in by]
    dealt = stored(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = dealt.groupBy("__range").agg(F.sum(weight).alias("__sum"))  # a row for each shuffle partition
    ahead = sizes.select("__range", (F.sum("__sum").over(Window.orderBy("__range")) - F.col("__sum")).alias("__ahead"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = dealt.join(F.broadcast(ahead), "__range")
    return rows.withColumn(name, (F.col("__ahead") + F.sum(weight).over(inside)).cast("long")).drop("__range", "__ahead")


def as_list(df: DataFrame, values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A multi-valued attribute as one sorted, comma-joined list per row; null without values."""
    lists = values.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ",").alias(name))
    return df.join(lists, key, "left")


def each(df: DataFrame, values: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """A multi-valued attribute as one row per distinct value; null without values."""
    return df.join(values.filter(F.col(value).isNotNull()).select(key, F.col(value).alias(name)).distinct(), key, "left")


def group_members(df: DataFrame, by: Sequence[str], subject: str, having: Column, **totals: Column) -> tuple[DataFrame, DataFrame]:
    """Surviving groups, and one row with their number and the distinct subjects under them."""
    groups = group(df, by, subject, **totals).filter(having)
    under = df.join(groups.select(*by), [df[c].eqNullSafe(groups[c]) for c in by], "left_semi") if by else df
    return groups, groups.agg(F.count(F.lit(1)).alias("groups")).crossJoin(under.agg(F.countDistinct(subject).alias("subjects")))


def linked(df: DataFrame, child: DataFrame, key: str, link: str, **aggregates: Column) -> DataFrame:
    """Aggregates of a child set for each row; name them n_... to have none counted as 0."""
    sums = child.groupBy(F.col(link).alias(key)).agg(*[v.alias(k) for k, v in aggregates.items()])
    out = df.join(sums, key, "left")
    return out.fillna(0, [k for k in aggregates if k.startswith("n_")])


def listed(value: Column) -> Column:
    """Aggregate: distinct values sorted and comma-joined."""
    return F.array_join(F.array_sort(F.collect_set(value)), ",")


def attach(df: DataFrame, partner: DataFrame, key: str, name: str, optional: bool = False) -> DataFrame:
    """The partner row at this grain, its columns prefixed; without one the row goes unless optional."""
    other = partner.select(F.col(key), *[F.col(c).alias(f"{name}_{c}") for c in partner.columns if c != key])
    return df.join(other, key, "left" if optional else "inner")


def has(df: DataFrame, related: DataFrame, key: str, link: str, least: int = 1, most: int | None = None, name: str | None = None) -> DataFrame:
    """Rows with a bounded number of related rows."""
    if name is None and most is None and least == 1:
        return df.join(related.select(F.col(link).alias(key)), key, "left_semi")
    if name is None and most == 0:
        return df.join(related.select(F.col(link).alias(key)), key, "left_anti")
    out = linked(df, related, key, link, n_related=F.count(F.lit(1)))
    out = out.filter((F.col("n_related") >= least) & (F.lit(True) if most is None else F.col("n_related") <= most))
    return out.withColumnRenamed("n_related", name) if name else out.drop("n_related")


def _in_window(offset: Column, lo: int | None, hi: int | None) -> Column:
    ok = F.lit(True)
    ok = ok if lo is None else ok & (offset >= lo)
    return ok if hi is None else ok & (offset <= hi)


def _by_day(anchor: DataFrame, partner: DataFrame, subject: str, lo: int | None, hi: int | None, bucket: int | None) -> DataFrame:
    """Pairs of the same subject; with a bucket width, of neighbouring day buckets only (both sides have __day)."""
    if bucket is None or lo is None or hi is None:
        return anchor.join(partner, subject)
    number = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01")) / bucket)
    left = anchor.withColumn("__bucket", F.explode(F.sequence(number(F.date_add("__anchor", lo)), number(F.date_add("__anchor", hi)))))
    return left.join(partner.withColumn("__bucket", number(F.col("__partner"))), [subject, "__bucket"]).drop("__bucket")


_FIRST_DAY, _LAST_DAY = "0001-01-01", "9999-12-31"


def _neighbours(anchor_days: DataFrame, days: DataFrame, at: Mapping[str, int | None], rows: int) -> DataFrame:
    """For each (__s, __anchor) and name in `at`, the days of the same subject next to __anchor + offset: {name}_before (at or before it) and {name}_after.

    days are (__s, __day, __v), a row for each day of a subject; the line has `rows` rows at most.  Both sides are distinct days, so even a subject with a third of
    all rows is a short line here: what is sorted grows with days, not with rows.  Offset None lies behind all days for "hi", before them else.
    """

    def place(name: str, offset: int | None) -> Column:
        return F.date_add("__anchor", offset) if offset is not None else F.lit(_LAST_DAY if name == "hi" else _FIRST_DAY).cast("date")

    asked = F.array(*[F.struct(place(n, o).alias("__day"), F.lit(n).alias("__slot")) for n, o in at.items()])
    line = days.select("__s", "__day", F.lit(None).cast("date").alias("__anchor"), F.lit(None).cast("string").alias("__slot"), "__v", F.lit(0).alias("__ask"))
    line = line.unionByName(anchor_days.select("__s", "__anchor", F.inline(asked)).withColumn("__v", F.lit(None).cast(days.schema["__v"].dataType)).withColumn("__ask", F.lit(1)))
    line = dealt(line, rows, "__s")
    reach = lambda *order: Window.partitionBy("__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    seen = line.withColumn("__before", F.last("__v", True).over(reach("__day", "__ask"))).withColumn("__after", F.last("__v", True).over(reach(F.desc("__day"), "__ask"))).filter("__ask = 1")
    pick_ = lambda n, c: F.max(F.when(F.col("__slot") == n, F.col(f"__{c}"))).alias(f"{n}_{c}")
    return seen.groupBy("__s", "__anchor").agg(*[pick_(n, c) for n in at for c in ("before", "after")])


def _per_day(df: DataFrame, rows: int, row: Column | None = None) -> DataFrame:
    """(__s, __day, __v) of (__s, __partner, ...): the day's rows, the subject's rows up to it, and its least row."""
    days = df.filter(F.col("__partner").isNotNull() & F.col("__s").isNotNull()).groupBy("__s", F.to_date("__partner").alias("__day")).agg(F.count(F.lit(1)).alias("n"), *([F.min(row).alias("row")] if row is not None else []))
    days = dealt(days, rows, "__s")
    upto = F.sum("n").over(Window.partitionBy("__s").orderBy("__day").rowsBetween(Window.unboundedPreceding, 0))
    return days.withColumn("upto", upto).select("__s", "__day", F.struct(F.col("__day").alias("day"), "n", "upto", *(["row"] if row is not None else [])).alias("__v"))


def _upto(before: str) -> Column:
    return F.coalesce(F.col(before)["upto"], F.lit(0))


def has_within(df: DataFrame, related: DataFrame, key: str, subject: str, day: str, other_day: str, lo: int | None, hi: int | None, name: str, least: int = 0) -> DataFrame:
    """Number of related rows of the subject whose day lies lo..hi days from this row's, both included: the rows up to the last day less those before the first."""
    left = df.select(F.col(subject).alias("__s"), F.to_date(day).alias("__anchor")).filter("__s is not null and __anchor is not null").distinct()
    few, many = df.count(), related.count()
    days = _per_day(related.select(F.col(subject).alias("__s"), F.col(other_day).alias("__partner")), many)
    found = _neighbours(left, days, {"lo": None if lo is None else lo - 1, "hi": hi}, 2 * few + many)
    found = found.select("__s", "__anchor", (_upto("hi_before") - _upto("lo_before")).alias(name))
    out = df.withColumn("__s", F.col(subject)).withColumn("__anchor", F.to_date(day)).join(found, ["__s", "__anchor"], "left").drop("__s", "__anchor").fillna(0, [name])
    return out.filter(F.col(name) >= least)


def interval_end(day: Column, precision: Column) -> Column:
    """Last day that a coarse date may mean."""
    return F.when(precision == "year", F.make_date(F.year(day), F.lit(12), F.lit(31))).when(precision == "month", F.last_day(day)).otherwise(day)


def interval_start(day: Column, precision: Column) -> Column:
    return F.when(precision == "year", F.trunc(day, "year")).when(precision == "month", F.trunc(day, "month")).otherwise(day)


def near(anchor: DataFrame, partner: DataFrame, *, key: str, subject: str, day: str, partner_key: str, partner_day: str, lo: int | None, hi: int | None, policy: str = "nearest", tie: str = "earlier", best: Sequence[tuple[str | Callable, bool]] = (), name: str = "near", precision: str | None = None, strict: bool = False, optional: bool = False, keep: Sequence[str] = (), bucket: int | None = None) -> DataFrame:
    """Exactly one partner of the same subject inside a signed window of days.

    Adds {name}_key, _date, _offset, _tied, _candidates (and kept columns).  For nearest, first, any and
    last the partner is looked up next to a few days, also where a precision column makes the partner's date
    an interval: strict wants it inside the window, else overlap is enough, and the offset is to the
    nearest edge.  For best over columns of the partner (name, descending), the best of blocks of days are
    kept, and a window is put together from few of them.  No pair is formed in any of these.

    A best term may also be a function of (anchor, partner), each giving a side's column by name; such an order, and best
    among partners with a precision, cannot be reduced before the two meet: the pairs of a subject are formed, of
    neighbouring day buckets if a width is given.
    """
    if policy != "best":
        return (_near_coarse if precision else _near_days)(anchor, partner, key, subject, day, partner_key, partner_day, lo, hi, policy, tie, name, optional, keep, *([precision, strict] if precision else []))
    if not precision and not any(callable(c) for c, _ in best):
        return _near_best(anchor, partner, subject, day, partner_key, partner_day, lo, hi, best, name, optional, keep)
    left = anchor.select(F.col(key).alias("__k"), F.col(subject).alias("__s"), F.col(day).alias("__anchor"), *[F.col(c).alias(f"__a_{c}") for c in anchor.columns])
    right = partner.select(F.col(partner_key).alias("__pk"), F.col(subject).alias("__s"), F.col(partner_day).alias("__partner"), *[F.col(c).alias(f"__c_{c}") for c in keep], *([F.col(precision).alias("__prec")] if precision else []), *[F.col(c).alias(f"__b_{c}") for c in partner.columns])
    pairs = _by_day(left.filter("__anchor is not null"), right.filter("__partner is not null"), "__s", lo, hi, None if precision else bucket)
    if precision:
        start, end = interval_start(F.col("__partner"), F.col("__prec")), interval_end(F.col("__partner"), F.col("__prec"))
        a, b = F.datediff(start, "__anchor"), F.datediff(end, "__anchor")
        inside = _contained(a, b, lo, hi) if strict else _overlaps(a, b, lo, hi)
        offset = _edge(a, b)
    else:
        offset = F.datediff("__partner", "__anchor")
        inside = _in_window(offset, lo, hi)
    pairs = pairs.withColumn("__o", offset).filter(inside)
    terms = [(c(lambda n: F.col(f"__a_{n}"), lambda n: F.col(f"__b_{n}")) if callable(c) else F.col(f"__b_{c}"), down) for c, down in best]
    found = _least(pairs, ["__k"], [-c if down else c for c, down in terms], F.struct("__pk", "__partner", "__o", *[f"__c_{c}" for c in keep]))
    found = found.select(F.col("__k").alias(key), *_named(name, keep, F.col("__row.__o")))
    return anchor.join(found, key, "left" if optional else "inner")


def _contained(a: Column, b: Column, lo: int | None, hi: int | None) -> Column:
    """Whether days a..b after the anchor lie in the window."""
    return _in_window(a, lo, None) & _in_window(b, None, hi)


def _overlaps(a: Column, b: Column, lo: int | None, hi: int | None) -> Column:
    return _in_window(b, lo, None) & _in_window(a, None, hi)


def _edge(a: Column, b: Column) -> Column:
    """Signed days from the anchor to the nearest of days a..b, 0 inside."""
    return F.when(a > 0, a).when(b < 0, b).otherwise(0)


def _least(rows: DataFrame, by: Sequence[str], order: Sequence[Column], row: Column, n: Column | None = None) -> DataFrame:
    """Per group the least row of the least order: __row, __n (rows of that order) and __all (rows); combined before it is shuffled."""
    n = F.lit(1) if n is None else n
    ranked = rows.groupBy(*by, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__order")).agg(F.sum(n).alias("__n"), F.min(row).alias("__row"))
    one = ranked.groupBy(*by).agg(F.min(F.struct("__order", "__n", "__row")).alias("__best"), F.sum("__n").alias("__all"))
    return one.select(*by, "__best.__row", "__best.__n", "__all")


def _named(name: str, keep: Sequence[str], offset: Column) -> list[Column]:
    """The columns that near adds, from __row, __n and __all."""
    row = F.col("__row")
    first = [row["__pk"].alias(f"{name}_key"), row["__partner"].alias(f"{name}_date"), offset.alias(f"{name}_offset")]
    return [*first, (F.col("__n") > 1).alias(f"{name}_tied"), F.col("__all").alias(f"{name}_candidates"), *[row[f"__c_{c}"].alias(f"{name}_{c}") for c in keep]]


def _anchor_days(anchor: DataFrame, subject: str, day: str) -> DataFrame:
    return anchor.select(F.col(subject).alias("__s"), F.to_date(day).alias("__anchor")).filter("__s is not null and __anchor is not null").distinct()


def _given_back(anchor: DataFrame, found: DataFrame, subject: str, day: str, optional: bool) -> DataFrame:
    """Anchor rows with what was found for their subject and day."""
    out = anchor.withColumn("__s", F.col(subject)).withColumn("__anchor", F.to_date(day)).join(found, ["__s", "__anchor"], "left" if optional else "inner")
    return out.drop("__s", "__anchor")


def _partners(partner: DataFrame, subject: str, partner_key: str, partner_day: str, keep: Sequence[str], *more: Column) -> DataFrame:
    rows = partner.select(F.col(partner_key).alias("__pk"), F.col(subject).alias("__s"), F.col(partner_day).alias("__partner"), *[F.col(c).alias(f"__c_{c}") for c in keep], *more)
    return rows.filter("__s is not null and __partner is not null").withColumn("__raw", F.to_date("__partner"))


def _pivot(lo: int | None, hi: int | None) -> int:
    """The day of a window that is next to the anchor."""
    return max(min(0, hi if hi is not None else 0), lo if lo is not None else min(0, hi if hi is not None else 0))


def _near_coarse(anchor: DataFrame, partner: DataFrame, key: str, subject: str, day: str, partner_key: str, partner_day: str, lo: int | None, hi: int | None, policy: str, tie: str, name: str, optional: bool, keep: Sequence[str], precision: str, strict: bool) -> DataFrame:
    """Partners that are days, months or years.

    The intervals of one precision are equal or apart, so those of a subject stand in one order by both ends: a line for
    each precision, with a place for each interval.  What overlaps a window, or lies in it, is a run of such places: its
    number is a difference of running counts, and its nearest, first or last place is next to a few days.  Only these places,
    at most three a line, are compared.
    """
    grain = F.when(F.col(precision).isin("year", "month"), F.col(precision)).otherwise("day")
    rows = _partners(partner, subject, partner_key, partner_day, keep, grain.alias("__grain"))
    rows = rows.withColumn("__s", F.struct("__s", "__grain")).withColumn("__day", interval_start(F.col("__raw"), F.col("__grain"))).withColumn("__end", interval_end(F.col("__raw"), F.col("__grain")))
    same = rows.groupBy("__s", "__day", "__end", F.col("__raw").alias("raw")).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__pk", "__partner", *[f"__c_{c}" for c in keep])).alias("row"))
    pick_ = F.max if policy == "last" or (policy == "nearest" and tie != "earlier") else F.min
    few, many = anchor.count(), partner.count()
    places = dealt(same.groupBy("__s", "__day", "__end").agg(F.sum("n").alias("n"), pick_(F.struct("raw", "n", "row")).alias("pick")), many, "__s")
    along = Window.partitionBy("__s").orderBy("__day")
    place = F.struct(F.col("__day").alias("start"), F.col("__end").alias("end"), "n", F.sum("n").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), "pick")
    line = places.select("__s", "__day", place.alias("__v"))
    line = line.select("__s", "__day", F.struct("__v.*", F.lag("__v").over(along).alias("prev")).alias("__v"))
    asked = _anchor_days(anchor, subject, day)
    left = asked.withColumn("__grain", F.explode(F.array(*[F.lit(g) for g in ("day", "month", "year")]))).select(F.struct("__s", "__grain").alias("__s"), "__anchor")
    found = _neighbours(left, line, {"lo": None if lo is None else lo - 1, "hi": hi, "at": _pivot(lo, hi), "start": lo}, 12 * few + many)
    first_edge, last_edge = F.date_add("__anchor", lo if lo is not None else 0), F.date_add("__anchor", hi if hi is not None else 0)

    def counted(at: str, past: Column) -> Column:
        """Rows of the places up to one, without it where `past` holds."""
        return F.coalesce(F.when(past, F.col(at)["upto"] - F.col(at)["n"]).otherwise(F.col(at)["upto"]), F.lit(0))

    never = F.lit(False)
    if strict:
        upto, before = counted("hi_before", never if hi is None else F.col("hi_before.end") > last_edge), counted("lo_before", never)
    else:
        upto, before = counted("hi_before", never), counted("lo_before", never if lo is None else F.col("lo_before.end") >= first_edge)
    found = found.withColumn("__all", F.greatest(upto - before, F.lit(0)))
    slots = {"nearest": ["at_before", "at_after"], "last": ["hi_before"]}.get(policy, ["start_before", "start_after"] if lo is not None else ["start_after"])
    bare = lambda c: F.struct(*[c[f].alias(f) for f in ("start", "end", "pick")])
    # a place that sticks out of the window leaves the choice to the one before it
    near_by = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), bare(F.col(c))) for c in slots], *[F.when(F.col(c)["prev"].isNotNull(), bare(F.col(c)["prev"])) for c in slots if c.endswith("before")]))
    some = found.select(F.col("__s.__s").alias("__s"), "__anchor", "__all", F.explode_outer(F.array_distinct(near_by)).alias("__place"))
    a, b = F.datediff("__place.start", "__anchor"), F.datediff("__place.end", "__anchor")
    fits = _contained(a, b, lo, hi) if strict else _overlaps(a, b, lo, hi)
    some = some.withColumn("__o", _edge(a, b)).withColumn("__fits", F.coalesce(fits, F.lit(False))).withColumn("__number", F.datediff("__place.pick.raw", F.lit("1970-01-01")))
    order = {"nearest": [F.abs("__o"), F.col("__number") if tie == "earlier" else -F.col("__number")], "last": [-F.col("__number")]}.get(policy, [F.col("__number")])
    row = F.struct(F.col("__place.pick.row.__pk"), F.col("__place.pick.row.__partner"), "__o", *[F.col(f"__place.pick.row.__c_{c}") for c in keep])
    chosen = _least(some.filter("__fits"), ["__s", "__anchor"], order, row, F.col("__place.pick.n")).drop("__all")
    numbers = found.groupBy(F.col("__s.__s").alias("__s"), "__anchor").agg(F.sum("__all").alias("__all"))
    chosen = chosen.join(numbers, ["__s", "__anchor"]).select("__s", "__anchor", *_named(name, keep, F.col("__row.__o")))
    return _given_back(anchor, chosen, subject, day, optional)


#: Blocks of days double in width up to this many times where a window has an open side: 2 ** 22 days are all dates there are.
_LEVELS = 22


def _near_best(anchor: DataFrame, partner: DataFrame, subject: str, day: str, partner_key: str, partner_day: str, lo: int | None, hi: int | None, best: Sequence[tuple[str, bool]], name: str, optional: bool, keep: Sequence[str]) -> DataFrame:
    """The best partner by its own columns.

    Each subject's days are kept in blocks of 1, 2, 4, ... days, a block with its least order, how
    many rows have it, the least of them and how many rows there are; a window is two blocks of a width at most.
    """
    rows = _partners(partner, subject, partner_key, partner_day, keep, *[F.col(c).alias(f"__b{i}") for i, (c, _) in enumerate(best)])
    order = [-F.col(f"__b{i}") if down else F.col(f"__b{i}") for i, (_, down) in enumerate(best)]
    number = lambda d: F.datediff(d, F.lit(_FIRST_DAY))
    order = F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]).alias("__order")
    one = F.lit(1).cast("bigint")
    rows = rows.select("__s", number(F.col("__raw")).alias("__block"), order, one.alias("__n"), F.struct("__pk", "__partner", *[f"__c_{c}" for c in keep]).alias("__row"), one.alias("__rows"))
    days = _merged(rows, "__s", "__block")
    levels = _LEVELS if lo is None or hi is None else max(0, hi - lo + 1).bit_length()
    at = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__level")
    blocks = days.select("__s", "__block", "__order", "__n", "__row", "__rows", at).withColumn("__block", F.expr("shiftright(__block, __level)"))
    blocks = _merged(blocks, "__s", "__level", "__block")
    asked = _anchor_days(anchor, subject, day)
    if lo is None or hi is None:  # an open side ends with the subject's days
        asked = asked.join(days.groupBy("__s").agg(F.min("__block").alias("__least"), F.max("__block").alias("__most")), "__s")
    begin = F.col("__least") if lo is None else number(F.col("__anchor")) + lo
    end = F.col("__most") + 1 if hi is None else number(F.col("__anchor")) + hi + 1
    asked = asked.withColumn("__from", begin).withColumn("__to", end)
    parts = []
    for level in range(levels + 1):
        # begin rounded up and end rounded down to this width: what sticks out on either side is a block of this width, not in a larger one
        a, b = F.ceil(F.col("__from") / (1 << level)).cast("int"), F.floor(F.col("__to") / (1 << level)).cast("int")
        block = lambda c, level=level: F.struct(F.lit(level).alias("__level"), c.alias("__block"))
        parts += [F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), block(a)), F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), block(b - 1))]
    asked = asked.select("__s", "__anchor", F.inline(F.array_compact(F.array(*parts))))
    found = _merged(asked.join(blocks, ["__s", "__level", "__block"]), "__s", "__anchor")
    found = found.select("__s", "__anchor", "__row", "__n", F.col("__rows").alias("__all"))
    return _given_back(anchor, found.select("__s", "__anchor", *_named(name, keep, F.datediff("__row.__partner", "__anchor"))), subject, day, optional)


def _merged(blocks: DataFrame, *by: str) -> DataFrame:
    """Blocks of a group as one: the least order, the rows that have it (__n), the least of them, and all rows."""
    same = blocks.groupBy(*by, "__order").agg(F.sum("__n").alias("__n"), F.min("__row").alias("__row"), F.sum("__rows").alias("__rows"))
    one = same.groupBy(*by).agg(F.min(F.struct("__order", "__n", "__row")).alias("__least"), F.sum("__rows").alias("__rows"))
    return one.select(*by, "__least.*", "__rows")


def _near_days(anchor: DataFrame, partner: DataFrame, key: str, subject: str, day: str, partner_key: str, partner_day: str, lo: int | None, hi: int | None, policy: str, tie: str, name: str, optional: bool, keep: Sequence[str]) -> DataFrame:
    row = F.struct(F.col("__pk"), F.col("__partner"), *[F.col(f"__c_{c}") for c in keep])
    right = partner.select(F.col(partner_key).alias("__pk"), F.col(subject).alias("__s"), F.col(partner_day).alias("__partner"), *[F.col(c).alias(f"__c_{c}") for c in keep])
    few, many = anchor.count(), partner.count()
    found = _neighbours(_anchor_days(anchor, subject, day), _per_day(right, many, row), {"lo": None if lo is None else lo - 1, "hi": hi, "at": _pivot(lo, hi), "start": lo}, 4 * few + many)
    off = lambda c: F.datediff(F.col(c)["day"], "__anchor")
    inside = lambda c: F.when(_in_window(off(c), lo, hi), F.col(c))
    found = found.withColumn("__b", inside("at_before")).withColumn("__a", inside("at_after"))
    if policy == "nearest":
        far_b, far_a = F.abs(off("__b")), F.abs(off("__a"))
        closer = (far_b <= far_a) if tie == "earlier" else (far_b < far_a)
        best = F.when(F.col("__a").isNull() | closer, F.col("__b")).otherwise(F.col("__a"))
    else:
        best = inside("hi_before") if policy == "last" else inside("start_after")
    found = found.withColumn("__best", best).filter("__best is not null").withColumn("__all", _upto("hi_before") - _upto("lo_before"))
    rest = [F.col(f"__best.row.__c_{c}").alias(f"{name}_{c}") for c in keep]
    found = found.select("__s", "__anchor", F.col("__best.row.__pk").alias(f"{name}_key"), F.col("__best.row.__partner").alias(f"{name}_date"), off("__best").alias(f"{name}_offset"), (F.col("__best.n") > 1).alias(f"{name}_tied"), F.col("__all").alias(f"{name}_candidates"), *rest)
    return _given_back(anchor, found, subject, day, optional)


def pick(df: DataFrame, per: str, by: Sequence[Column], key: str, n: int = 1, ties: str = "keep") -> DataFrame:
    """First n rows per ancestor, with pick_rank, pick_candidates and pick_tied; ties="refuse" drops tied picks, "raise" fails."""
    few = first_n(df, [per], [*by, F.col(key)], key, n + 1, "pick_rank")  # one more shows whether the last is tied
    few = few.withColumn("__r", F.rank().over(Window.partitionBy(per).orderBy(*by))).withColumn("pick_tied", F.count(F.lit(1)).over(Window.partitionBy(per, "__r")) > 1)
    out = beside(few.filter(F.col("pick_rank") <= n).drop("__r"), df.groupBy(per).agg(F.count(F.lit(1)).alias("pick_candidates")), [per])
    if ties == "refuse":
        return out.filter(~F.col("pick_tied"))
    if ties == "raise":
        return out.withColumn("pick_tied", F.when(F.col("pick_tied"), F.raise_error(F.lit("a pick is tied"))).otherwise(F.lit(False)))
    return out


def same(df: DataFrame, over: DataFrame, key: str, link: str, by: Sequence[str], least: int | None = None, all_: bool = False) -> DataFrame:
    """same_largest, the largest group of descendant rows that share a tuple, and same_groups, the number of groups."""
    groups = over.groupBy(F.col(link).alias(key), *by).agg(F.count(F.lit(1)).alias("__n"))
    sums = groups.groupBy(key).agg(F.max("__n").alias("same_largest"), F.count(F.lit(1)).alias("same_groups"))
    out = df.join(sums, key)
    out = out if least is None else out.filter(F.col("same_largest") >= least)
    return out.filter("same_groups = 1") if all_ else out


def every(df: DataFrame, of_: DataFrame, inside: DataFrame, key: str, link: str, member: str, vacuous: bool = False) -> DataFrame:
    """Rows none of whose members of `of_` lies outside `inside`; without vacuous, with one member at least."""
    outside = of_.join(inside.select(member), member, "left_anti")
    out = df.join(outside.select(F.col(link).alias(key)), key, "left_anti")
    return out if vacuous else out.join(of_.select(F.col(link).alias(key)), key, "left_semi")


def pairs(df: DataFrame, key: str, subject: str, day: str, lo: int, hi: int, policy: str = "nearest", name: str = "later") -> DataFrame:
    """Each row with one later row of its subject inside the window."""
    return near(df, df, key=key, subject=subject, day=day, partner_key=key, partner_day=day, lo=max(1, lo), hi=hi, policy=policy, name=name)


def change(df: DataFrame, subject: str, day: str, key: str, value: str, before: str, after: str, adjacent: bool = True) -> DataFrame:
    """Per subject the first row of `after` right behind a row of `before` (or anywhere behind one): dates and the gap."""
    w = Window.partitionBy(subject).orderBy(F.col(day).asc_nulls_last(), key)
    earlier = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = df.select(subject, day, key, value)
    if adjacent:
        rows = rows.withColumn("from_date", F.when(F.lag(value).over(w) == before, F.lag(day).over(w)))
    else:
        rows = rows.withColumn("from_date", F.max(F.when(F.col(value) == before, F.col(day))).over(earlier))
    hits = rows.filter((F.col(value) == after) & F.col("from_date").isNotNull())
    first = hits.groupBy(subject).agg(F.min(F.struct(F.col(day).alias("to_date"), F.col(key).alias("to_key"), "from_date")).alias("c"))
    return first.select(subject, "c.to_date", "c.to_key", "c.from_date", F.datediff("c.to_date", "c.from_date").alias("gap_days"))


def picked(df: DataFrame, picks: DataFrame, key: str, role: str) -> DataFrame:
    """Rows that the stored picks of a role name."""
    return df.join(picks.filter(F.col("role") == role).select(key), key, "left_semi")


def pipeline(df: DataFrame, *stages: Callable[[DataFrame], DataFrame]) -> DataFrame:
    return reduce(lambda d, f: f(d), stages, df)
