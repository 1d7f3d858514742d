"""Release planning on tables: names, collisions, repeat tests, routes, version diffs, quality bars."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.plans.storage import dealt, small_or_shuffled, stored

from .firsts import beside
from .sets import numbered


def safe(text: Column) -> Column:
    """Letters and digits only, other runs as one dash."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def descriptive(parts: Sequence[Column]) -> Column:
    return F.concat_ws("_", *[F.nullif(safe(p), F.lit("")) for p in parts])


def standard_name(df: DataFrame, mapping: DataFrame, on: Sequence[str], need: Sequence[str]) -> DataFrame:
    """Name from a small mapping table, or the reason it is refused."""
    out = df.join(small_or_shuffled(mapping), list(on), "left")
    reason = F.when(F.col("name").isNull(), "no mapping")
    for c in reversed(need):
        reason = F.when(F.col(c).isNull(), f"no {c}").otherwise(reason)
    return out.withColumn("reason", reason).withColumn("name", F.when(F.col("reason").isNull(), F.col("name")))


#: Rounds after which naming gives up: each settles or splits every shared name, so a handful do.
_ROUNDS = 64
#: Rows of a group that names are settled in inside one task, and rounds that this takes before what is still shared goes on.
WHOLE_GROUP = 10_000
AT_ONCE = 3


def disambiguate(df: DataFrame, by: Sequence[str], name: str, key: str, echo: str, inversion: str, steps: Sequence[tuple[str, str]], own: str | None = None) -> DataFrame:
    """Adds unique_name: names that no other row of the group `by` has.

    Echo numbers go first, as _e<echo>, to rows whose name is shared; a name that stands alone takes its series' own
    suffix, if column `own` has one.  Then, as long as any name is shared: its rows are numbered by inversion time
    where all have one and no two the same; else the first property (column, prefix) whose text tells any two apart is added, rows
    without it keeping their name; else they are numbered in key order.  A new name can meet one that was settled
    before; both are shared then and go on.

    Groups of up to WHOLE_GROUP rows are dealt out once and go through AT_ONCE rounds where they lie, by windows.  Larger
    groups, and those that still share a name then, go on in rounds of one aggregation over names, which touch only
    shared ones; there numbers come from ranges, so a name may be that of any part of the rows.
    """
    told = [F.coalesce(F.concat(F.lit(f"_{prefix}"), safe(F.col(c).cast("string"))), F.lit("")).alias(f"__token{i}") for i, (c, prefix) in enumerate(steps)]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__all"), *by, F.monotonically_increasing_id().alias("__row"), F.col(key).alias("__key"), F.col(name).alias("unique_name"), F.col(echo).cast("string").alias("__echo"), (F.col(own) if own else F.lit(None)).cast("string").alias("__own"), F.col(inversion).alias("__time"), *told)
    rows = stored(rows)
    out = lambda x: x.select("__all.*", "unique_name")
    if not by:
        return out(_name_rounds(_echoed(beside(rows, rows.groupBy("unique_name").agg(F.count(F.lit(1)).alias("__n")), ["unique_name"])), by, len(steps)))
    large = stored(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__size")).filter(F.col("__size") > WHOLE_GROUP).withColumn("__large", F.lit(True)).drop("__size"))
    rest = None
    if not large.isEmpty():
        parted = beside(rows, small_or_shuffled(large), by, "left")
        rows, rest = parted.filter("__large is null").drop("__large"), parted.filter("__large").drop("__large")
        rest = _echoed(beside(rest, rest.groupBy(*by, "unique_name").agg(F.count(F.lit(1)).alias("__n")), [*by, "unique_name"]))
    spread = dealt(rows, rows.count(), *by)
    spread = rows.repartition(*by) if spread is rows else spread
    alike = Window.partitionBy(*by, "unique_name")
    spread = _echoed(spread.withColumn("__n", F.count(F.lit(1)).over(alike)))
    for _ in range(AT_ONCE):
        spread = _renamed(spread, [*by, "unique_name"], len(steps))
    shared = (F.col("__n") > 1) & F.col("unique_name").isNotNull()
    spread = stored(spread.withColumn("__n", F.count(F.lit(1)).over(alike)).withColumn("__open", F.max(shared).over(Window.partitionBy(*by))).drop("__n"))
    left = spread.filter("__open").drop("__open")
    if rest is None and left.isEmpty():
        return out(spread)
    left = left if rest is None else left.unionByName(rest)
    return out(spread.filter("not __open")).unionByName(out(_name_rounds(left, by, len(steps))))


def _echoed(rows: DataFrame) -> DataFrame:
    """Echo numbers to names that __n rows share, own suffixes to others."""
    more = F.when(F.col("__n") > 1, F.concat(F.lit("_e"), "__echo")).otherwise(F.concat(F.lit("_"), "__own"))
    return rows.withColumn("unique_name", F.concat("unique_name", F.coalesce(more, F.lit("")))).drop("__n", "__echo", "__own")


def _telling(n: int, of=lambda c: c) -> Column:
    """The number of the first token that tells any two apart."""
    return reduce(lambda out, i: F.when(of(F.min(f"__token{i}")) != of(F.max(f"__token{i}")), i).otherwise(out), reversed(range(n)), F.lit(None).cast("int"))


def _token(n: int) -> Column:
    return F.element_at(F.array(*[F.col(f"__token{i}") for i in range(n)] or [F.lit("")]), F.col("__step") + 1)


def _renamed(rows: DataFrame, at: Sequence[str], tokens: int) -> DataFrame:
    """One round over rows whose groups lie together."""
    w, kept = Window.partitionBy(*at), rows.columns
    last = [F.col(c).asc_nulls_last() for c in ("__time", "__key", "__row")]
    rows = rows.withColumn("__by_time", F.row_number().over(w.orderBy(*last))).withColumn("__times", F.dense_rank().over(w.orderBy(last[0])))
    rows = rows.withColumn("__by_key", F.row_number().over(w.orderBy(*last[1:])))
    rows = rows.select("*", F.count(F.lit(1)).over(w).alias("__n"), F.count("__time").over(w).alias("__with_time"), F.max("__times").over(w).alias("__most"), _telling(tokens, lambda c: c.over(w)).alias("__step"))
    timed = (F.col("__with_time") == F.col("__n")) & (F.col("__most") == F.col("__n"))
    more = F.when(timed, F.concat(F.lit("_ti"), "__by_time")).when(F.col("__step").isNotNull(), _token(tokens)).otherwise(F.concat(F.lit("_"), "__by_key"))
    return rows.withColumn("unique_name", F.when(F.col("__n") > 1, F.concat("unique_name", more)).otherwise(F.col("unique_name"))).select(*kept)


def _name_rounds(rows: DataFrame, by: Sequence[str], tokens: int) -> DataFrame:
    """Rows after as many rounds as it takes until no name is shared, whatever the size of a name."""
    at, rows = [*by, "unique_name"], stored(rows)
    for _ in range(_ROUNDS):
        timed = (F.count("__time") == F.count(F.lit(1))) & (F.countDistinct("__time") == F.count(F.lit(1)))
        groups = stored(rows.groupBy(*at).agg(F.count(F.lit(1)).alias("__n"), timed.alias("__timed"), _telling(tokens).alias("__step")).filter("__n > 1 and unique_name is not null"))
        if groups.isEmpty():
            return rows
        pool = beside(rows, groups, at, "left")
        settled, pool = pool.filter("__n is null"), pool.filter("__n is not null")
        split = pool.filter("not __timed and __step is not null").withColumn("__more", _token(tokens))
        counted = pool.filter("__timed or __step is null").withColumn("__by_time", F.when(F.col("__timed"), F.col("__time")))
        counted = stored(numbered(counted, [*at, "__by_time", "__key", "__row"], "__at"))
        place = F.col("__at") - F.col("__before")
        counted = beside(counted, counted.groupBy(*at).agg((F.min("__at") - 1).alias("__before")), at).withColumn("__more", F.concat(F.when(F.col("__timed"), "_ti").otherwise("_"), place.cast("string")))
        kept = rows.columns
        named = split.select(*kept, "__more").unionByName(counted.select(*kept, "__more")).withColumn("unique_name", F.concat("unique_name", "__more"))
        rows = stored(settled.select(*kept).unionByName(named.select(*kept)))
    raise RuntimeError("names did not settle")


def repeats(df: DataFrame, by: Sequence[str], relative: Mapping[str, float], absolute: Mapping[str, float], exact: Sequence[str], moment: str | None = None) -> DataFrame:
    """Per group whether every pair of members agrees in every field; what is absent is no difference; the fields that differ; and,
    with a moment, whether members that agree were acquired at one and the same moment (written twice, not repeated).

    Every pair agrees if the two farthest do, so extremes decide and no pair is listed: least
    and greatest within the tolerance, at most one exact value.
    """
    differ = []
    for c, t in relative.items():
        differ.append(F.when(F.max(c) - F.min(c) > t * F.greatest(F.abs(F.max(c)), F.abs(F.min(c))), c))
    for c, t in absolute.items():
        differ.append(F.when(F.max(c) - F.min(c) > t, c))
    differ += [F.when(F.countDistinct(c) > 1, c) for c in exact]
    once = (F.count(moment) < F.count(F.lit(1))) | (F.countDistinct(moment) == F.count(F.lit(1))) if moment else F.lit(True)
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.array_join(F.array_compact(F.array(*differ)), ",").alias("differing"), once.alias("__once"))
    alike = (F.col("members") > 1) & (F.col("differing") == "")
    out = g.withColumn("repeat", alike & F.col("__once"))
    return (out.withColumn("written_twice", alike & ~F.col("__once")) if moment else out).drop("__once")


def separator(df: DataFrame, by: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The first field, in the order given, that tells all members of a group apart."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), *[F.countDistinct(c).alias(f"__{c}") for c in fields])
    first = F.lit(None).cast("string")
    for c in reversed(fields):
        first = F.when(F.col(f"__{c}") == F.col("members"), c).otherwise(first)
    return g.filter("members > 1").select(*by, "members", first.alias("separator"))


def route(df: DataFrame, rules: Sequence[tuple[Column, str, str]], otherwise: tuple[str, str]) -> DataFrame:
    """Where each unit goes and why: the first rule that holds."""
    where, why = F.lit(otherwise[0]), F.lit(otherwise[1])
    for c, place, reason in reversed(rules):
        c = F.coalesce(c, F.lit(False))
        where, why = F.when(c, place).otherwise(where), F.when(c, reason).otherwise(why)
    return df.withColumn("route", where).withColumn("reason", why)


def versions(old: DataFrame, new: DataFrame, key: str, digest: str, place: str) -> DataFrame:
    """Each unit's change between two versions: unchanged, moved, rewritten, added or removed."""
    a = old.select(key, F.col(digest).alias("__d1"), F.col(place).alias("__p1"), F.lit(1).alias("__a"))
    b = new.select(key, F.col(digest).alias("__d2"), F.col(place).alias("__p2"), F.lit(1).alias("__b"))
    change = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(~F.col("__d1").eqNullSafe(F.col("__d2")), "rewritten").when(~F.col("__p1").eqNullSafe(F.col("__p2")), "moved").otherwise("unchanged")
    return a.join(b, key, "full_outer").select(key, change.alias("change"))


def named_by(subjects: DataFrame, identifiers: DataFrame, subject: str, value: str) -> DataFrame:
    """Subjects under another identifier: clean, collision (two subjects, one name), or missing."""
    named = subjects.select(subject).join(identifiers.select(subject, F.trim(value).alias("name")), subject, "left")
    shared = named.filter("name is not null").groupBy("name").agg(F.countDistinct(subject).alias("__n"))
    out = named.join(shared, "name", "left")
    return out.select(subject, "name", F.when(F.col("name").isNull(), "missing").when(F.col("__n") > 1, "collision").otherwise("clean").alias("state"))


def _failing(units: DataFrame, placed: DataFrame, key: str, name: str, changes: DataFrame, picks: DataFrame, sessions: DataFrame, events: DataFrame, subject: str, day: str, within: int) -> dict[str, DataFrame]:
    """By bar the rows that fail it, each as one text."""
    from .sets import near

    mine = events.join(sessions.select(subject).distinct(), subject, "left_semi").withColumn("__e", F.monotonically_increasing_id())
    found = near(mine.select("__e", subject, day), sessions.select(F.xxhash64(subject, day).alias("__k"), subject, day), key="__e", subject=subject, day=day, partner_key="__k", partner_day=day, lo=-within, hi=within, optional=True)
    row = lambda df, *c: df.select(F.concat_ws("|", *[F.col(x).cast("string") for x in c]).alias("row"))
    return {
        "placed or accounted for": row(units.join(placed, key, "left_anti"), key),
        "unique names": row(placed.groupBy(name).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), name),
        "unchanged re-run": row(changes.filter("change != 'unchanged'"), key),
        "picks present": row(picks.select(key).distinct().join(placed, key, "left_anti"), key),
        "dates join the events": row(found.filter("near_key is null"), subject, day),
    }


def failing_rows(*tables, **how) -> DataFrame:
    """(bar, row): a row for everything that fails a bar of quality_bars, which takes the same arguments."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(bar).alias("bar"), "row") for bar, df in _failing(*tables, **how).items()])


def quality_bars(units: DataFrame, placed: DataFrame, key: str, name: str, changes: DataFrame, picks: DataFrame, sessions: DataFrame, events: DataFrame, subject: str, day: str, within: int) -> DataFrame:
    """Failing rows per bar: units neither placed nor accounted for, names used twice, work in an unchanged re-run, picked units that are not
    placed, and clinical events of the release's subjects without a session within so many days."""
    bars = _failing(units, placed, key, name, changes, picks, sessions, events, subject, day, within)
    return reduce(DataFrame.unionByName, [df.agg(F.lit(bar).alias("bar"), F.count(F.lit(1)).alias("failing")) for bar, df in bars.items()])
