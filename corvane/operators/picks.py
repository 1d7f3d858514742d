"""Scored picks: one unit per session and role, with its score's parts, runner-up, margin and borders."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.plans.storage import small_or_shuffled

from .sets import cumulated

POINTS = (0.05, 0.25, 0.5, 0.75, 0.95)


def shares(df: DataFrame, axis: str) -> DataFrame:
    """(value, n, share) of an axis in the reference population."""
    n = df.filter(F.col(axis).isNotNull()).groupBy(F.col(axis).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("__all")))).select("value", "n", F.round(F.col("n") / F.col("__all"), 9).alias("share"))


def percentiles(df: DataFrame, by: str, value: str, least: int = 3) -> DataFrame:
    """Per group the value at sorted place round(q (n - 1)) for each of POINTS; groups with fewer than `least` values have none.

    Equal values of a group are counted before anything is ordered, and all groups are ordered together by ranges, so neither
    a large group nor a common value fills a task.
    """
    values = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    rows = cumulated(values, [by, value], "__n", "__upto")
    per = rows.groupBy(by).agg(F.min(F.col("__upto") - F.col("__n")).alias("__before"), F.sum("__n").alias("__size")).filter(F.col("__size") >= least).withColumnRenamed(by, "__by")
    placed = rows.join(small_or_shuffled(per), F.col(by).eqNullSafe(F.col("__by"))).withColumn("__to", F.col("__upto") - F.col("__before"))
    holds = {q: (F.round(F.lit(q) * (F.col("__size") - 1)) < F.col("__to")) & (F.round(F.lit(q) * (F.col("__size") - 1)) >= F.col("__to") - F.col("__n")) for q in POINTS}
    found = placed.filter(reduce(lambda a, b: a | b, holds.values()))
    return found.groupBy(by).agg(*[F.min(F.when(h, F.col(value))).alias(f"p{round(q * 100):02d}") for q, h in holds.items()])


def percentile_bucket(x: Column, points: Sequence[Column]) -> Column:
    """How many of the reference points a value lies above."""
    return sum(((x > p).cast("int") for p in points), F.lit(0))


def score(df: DataFrame, parts: Mapping[str, tuple[float, Column]], penalty: Column | None = None) -> DataFrame:
    """Adds score (weighted mean of the parts times the penalty factor, 0 to 1) and one column s_<part> each; a null part counts 0."""
    total = sum(w for w, _ in parts.values())
    out = df.select("*", *[F.round(F.coalesce(c.cast("double"), F.lit(0.0)), 9).alias(f"s_{n}") for n, (_, c) in parts.items()])
    mean = sum((F.col(f"s_{n}") * w for n, (w, _) in parts.items()), F.lit(0.0)) / total
    return out.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), mean * (F.lit(1.0) if penalty is None else penalty))), 9))


def families(df: DataFrame, by: Sequence[str], key: str, score_: str) -> DataFrame:
    """Related units as one candidate: its best member stands for it, with the number of members."""
    return df.groupBy(*by).agg(F.max_by(key, F.struct(score_, -F.col(key))).alias(key), F.max(score_).alias(score_), F.count(F.lit(1)).alias("members"))


def choose(df: DataFrame, per: Sequence[str], key: str, score_: str = "score", close: float = 0.02, steps: Sequence[Column] = ()) -> DataFrame:
    """Winner per group with score, runner_up, margin and candidates.

    Candidates whose score is short of the best by `close` of it at most are ordered by the declared steps
    first; exact ties end with the key.  The margin is the runner-up's shortfall as a part of the winner's score:
    1 for a lone candidate, 0 where the winner's score is 0.
    """
    w = Window.partitionBy(*per)
    top = F.max(score_).over(w)
    rows = df.withColumn("__near", F.coalesce(F.round(F.try_divide(top - F.col(score_), top), 9), F.lit(0.0)) <= close)
    order = [F.desc("__near"), *[F.when(F.col("__near"), s).asc_nulls_last() for s in steps], F.desc(score_), F.asc(key)]
    rows = rows.withColumn("__r", F.row_number().over(w.orderBy(*order)))
    best = F.max(F.when(F.col("__r") == 1, F.col(score_)))
    second = F.max(F.when(F.col("__r") == 2, F.col(score_)))
    return rows.groupBy(*per).agg(F.max(F.when(F.col("__r") == 1, F.col(key))).alias(key), best.alias("score"), F.max(F.when(F.col("__r") == 2, F.col(key))).alias("runner_up"), F.coalesce(F.round(F.try_divide(best - F.coalesce(second, F.lit(0.0)), best), 9), F.lit(0.0)).alias("margin"), F.count(F.lit(1)).alias("candidates"))


def borders(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """The names of the borders that hold, comma-joined."""
    return df.withColumn("borders", F.array_join(F.array_compact(F.array(*[F.when(c, n) for n, c in flags.items()])), ","))


def more_borders(groups: DataFrame, candidates: DataFrame, chosen: DataFrame, per: str, key: str, score_: str, *, close: float, shares_: DataFrame, rare_of: str, rare: float, dim: str, slices: str, points: DataFrame, family: str, moment: str, tokens: str, twin_at: float, fallback: tuple[str, Sequence[str]], rival: tuple[str, str, float]) -> DataFrame:
    """(per, key, borders) for every group, the ones without a candidate too: why a person should look at the pick.

    nothing; too_close (the margin is `close` at most); rare (the winner's value has a smaller share than `rare` of the reference); retake (its
    family was acquired at several moments); unknown_dim; slice_outlier (outside p05 to p95 of its dimension's population);
    pre_post_twin (a candidate at or above twin_at of the winner's score shares no token with it); fallback (the winner holds one of some values); rival
    (family, token, fraction: the winner is of the family, and a candidate without the token is within the fraction of its score).
    """
    w = chosen.join(candidates.select(per, F.col(key), F.col(family).alias("__family"), F.col(rare_of).alias("__value"), F.col(dim).alias("__dim"), F.col(slices).alias("__slices"), F.col(tokens).alias("__tokens"), F.col(fallback[0]).alias("__fall")), [per, key])
    side = w.select(per, F.col(key).alias("__k"), F.col("score").alias("__top"), "__family", "__tokens")
    others = candidates.join(side, per)
    rest = F.col(key) != F.col("__k")
    twin = rest & (F.round(F.col(score_) - F.lit(twin_at) * F.col("__top"), 9) >= 0) & ~F.coalesce(F.arrays_overlap(tokens, "__tokens"), F.lit(False))
    gap = F.round(F.try_divide(F.col("__top") - F.col(score_), F.col("__top")), 9)
    near_ = rest & ~F.array_contains(tokens, rival[1]) & (gap <= rival[2]) & (F.col("__family") == rival[0])
    facts = others.groupBy(per).agg(F.countDistinct(F.when(F.col(family).eqNullSafe(F.col("__family")), F.col(moment))).alias("__takes"), F.max(twin.cast("int")).alias("__twin"), F.max(near_.cast("int")).alias("__rival"))
    w = w.join(facts, per).join(small_or_shuffled(shares_.select(F.col("value").alias("__value"), F.col("share").alias("__share"))), "__value", "left").join(small_or_shuffled(points.select(F.col(dim).alias("__dim"), "p05", "p95")), "__dim", "left")
    out = groups.select(per).join(w, per, "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    flags = {
        "nothing": F.col(key).isNull(),
        "too_close": yes((F.col("candidates") > 1) & (F.col("margin") <= close)),
        "rare": F.col(key).isNotNull() & yes(F.coalesce(F.col("__share"), F.lit(0.0)) < rare),
        "retake": yes(F.col("__takes") > 1),
        "unknown_dim": F.col(key).isNotNull() & (F.coalesce(F.trim(F.col("__dim").cast("string")), F.lit("")) == ""),
        "slice_outlier": yes((F.col("__slices") > 0) & ((F.col("__slices") < F.col("p05")) | (F.col("__slices") > F.col("p95")))),
        "pre_post_twin": yes(F.col("__twin") == 1),
        "fallback": yes(F.col("__fall").isin(list(fallback[1]))),
        "rival": yes(F.col("__rival") == 1),
    }
    return borders(out, flags).select(per, key, "borders")


def eligible(df: DataFrame, rules: DataFrame, scopes: Sequence[tuple[str, Column]], kind: str) -> DataFrame:
    """Rows with the place of their kind under the most specific rule: rules are (scope, ref, kind, place), scopes from widest to narrowest; a null place leaves the kind out."""
    out, place = df, F.lit(None).cast("int")
    for i, (scope, ref) in enumerate(scopes):
        r = rules.filter(F.col("scope") == scope).select(F.col("ref").alias("__ref"), F.col("kind").alias(kind), F.struct("place").alias(f"__rule{i}")).dropDuplicates(["__ref", kind])
        out = out.withColumn("__ref", ref.cast("string")).join(small_or_shuffled(r), ["__ref", kind], "left").drop("__ref")
        place = F.when(F.col(f"__rule{i}").isNotNull(), F.col(f"__rule{i}.place")).otherwise(place)
    return out.withColumn("place", place).filter("place is not null").select(*df.columns, "place")


def overridden(picks: DataFrame, persons: DataFrame, per: Sequence[str], key: str) -> DataFrame:
    """A person's pick stands over the computed one."""
    own = persons.select(*per, F.col(key).alias("__own"))
    return picks.join(own, list(per), "left").withColumn("by_person", F.col("__own").isNotNull()).withColumn(key, F.coalesce("__own", key)).drop("__own")


def rekey(picks: DataFrame, moved: DataFrame, session: str) -> DataFrame:
    """Picks after sessions moved: moved is (session, to), null `to` withdraws the pick."""
    out = picks.join(moved.select(session, "to", F.lit(True).alias("__moved")), session, "left")
    return out.filter(F.col("__moved").isNull() | F.col("to").isNotNull()).withColumn(session, F.coalesce("to", session)).drop("to", "__moved")


def kind_map(df: DataFrame, by: str, subject: str, place: str, kind: str) -> DataFrame:
    """How often each sequence of kinds over a subject's sessions occurs, per scanner or dataset."""
    lines = df.groupBy(by, subject).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place, kind))), lambda x: x[kind]), ">").alias("kinds"))
    return lines.groupBy(by, "kinds").agg(F.count(F.lit(1)).alias("subjects"))
