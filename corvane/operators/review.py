"""Review, sampling, agreement and certification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.plans.storage import small_or_shuffled

from .firsts import first_n

AUTHORS = {"model": 1, "agent": 2, "person": 3}
SCOPES = {"subject": 1, "series": 2, "group": 3, "stack": 4}
BANDS = (0.9, 0.95, 0.99)


def unit_hash(seed: str, *columns: str) -> Column:
    """Hex digest that orders rows by seed alone."""
    return F.sha2(F.concat_ws(":", F.lit(seed), *columns), 256)


def fraction(hash_: Column) -> Column:
    """A digest as a number in [0, 1), from its first 13 hex digits, which a double holds exactly."""
    return F.conv(F.substring(hash_, 1, 13), 16, 10).cast("double") / F.lit(2.0**52)


def first_keys(df: DataFrame, by: Sequence[str], key: str, n: int, count: str, name: str) -> DataFrame:
    """Per group its rows, and its n least keys comma-joined; a group is dealt over parts that keep n keys each, so none is ever gathered."""
    by = list(by)
    part = Window.partitionBy(*by, "__part").orderBy(key)
    few = df.select(*by, key, F.pmod(F.xxhash64(key), F.lit(64)).alias("__part")).withColumn("__r", F.row_number().over(part)).filter(F.col("__r") <= n)
    lists = few.groupBy(*by).agg(F.slice(F.array_sort(F.collect_list(key)), 1, n).cast("array<string>").alias("__k"))
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias(count))
    same = [counts[c].eqNullSafe(lists[c]) for c in by]
    return counts.join(lists, same, "left").select(*[counts[c] for c in by], count, F.array_join("__k", ",").alias(name))


def grouped_questions(df: DataFrame, kind: str, evidence: str, key: str) -> DataFrame:
    """One question per (kind, evidence) with its members; the list names the first five only, all are counted."""
    return first_keys(df, [kind, evidence], key, 5, "members", "first")


def in_force(decisions: DataFrame, unit: str, axis: str) -> DataFrame:
    """The decision that stands per unit and axis: author's rank, then the narrowest scope, then the latest; staged and withdrawn ones do not count.  Rows of one decision that differ are told apart by value, the greatest first."""
    rank = lambda c, order: F.create_map(*[F.lit(x) for kv in order.items() for x in kv])[F.col(c)]
    order = F.struct(rank("author", AUTHORS).alias("a"), rank("scope", SCOPES).alias("s"), "decided_at", "decision_id", "value")
    live = decisions.filter("committed and not withdrawn")
    return live.groupBy(unit, axis).agg(F.max_by(F.struct("value", "author", "decision_id"), order).alias("d")).select(unit, axis, "d.value", "d.author", "d.decision_id")


def band(p: Column, threshold: float) -> Column:
    out = F.lit("below")
    for b in (threshold, *BANDS):
        out = F.when(p >= b, F.format_string("%.2f", F.lit(b))).otherwise(out)
    return out


def grouped_proposals(df: DataFrame, by: Sequence[str], p: str, threshold: float) -> DataFrame:
    """A group's confidence is its least member's; its band follows."""
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("members"), F.min(p).alias("confidence"))
    return g.withColumn("band", band(F.col("confidence"), threshold))


def gate(rule: Column, decided: Column, answer: Column, p: Column, reliability: Column, least_p: float, least_reliability: float) -> Column:
    """A model's word on what the rules said: what is decided stays so; without a model's p it is unsure; another
    answer disagrees at any p; the same one is accepted where p and reliability reach their bounds, else unsure."""
    sure = (p >= least_p) & F.coalesce(reliability >= least_reliability, F.lit(False))
    return F.when(decided, "decided").when(p.isNull(), "unsure").when(~answer.eqNullSafe(rule), "disagree").when(sure, "accepted").otherwise("unsure")


def draw(df: DataFrame, seed: str, what: str, identity: str, share: float | None = None, count: int | None = None) -> DataFrame:
    """Seeded draw of ceil(share n), at least one, or a count, by digest; the least digests win.

    Digests are even, so a histogram of their first 16 bits gives the one cell in which the draw ends; only that cell's
    rows are sorted.
    """
    rows = df.withColumn("__h", unit_hash(f"{seed}:{what}", identity)).withColumn("__cell", F.conv(F.substring("__h", 1, 4), 16, 10).cast("int"))
    cells = sorted((r["__cell"], r["n"]) for r in rows.groupBy("__cell").agg(F.count(F.lit(1)).alias("n")).collect())  # 65,536 at most
    n = sum(c for _, c in cells)
    left = count if count is not None else max(1, int(np.ceil(share * n - 1e-9))) if n else 0
    edge = -1
    for edge, size in cells:
        if left < size:
            break
        left -= size
    else:
        edge, left = edge + 1, 0
    last = rows.filter(F.col("__cell") == edge).orderBy("__h", identity).limit(left)
    return rows.filter(F.col("__cell") < edge).unionByName(last).drop("__h", "__cell")


def frame_digest(df: DataFrame, *columns: str) -> DataFrame:
    """Number of rows and order-free digest of the frame that was drawn from."""
    h = F.xxhash64(*columns)
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws("|", F.count(F.lit(1)), F.bit_xor(h), F.sum(F.pmod(h, F.lit(1_000_003)))), 256).alias("digest"))


def bernoulli(df: DataFrame, seed: str, identity: str, share: float) -> DataFrame:
    return df.filter(fraction(unit_hash(seed, identity)) < share)


def plant(df: DataFrame, seed: str, identity: str, value: str, share: float, confusions: DataFrame) -> DataFrame:
    """Plant the value most often confused with the true one in an exact share of the rows: adds shown and planted."""
    wrong = confusions.groupBy("truth").agg(F.max_by("answer", F.struct("n", "answer")).alias("__wrong"))
    able = df.join(small_or_shuffled(wrong), df[value] == wrong["truth"]).drop("truth")
    chosen = draw(able, seed, "plant", identity, share=share).select(identity, "__wrong")
    out = df.join(chosen, identity, "left")
    return out.withColumn("planted", F.col("__wrong").isNotNull()).withColumn("shown", F.coalesce("__wrong", value)).drop("__wrong")


def catch_rate(df: DataFrame, reader: str, planted: Column, caught: Column, bar: float) -> DataFrame:
    """Planted errors caught, per reader and overall, and whether the bar is met."""
    g = df.filter(planted).groupingSets([[reader], []], reader).agg(F.grouping(reader).alias("__g"), F.count(F.lit(1)).alias("planted"), F.count(F.when(caught, 1)).alias("caught"))
    return g.select(F.when(F.col("__g") == 0, F.col(reader).cast("string")).otherwise("all").alias("reader"), "planted", "caught", (F.col("caught") / F.col("planted") >= bar).alias("meets"))


def compare_voters(df: DataFrame, unit: str, axis: str, value: str, cannot: str = "cannot_tell") -> DataFrame:
    """Per unit and axis: voters, distinct values (can't tell is none), and split, agree or none."""
    v = F.when(F.col(value) != cannot, F.col(value))
    g = df.groupBy(unit, axis).agg(F.count(F.lit(1)).alias("voters"), F.countDistinct(v).alias("values"))
    return g.withColumn("state", F.when(F.col("values") > 1, "split").when(F.col("values") == 1, "agree").otherwise("none"))


def voter_plan(df: DataFrame, unit: str, axis: str, value: str, seed: str, share: float, cells: int, cannot: str = "cannot_tell") -> tuple[DataFrame, DataFrame]:
    """What two or more voters' answers ask to be read: (unit, kind) and, per axis, (axis, split, agree, audit, short).

    A unit one of whose axes has two values is read (split).  Of the others a seeded share is audited, and beyond it whatever adds a cell to
    an axis that has fewer than `cells` agreed ones so far, in the seed's order; short is what an axis lacks then.  An axis on which nobody can tell
    is no cell.
    """
    per = compare_voters(df, unit, axis, value, cannot)
    kinds = per.groupBy(unit).agg(F.max((F.col("state") == "split").cast("int")).alias("__split"))
    agreed = kinds.filter("__split = 0").select(unit)
    first = draw(agreed, seed, "audit", unit, share=share) if share > 0 else agreed.limit(0)
    own = per.filter("state = 'agree'").join(agreed, unit, "left_semi")
    least = first_n(own, [axis], [unit_hash(f"{seed}:audit", unit), F.col(unit)], unit, cells)
    taken = first.unionByName(least.select(unit)).distinct()
    items = kinds.filter("__split = 1").select(unit, F.lit("split").alias("kind")).unionByName(taken.select(unit, F.lit("audit").alias("kind")))
    audited = own.join(taken, unit, "left_semi").groupBy(axis).agg(F.count(F.lit(1)).alias("audit"))
    counts = per.join(kinds, unit).groupBy(axis).agg(F.count(F.when(F.col("state") == "split", 1)).alias("split"), F.count(F.when((F.col("state") == "agree") & (F.col("__split") == 0), 1)).alias("agree"))
    counts = counts.join(audited, axis, "left").fillna(0, ["audit"])
    return items, counts.withColumn("short", F.greatest(F.lit(0), F.lit(cells) - F.col("audit")))


def voter_summary(df: DataFrame, voter: str, value: str, chosen: Column, seconds: str) -> DataFrame:
    return df.groupBy(voter, value).agg(F.count(F.lit(1)).alias("answers"), F.count(F.when(chosen, 1)).alias("chosen"), F.round(F.median(seconds), 6).alias("median"), F.expr(f"percentile_disc(0.9) within group (order by {seconds})").alias("p90"))


def pair_sides(df: DataFrame, seed: str, pair: str, a: str, b: str) -> DataFrame:
    """A seeded coin says which member of a pair is shown on the left."""
    heads = fraction(unit_hash(seed, pair)) < 0.5
    return df.withColumn("left", F.when(heads, F.col(a)).otherwise(F.col(b))).withColumn("right", F.when(heads, F.col(b)).otherwise(F.col(a)))


def pair_values(df: DataFrame, answer: str) -> DataFrame:
    """One value per unit from a pair's answer: the side named is yes, the other no; same gives both the same."""
    v = lambda side: F.when(F.col(answer) == "same", "same").when(F.col(answer) == side, "yes").otherwise("no")
    return df.select(F.inline(F.array(F.struct(F.col("left").alias("unit"), v("left").alias("value")), F.struct(F.col("right").alias("unit"), v("right").alias("value")))))


def anchored(candidates: DataFrame, known: DataFrame, key: str, session: str, subject: str, settings: str, day: str, sign: str) -> DataFrame:
    """Candidates with a known-pre and a known-post anchor of their subject (sign "pre" or "post"), three different units.

    Each anchor is of the same session if there is one, else the closest by day with equal settings, flagged; of equal ones the least key.  A candidate that lacks one is
    left out.  The closest days are looked up, so no pairs of a subject are formed.
    """
    from .sets import near

    out = candidates.select(F.col(key), F.col(subject), F.col(session), F.col(settings), F.col(day))
    for side in ("pre", "post"):
        pool = known.filter(F.col(sign) == side)
        two = pool.groupBy(subject, session).agg(F.min(key).alias("__a"), F.max(key).alias("__b"))
        inside = out.join(two, [subject, session], "left")
        same = F.when(F.col("__a") != F.col(key), F.col("__a")).when(F.col("__b") != F.col(key), F.col("__b"))
        inside = inside.select(*out.columns, same.alias("__same"))
        own = F.concat_ws("\x1f", F.col(subject).cast("string"), F.col(settings).cast("string"))
        rest = inside.filter(F.col("__same").isNull()).withColumn("__who", own)
        others = pool.select(own.alias("__who"), F.col(key).alias("__k"), F.col(day).alias("__d"))
        far = near(rest.select(key, "__who", day), others, key=key, subject="__who", day=day, partner_key="__k", partner_day="__d", lo=None, hi=None, name="__n")
        found = inside.filter("__same is not null").select(*out.columns, F.col("__same").alias(side), F.lit(False).alias(f"{side}_other"))
        out = found.unionByName(rest.join(far.select(key, F.col("__n_key").alias(side)), key).select(*out.columns, side, F.lit(True).alias(f"{side}_other")))
    return out.filter((F.col("pre") != F.col(key)) & (F.col("post") != F.col(key)) & (F.col("pre") != F.col("post"))).select(key, "pre", "pre_other", "post", "post_other")


def panel_order(df: DataFrame, seed: str, key: str, panels: Sequence[str] = ("anchor_before", "candidate", "anchor_after")) -> DataFrame:
    """A seeded order of three panels: one of six."""
    orders = [f"{a},{b},{c}" for a in panels for b in panels for c in panels if len({a, b, c}) == 3]
    return df.withColumn("panels", F.element_at(F.array(*[F.lit(o) for o in orders]), (F.floor(fraction(unit_hash(seed, key)) * 6) + 1).cast("int")))


def check_pair(a: Column, b: Column, reasons_a: Column, reasons_b: Column) -> list[Column]:
    """Two raters of one result: agreement of verdicts, union of parts, shared reasons and whether they overlap."""
    return [(a == b).alias("agree"), F.array_join(F.array_sort(F.array_union(reasons_a, reasons_b)), ",").alias("parts"), F.size(F.array_intersect(reasons_a, reasons_b)).alias("shared"), F.arrays_overlap(reasons_a, reasons_b).alias("overlap")]


def settle_list(df: DataFrame, agree: Column, seed: str, identity: str, share: float = 0.1) -> DataFrame:
    """Every disagreement, and a seeded share of the agreements."""
    return df.filter(~agree).unionByName(bernoulli(df.filter(agree), seed, identity, share))


def grade(df: DataFrame, dimensions: Sequence[str], wrong: Column, settled: Column, cannot: Column) -> DataFrame:
    """Read, wrong, unsettled and can't tell, in total and by each dimension, in one pass."""
    from corvane.functions.windows import breakdowns

    return breakdowns(df, dimensions, read=F.count(F.lit(1)), wrong=F.count(F.when(settled & wrong, 1)), unsettled=F.count(F.when(~settled & ~cannot, 1)), cannot_tell=F.count(F.when(cannot, 1)))


def _upper(k: np.ndarray, n: np.ndarray, confidence: float) -> np.ndarray:
    """Bisection for the p at which at most k of n has probability 1 - confidence, in logarithms."""
    from math import lgamma

    out = np.ones(len(k))
    for i, (a, m) in enumerate(zip(k.astype(int), n.astype(int), strict=True)):
        if m <= 0 or a >= m:
            continue
        j = np.arange(a + 1)
        choose = np.array([lgamma(m + 1) - lgamma(x + 1) - lgamma(m - x + 1) for x in j])
        lo, hi = 0.0, 1.0
        for _ in range(60):
            p = (lo + hi) / 2
            tail = np.exp(choose + j * np.log(p) + (m - j) * np.log1p(-p)).sum() if 0 < p < 1 else (1.0 if p == 0 else 0.0)
            lo, hi = (p, hi) if tail > 1 - confidence else (lo, p)
        out[i] = (lo + hi) / 2
    return out


def upper_bound(k: Column, n: Column, confidence: float = 0.95) -> Column:
    """Exact one-sided bound on an error rate, for aggregated (errors, read) rows only."""

    @F.pandas_udf("double")
    def bound(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(np.round(_upper(a.to_numpy(), b.to_numpy(), confidence), 9))

    return bound(k, n)


def pooled(rounds: DataFrame, by: str) -> DataFrame:
    """Graded rounds of one kind together, with the bound of the sums."""
    return rounds.groupBy(by).agg(F.sum("wrong").alias("wrong"), F.sum("read").alias("read")).withColumn("bound", upper_bound(F.col("wrong"), F.col("read")))


def certificate(graded: DataFrame, bar: float, stated: Mapping[str, float] | None = None, name: str = "value") -> DataFrame:
    """A verdict per graded row: granted, or refused for missing the bar or for a stated bound that differs."""
    out = graded.withColumn("bound", upper_bound(F.col("wrong"), F.col("read")))
    said = F.create_map(*[F.lit(x) for kv in stated.items() for x in kv])[F.col(name)] if stated else F.lit(None).cast("double")
    return out.withColumn("verdict", F.when(F.abs(said - F.col("bound")) > 1e-6, "refused: stated bound differs").when(F.col("bound") > bar, "refused: misses its bar").otherwise("granted"))


def suggestions(df: DataFrame, item: str, author: str, value: str, at: str, within: str | None = None) -> DataFrame:
    """Newest suggestion per item and whether authors' newest ones disagree; of an author's equally new ones the one with the greatest `within` counts, then the greatest value."""
    order = F.struct(at, *([within] if within else []), value)
    newest = df.groupBy(item, author).agg(F.max_by(value, order).alias("__v"), F.max(at).alias("__at"))
    return newest.groupBy(item).agg(F.max_by("__v", F.struct("__at", author)).alias("shown"), (F.countDistinct("__v") > 1).alias("disagree"))


def unsealed(df: DataFrame, sealed: DataFrame, key: str) -> DataFrame:
    """Rows that are not in a sealed sample."""
    return df.join(sealed.select(key), key, "left_anti")


def certainty(df: DataFrame, dataset: str, open_questions: DataFrame, key: str) -> DataFrame:
    """Units that need a look and units that are sure, per dataset."""
    look = df.join(open_questions.select(key).distinct().withColumn("__q", F.lit(True)), key, "left")
    return look.groupBy(dataset).agg(F.count(F.when(F.col("__q"), 1)).alias("look"), F.count(F.when(F.col("__q").isNull(), 1)).alias("sure"))


def agreement(df: DataFrame, item: str, value: str, seconds: str) -> DataFrame:
    """A campaign in one row: items, items all agree on, answers, median and 90th percentile of seconds."""
    per = df.groupBy(item).agg(F.countDistinct(value).alias("v"), F.count(F.lit(1)).alias("n"))
    whole = df.agg(F.count(F.lit(1)).alias("answers"), F.round(F.median(seconds), 6).alias("median"), F.expr(f"percentile_disc(0.9) within group (order by {seconds})").alias("p90"))
    return per.agg(F.count(F.lit(1)).alias("items"), F.count(F.when((F.col("v") == 1) & (F.col("n") > 1), 1)).alias("agreed")).crossJoin(whole)


def error_budget(bounds: DataFrame, entering: DataFrame, axis: str) -> DataFrame:
    """Rows that may be wrong: the sum over filters of the axis' bound times the rows that enter, rounded up."""
    return entering.join(bounds, axis).agg(F.ceil(F.sum(F.col("bound") * F.col("rows")) - 1e-9).cast("long").alias("budget"))


def yield_funnel(df: DataFrame, subject: str, dimension: str, filters: Mapping[str, Column]) -> DataFrame:
    """Rows and distinct subjects after each filter, by a dimension and in total, in one pass."""
    passed, flags = F.lit(True), []
    for name, c in filters.items():
        passed = passed & F.coalesce(c, F.lit(False))
        flags.append((name, passed))
    rows = df.select(dimension, subject, F.explode(F.filter(F.array(F.lit("all"), *[F.when(f, n) for n, f in flags]), lambda x: x.isNotNull())).alias("step"))
    out = rows.groupingSets([[dimension, "step"], ["step"]], dimension, "step").agg(F.grouping(dimension).alias("__g"), F.count(F.lit(1)).alias("rows"), F.countDistinct(subject).alias("subjects"))
    return out.select(F.when(F.col("__g") == 0, F.col(dimension).cast("string")).otherwise("total").alias("value"), "step", "rows", "subjects")


def pace(campaigns: DataFrame, seconds: str) -> DataFrame:
    """One row: the median seconds of an answer over closed campaigns."""
    return campaigns.filter("closed").agg(F.median(seconds).alias("pace"))


def waiting(df: DataFrame, by: Sequence[str], unit: str, pace_: DataFrame) -> DataFrame:
    """Proposals waiting, most units first, and the seconds they would take at the pace of closed campaigns."""
    counts = df.groupBy(*by).agg(F.countDistinct(unit).alias("units"))
    return counts.crossJoin(F.broadcast(pace_)).withColumn("seconds", F.round(F.col("units") * F.col("pace"), 6)).drop("pace").orderBy(F.desc("units"), *by)
