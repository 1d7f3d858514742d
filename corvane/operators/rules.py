"""Classification by ordered rules, votes, neighbours and context.  Rules are data; they become columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.plans.storage import small_or_shuffled

from .firsts import beside
from .review import first_keys

#: Confidence and basis that a rule's tier fixes.
TIERS = {"header": (0.95, "header"), "name": (0.8, "name"), "inferred": (0.6, "inferred"), "default": (0.3, "default")}


@dataclass(frozen=True)
class Rule:
    """On an axis, a condition that gives a value; scope limits it to rows for which another condition holds."""

    name: str
    axis: str
    value: str
    when: Mapping
    tier: str = "header"
    scope: Mapping | None = None


def predicate(spec: Mapping) -> Column:
    """A condition as a column.  One key: all, any, not, count, token, contains, prefix, equals, regex, above, below, present, is."""
    (op, arg), *rest = spec.items()
    if rest:
        raise ValueError(f"one condition expected, not {list(spec)}")
    if op in ("all", "any"):
        return reduce((lambda a, b: a & b) if op == "all" else (lambda a, b: a | b), [predicate(x) for x in arg])
    if op == "not":
        return ~predicate(arg)
    if op == "count":  # at least n of several
        return sum((F.coalesce(predicate(x), F.lit(False)).cast("int") for x in arg["of"]), F.lit(0)) >= arg["least"]
    column, value = (arg, None) if isinstance(arg, str) else arg
    c = F.col(column)
    return {
        "token": lambda: F.array_contains(F.split(F.lower(c.cast("string")), "[^a-z0-9#]+"), str(value).lower()),
        "contains": lambda: F.contains(F.lower(c), F.lit(str(value).lower())),
        "prefix": lambda: F.startswith(F.lower(c), F.lit(str(value).lower())),
        "equals": lambda: c == value,
        "regex": lambda: c.rlike(value),
        "above": lambda: c > (F.col(value) if isinstance(value, str) else F.lit(value)),
        "below": lambda: c < (F.col(value) if isinstance(value, str) else F.lit(value)),
        "present": lambda: c.isNotNull(),
        "is": lambda: F.col(f"{column}.value") == value,  # an axis that an earlier rule set decided
    }[op]()


def _answer(rule: Rule) -> Column:
    confidence, basis = TIERS[rule.tier]
    return F.struct(F.lit(rule.value).alias("value"), F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"), F.lit(rule.name).alias("rule"))


def _fires(rule: Rule) -> Column:
    fires = F.coalesce(predicate(rule.when), F.lit(False))
    return fires & F.coalesce(predicate(rule.scope), F.lit(False)) if rule.scope else fires


#: Conditions, or rules of an axis, that share a number.
_WORD = 32
#: Added to the place of a word without a bit, so that it is behind all rules.
_NOWHERE = 1 << 20


#: Always 0.  The fold keeps its projection out of the code of its stage: there all of a projection is one method, which
#: the JVM does not compile beyond 8,000 bytes; outside, Spark splits it into methods of a few expressions.
_APART = "aggregate(array({}), 0L, (a, x) -> a)"


class _Bits:
    """Conditions as bits of a few numbers: each distinct one is evaluated once a row, and a rule over them is a mask.

    Masks are written as text, from numbers only: built call by call, a pack of rules takes longer to plan than to run.
    """

    def __init__(self, stem: str):
        self.stem = stem
        self.at: dict[str, int] = {}
        self.conditions: dict[str, tuple[str, Column]] = {}
        self.leaves: list[str] = []

    def bit(self, spec: Mapping, holds: bool) -> tuple[str, int]:
        """Column and bit of a condition, or of its opposite; unknown counts as neither."""
        name = repr((spec, holds))
        if name not in self.at:
            self.at[name] = len(self.leaves)
            if repr(spec) not in self.conditions:
                self.conditions[repr(spec)] = f"{self.stem}if{len(self.conditions)}", predicate(spec)
            self.leaves.append(f"cast(coalesce({'' if holds else 'not '}{self.conditions[repr(spec)][0]}, false) as bigint)")
        word, bit = divmod(self.at[name], _WORD)
        return f"{self.stem}{word}", bit

    def truth(self, spec: Mapping, holds: bool = True) -> str:
        """1 if the condition (or its opposite) is certain, else 0.  Opposites move inward, to single conditions."""
        (op, arg), *_ = spec.items()
        if op == "not":
            return self.truth(arg, not holds)
        if op == "count":
            masks, nested = self._parts(arg["of"], True)
            total = " + ".join([*(f"bit_count({w} & {m}L)" for w, m in masks.items()), *nested, "0"])
            return f"cast({total} {'>=' if holds else '<'} {int(arg['least'])} as bigint)"
        if op not in ("all", "any"):
            return self.truth({"all": [spec]}, holds)
        masks, nested = self._parts(arg, holds)
        if (op == "all") == holds:
            return f"cast(({' | '.join([*(f'(({w} & {m}L) ^ {m}L)' for w, m in masks.items()), *(f'({t} ^ 1L)' for t in nested), '0L'])}) = 0L as bigint)"
        return f"cast(({' | '.join([*(f'({w} & {m}L)' for w, m in masks.items()), *nested, '0L'])}) != 0L as bigint)"

    def _parts(self, specs: Sequence[Mapping], holds: bool) -> tuple[dict[str, int], list[str]]:
        """Masks of the single conditions among specs, by column, and the others.  A condition given twice counts twice."""
        masks, nested = {}, []
        for spec in specs:
            (op, _), *rest = spec.items()
            if rest:
                raise ValueError(f"one condition expected, not {list(spec)}")
            if op in ("all", "any", "count", "not"):
                nested.append(self.truth(spec, holds))
                continue
            word, bit = self.bit(spec, holds)
            if masks.get(word, 0) >> bit & 1:
                nested.append(f"(shiftright({word}, {bit}) & 1L)")
            masks[word] = masks.get(word, 0) | 1 << bit
        return masks, nested

    def beside(self, df: DataFrame) -> DataFrame:
        """df with the conditions' numbers."""
        words = {f"{self.stem}{at // _WORD}": " | ".join(f"shiftleft({c}, {i})" for i, c in enumerate(self.leaves[at : at + _WORD])) for at in range(0, len(self.leaves), _WORD)}
        words[f"{self.stem}0"] = f"{words[self.stem + '0']} | {_APART.format(self.leaves[0])}" if words else "0L"
        return df.withColumns(dict(self.conditions.values())).withColumns({name: F.expr(word) for name, word in words.items()})


def _stem(df: DataFrame, stem: str) -> str:
    """A beginning that no column of df has."""
    while any(c.lower().startswith(stem) for c in df.columns):
        stem += "_"
    return stem


def _looked_up(rules: Sequence[Rule], place: Column) -> Column:
    """The answer of the rule at a place, from 1; null beyond the last.  The texts are constants, split when the query is planned."""
    fields = [[r.value for r in rules], [str(TIERS[r.tier][0]) for r in rules], [TIERS[r.tier][1] for r in rules], [r.name for r in rules]]
    if any("\x1f" in v for f in fields for v in f):
        raise ValueError("a rule's value or name holds the separator of fields")
    texts = [F.split(F.lit("\x1f".join(f)), "\x1f") for f in fields]
    found = [F.try_element_at(t, place.cast("int")).alias(n) for t, n in zip([texts[0], texts[1].cast("array<double>"), *texts[2:]], ("value", "confidence", "basis", "rule"), strict=True)]
    return F.when(place <= len(rules), F.struct(*found))


def _reads(spec: Mapping | Sequence | None) -> set[str]:
    """Axes whose answers a condition reads."""
    if isinstance(spec, Mapping):
        return {spec["is"][0]} if "is" in spec else set().union(*map(_reads, spec.values()))
    return set().union(*map(_reads, spec)) if isinstance(spec, (list, tuple)) else set()


def classify(df: DataFrame, rules: Sequence[Rule], pins: Mapping[str, Column] | None = None) -> DataFrame:
    """Adds one struct (value, confidence, basis, rule) per axis: the first rule that fires decides; a pinned axis keeps its answer.

    Axes are decided in the order of their first rule, so later rules may read earlier axes.  Axes that read none of each
    other are decided together.  The answer is looked up by the number of the rule.
    """
    axes = {axis: [r for r in rules if r.axis == axis] for axis in dict.fromkeys(r.axis for r in rules)}
    while axes:
        together: dict[str, list[Rule]] = {}
        for axis, own in axes.items():
            if together and any(_reads([r.when, r.scope]) & together.keys() for r in own):
                break
            together[axis] = own
        before, stem = df.columns, _stem(df, "__fired")
        bits = _Bits(_stem(df, "__bits"))
        truths = {axis: [bits.truth({"all": [r.when, r.scope]} if r.scope else r.when) for r in own] for axis, own in together.items()}
        fired, first, found, at_rule = {}, {}, {}, _stem(df, "__rule")
        for axis, own in together.items():
            places = []
            for at in range(0, len(own), _WORD):
                word = f"{stem}{len(fired)}"
                fired[word] = F.expr(" | ".join([*(f"shiftleft({t}, {i})" for i, t in enumerate(truths[axis][at : at + _WORD])), *[_APART.format(f"{bits.stem}0")] * (not fired)]))
                lowest = f"bit_count(({word} & -{word}) - 1)"  # 64 where no bit is set
                places.append(f"{lowest} + {at} + shiftright({lowest}, 6) * {_NOWHERE}")
            place = f"{at_rule}{len(first)}"
            first[place] = F.expr(f"1 + least({', '.join(places)}, {_NOWHERE}) + {_APART.format(f'bigint({word})')}")
            out = _looked_up(own, F.col(place))
            if pins and axis in pins:
                pin = F.struct(pins[axis].alias("value"), F.lit(1.0).alias("confidence"), F.lit("pin").alias("basis"), F.lit("pin").alias("rule"))
                out = F.when(pins[axis].isNotNull(), pin).otherwise(out)
            found[axis] = out
        df = bits.beside(df).withColumns(fired).withColumns(first)
        # Numbers of rules pass through a generator of one row: a filter on an answer stops there; below it, each use of a number would be its whole formula.
        df = df.select(*[F.col(f"`{c}`") for c in before], F.inline(F.array(F.struct(*first)))).withColumns(found)
        df = df.select(*[F.col(f"`{c}`") for c in before if c not in found], *found)
        axes = {axis: own for axis, own in axes.items() if axis not in together}
    return df


def votes(df: DataFrame, key: str, rules: Sequence[Rule]) -> DataFrame:
    """(key, axis, value, tier, rule): every rule that fires, not only the first.  Rules that read axes need those columns in df."""
    fired = F.array(*[F.when(_fires(r), F.struct(F.lit(r.axis).alias("axis"), F.lit(r.value).alias("value"), F.lit(r.tier).alias("tier"), F.lit(r.name).alias("rule"))) for r in rules])
    return df.select(key, F.inline(F.filter(fired, lambda x: x.isNotNull())))


_HOLE = -(2**31)


def _bins(df: DataFrame, dims: Mapping[str, float | tuple[str, float]], zero_absent: bool) -> DataFrame:
    """Adds the bin number __<dim> of each dimension; a missing value (a zero too, if that is none) is a hole."""
    out = df
    for name, how in dims.items():
        rule, step = how if isinstance(how, tuple) else ("round", how)
        x = F.when(F.lit(not zero_absent) | (F.col(name) != 0), F.col(name)) / step
        number = F.bround(x, 0) if rule == "round" else F.when(x > 0, F.ceil(x))
        out = out.withColumn(f"__{name}", F.coalesce(number.cast("long"), F.lit(_HOLE).cast("long")))
    return out


def _moves(bins: Sequence[str], reach: int, pairs: Sequence[tuple[int, int]], relaxed: tuple[int, int, int, int] | None) -> list[tuple[int, dict[int, int]]]:
    """(step, moves): 0 the bin itself; for each distance one dimension, then a pair of them; last the relaxed pair."""
    out: list[tuple[int, dict[int, int]]] = [(0, {})]
    for d in range(1, reach + 1):
        by = [o for o in range(-d, d + 1) if o]
        out += [(2 * d - 1, {i: o}) for i in range(len(bins)) for o in by]
        out += [(2 * d, {i: o, j: p}) for i, j in pairs for o in by for p in by]
    if relaxed:
        i, span, j, other = relaxed
        out += [(2 * reach + 1, {i: o, j: p} if p else {i: o}) for o in range(-span, span + 1) if o for p in range(-other, other + 1)]
    return out


def neighbour_vote(df: DataFrame, reference: DataFrame, key: str, dims: Mapping[str, float | tuple[str, float]], answer: str, *, least: int = 3, reach: int = 1, pairs: Sequence[tuple[str, str]] | None = None, relaxed: tuple[str, int, str, int] | None = None, partition: str | None = None, asks_all: Sequence[str] = ("no_match", "insufficient_matches", "tie", "no_compatible_match"), alone: Sequence[str] = (), subject: str | None = None, fits: Callable[[Column, Column], Column] | None = None, zero_absent: bool = True, keep: Sequence[str] = ()) -> DataFrame:
    """For every row (key, the columns to keep, voted, matches, neighbours, method, scope): the answer most common among reference rows in near bins.

    dims are {column: step} (rounded half to even) or {column: ("ceil", step)}.  The search widens until a bin
    of the reference is met: the own bin; for each distance up to `reach`, one dimension off, then the two of a pair
    (all pairs by default); last `relaxed` (dimension, span, other dimension, its span).  A hole matches a hole only, and no bin lies below 0.
    Answers are then tried from the most common on (equal ones by name): the first that `fits` (subject, answer)
    counts.  method says how it was found, or why none is given: no_match, no_compatible_match,
    insufficient_matches (fewer than least) or tie (the next answer is as common).
    With a partition a row asks the reference of its own partition, where there is one, and asks
    the whole for the methods in asks_all, unless its partition is listed in `alone`.

    Rows of one bin get one answer, so the vote is taken per distinct bin, on counts per bin of the reference.
    """
    names, bins = list(dims), [f"__{c}" for c in dims]
    at = {c: i for i, c in enumerate(names)}
    both = [(i, j) for i in range(len(bins)) for j in range(i + 1, len(bins))] if pairs is None else [(at[a], at[b]) for a, b in pairs]
    moves = _moves(bins, reach, both, relaxed and (at[relaxed[0]], relaxed[1], at[relaxed[2]], relaxed[3]))
    part = F.lit(None).cast("string") if partition is None else F.col(partition).cast("string")
    pool = _bins(reference.filter(F.col(answer).isNotNull()), dims, zero_absent).groupBy(*bins, F.coalesce(part, F.lit("")).alias("__part"), F.col(answer).alias("__answer")).agg(F.count(F.lit(1)).alias("__n"))
    own = F.lit("") if subject is None else F.coalesce(F.col(subject).cast("string"), F.lit(""))
    rows = _bins(df, dims, zero_absent).select(key, *keep, *bins, own.alias("__subject"), F.coalesce(part, F.lit("")).alias("__part"))
    by = [*bins, "__subject", "__part"]

    def option(step: int, moved: Mapping[int, int]) -> Column:
        new = [F.col(b) + moved.get(i, 0) for i, b in enumerate(bins)]
        ok = F.lit(True)
        for i in moved:
            ok = ok & (F.col(bins[i]) != _HOLE) & (new[i] >= 0)
        return F.when(ok, F.struct(F.lit(step).alias("step"), *[x.alias(f"b{i}") for i, x in enumerate(new)]))

    def voted(asked: DataFrame, counts: DataFrame, scope: str, more: Sequence[str]) -> DataFrame:
        near = asked.select(*by, F.inline(F.array_compact(F.array(*[option(*m) for m in moves]))))
        counts = counts.select(*[F.col(b).alias(f"b{i}") for i, b in enumerate(bins)], *more, "__answer", "__n")
        found = near.join(counts, [f"b{i}" for i in range(len(bins))] + list(more)).groupBy(*by, "step", "__answer").agg(F.sum("__n").alias("__n"))
        lists = found.groupBy(*by, "step").agg(F.array_sort(F.collect_list(F.struct((-F.col("__n")).alias("n"), F.col("__answer").alias("answer")))).alias("__ranked"))
        nearest = lists.groupBy(*by).agg(F.min_by("__ranked", "step").alias("__ranked"), F.min("step").alias("__step"))
        good = F.transform("__ranked", lambda x: F.lit(True) if fits is None else F.coalesce(fits(F.col("__subject"), x["answer"]), F.lit(False)))
        nearest = nearest.withColumn("__i", F.array_position(good, True).cast("int"))
        top, after = F.try_element_at("__ranked", F.nullif("__i", F.lit(0))), F.try_element_at("__ranked", F.col("__i") + 1)
        step = F.when(F.col("__step") == 0, "exact_bin").when(F.col("__step") > 2 * reach, "expanded_relaxed").when(F.col("__step") % 2 == 1, "expanded_single").otherwise("expanded_multi")
        method = F.when(F.col("__i") == 0, "no_compatible_match").when(-top["n"] < least, "insufficient_matches").when(F.coalesce(after["n"] == top["n"], F.lit(False)), "tie").otherwise(step)
        seen = -F.aggregate("__ranked", F.lit(0).cast("long"), lambda a, x: a + x["n"])
        told = nearest.select(*by, method.alias("method"), top["answer"].alias("__top"), F.when(F.col("__i") > 0, -top["n"]).otherwise(0).alias("matches"), seen.alias("neighbours"))
        out = asked.select(*by).join(told, by, "left").withColumn("method", F.coalesce("method", F.lit("no_match")))
        stands = F.col("method").startswith("expanded") | (F.col("method") == "exact_bin")
        return out.select(*by, F.when(stands, F.col("__top")).alias("voted"), F.coalesce("matches", F.lit(0)).alias("matches"), F.coalesce("neighbours", F.lit(0)).alias("neighbours"), "method", F.lit(scope).alias("scope"))

    asked = rows.select(*by).distinct()
    whole = pool.groupBy(*bins, "__answer").agg(F.sum("__n").alias("__n"))
    if partition is None:
        answers = voted(asked, whole, "global", [])
    else:
        known = pool.select("__part").filter("__part != ''").distinct()
        scoped = voted(asked.join(known, "__part", "left_semi"), pool, "scoped", ["__part"])
        again = F.col("voted").isNull() & F.col("method").isin(list(asks_all)) & ~F.col("__part").isin(list(alone))
        rest = asked.join(known, "__part", "left_anti").unionByName(scoped.filter(again).select(*asked.columns))
        answers = scoped.filter(~again).unionByName(voted(rest, whole, "global", []))
    return rows.join(answers, by).select(key, *keep, "voted", "matches", "neighbours", "method", "scope")


def from_siblings(df: DataFrame, key: str, group: str, axis: str, evidence: Column, value: str, fixed: Column) -> DataFrame:
    """A silent unit takes the value if a sibling of its group shows the evidence; stated values are never touched."""
    shown = df.filter(evidence).groupBy(group).agg(F.count(F.lit(1)).alias("__shown"), F.min(key).alias("__first"))
    out = df.join(shown, group, "left")
    sibling = F.coalesce(F.col("__shown"), F.lit(0)) - F.when(F.coalesce(evidence, F.lit(False)), 1).otherwise(0)
    return out.withColumn(axis, F.when(F.col(axis).isNull() & ~F.coalesce(fixed, F.lit(False)) & (sibling > 0), F.lit(value)).otherwise(F.col(axis))).drop("__shown", "__first")


def bracket(df: DataFrame, group: str, at: str, sign: str, number: str, *, trusted: Column, bolus: Column, region: str, day: str, untimed: Column, model: Column, tagged: Column, split_gap: float, series: str | None = None, images: tuple[str, str] | None = None, content_early: Column | None = None, derived: Column | None = None, study: tuple[str, str, float] | None = None) -> DataFrame:
    """Time bracket of a group (a session): label pre or post, the reason where there is none, flags, and weak_first.

    sign is a certified answer, 1 (post), -1 (pre) or null; such rows keep their own.  Others are post behind the first positive, pre ahead of the last
    negative, if the series numbers agree; nothing where the two cross, in an untrusted group, or between them.  Then the checks, each of which withdraws labels unless it
    is said to flag only:

    C3  a bolus ahead of the last negative withdraws all; else it makes unlabelled rows behind it post
    C2  several regions in a group are flagged; a label that its own region's bracket does not give goes; with `study` (subject,
        start, span) a group that starts less than the span from another of its subject is flagged
    C4  flags a split dose: boluses split_gap apart, a series counted at its earliest, or one behind the first positive
    C5  a group of several days; rows with untimed images; with `content_early`, images whose content is older than
        they are, own ones or those of the row that the label rests on; with `images` (first, last time), a row that reaches over
        the first image of that row; a number that contradicts the time flags
    C6  a derived row gives no answer and gets none, unless it is a bolus
    C8  weak_first: the first positive is a model's alone, without another, a tag behind it or a bolus ahead of it
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    framed = F.lit(True) if derived is None else ~yes(derived)
    at_, n_, sign_ = F.col(at), F.col(number), F.when(framed, F.col(sign))
    whole, part = Window.partitionBy(group), Window.partitionBy(group, region)
    positive, negative = sign_ == 1, sign_ == -1
    begins, ends = (F.col(c) for c in images) if images else (F.lit(None).cast("double"), F.lit(None).cast("double"))
    stale = F.lit(False) if content_early is None else yes(content_early)
    edge = lambda w, c, pick: pick(F.when(c & trusted, F.struct(at_.alias("t"), n_.alias("n"), begins.alias("begins"), stale.alias("stale")))).over(w)

    def place(w) -> Column:
        first, last = edge(w, positive & at_.isNotNull(), F.min), edge(w, negative & at_.isNotNull(), F.max)
        after, before = at_ > first["t"], at_ < last["t"]
        post = yes(after) & F.coalesce(n_ > first["n"], F.lit(True))
        pre = yes(before) & F.coalesce(n_ < last["n"], F.lit(True))
        none = F.count(F.when(sign_.isNotNull(), 1)).over(w) == 0
        crossed = yes(first["t"] <= last["t"])
        open_ = F.when(first.isNotNull() & last.isNotNull(), "window").when(first.isNotNull(), "post_only_before_first").otherwise("pre_only_after_last")
        return F.when(~trusted | at_.isNull(), "no_trusted_time").when(none, "no_answer").when(crossed, "crossed").when(post, "post").when(pre, "pre").when(yes(after) | yes(before), "series_number").otherwise(open_)

    own = F.when(positive, "post").when(negative, "pre")
    out = df.withColumns({"__base": place(whole), "__exam": place(part), "__first": edge(whole, positive & at_.isNotNull(), F.min), "__last": edge(whole, negative & at_.isNotNull(), F.max)})
    given = bolus & at_.isNotNull()
    event = F.when(given & trusted, at_)
    out = out.withColumn("__event", event if series is None else F.min(event).over(Window.partitionBy(group, series)))
    out = out.withColumns({"__bolus": F.min(F.when(given & trusted, at_)).over(whole), "__bolus_n": F.min(F.when(given, n_)).over(whole), "__bolus_to": F.max("__event").over(whole), "__regions": F.size(F.collect_set(F.when(framed, F.col(region))).over(whole)), "__days": F.size(F.collect_set(F.when(framed, F.col(day))).over(whole)), "__others": F.count(F.when(positive, 1)).over(whole)})
    early = yes(F.col("__bolus") < F.col("__last.t"))
    open_ = F.col("__base").isin("window", "pre_only_after_last", "no_answer", "post_only_before_first")
    added = own.isNull() & ~early & open_ & yes(at_ > F.col("__bolus")) & F.coalesce(n_ > F.col("__bolus_n"), F.lit(True)) & ~bolus
    labelled = own.isNull() & F.col("__base").isin("pre", "post")
    other = labelled & ~early & (F.col("__regions") > 1) & F.col(region).isNotNull() & (F.col("__exam") != F.col("__base"))
    holds = labelled | added
    post, pre = added | (labelled & (F.col("__base") == "post")), labelled & (F.col("__base") == "pre")
    reason = F.when(holds & early, "C3_bolus_before_last").when(other, "C2_exam").when(holds & (F.col("__days") > 1), "C5_midnight").when(holds & untimed, "C5_no_time")
    still = reason.isNull()
    content = stale | (still & ((post & yes(F.col("__first.stale"))) | (pre & yes(F.col("__last.stale")))))
    reason = reason.when(holds & content, "C5_content") if content_early is not None else reason
    straddle = reason.isNull() & ((pre & yes(ends >= F.col("__last.begins"))) | (post & ~added & yes(begins <= F.col("__first.begins"))))
    reason = F.when(~framed, F.when(~yes(bolus), "C6_derived")).otherwise(reason.when(straddle, "C5_straddle"))
    out_of_frame = F.lit(False) if derived is None else ~framed & ~yes(bolus)
    two = yes(F.col("__bolus_to") - F.col("__bolus") >= split_gap) | yes(F.col("__bolus") > F.col("__first.t"))
    split = trusted & two
    between = split & yes((at_ > F.least("__bolus", "__first.t")) & (at_ < F.greatest("__bolus", "__first.t"))) & F.col("__first").isNotNull()
    second = F.lit(False)
    if study:
        subject, start, span = study
        starts = df.groupBy(F.col(subject).alias("__subject"), F.col(group).alias("__group")).agg(F.min(start).alias("__start")).filter("__start is not null")
        line = Window.partitionBy("__subject").orderBy("__start", "__group")
        near = [yes(F.abs(F.col("__start") - f("__start").over(line)) < span) for f in (F.lag, F.lead)]
        out = beside(out, starts.select(F.col("__subject").alias(subject), F.col("__group").alias(group), (near[0] | near[1]).alias("__second")), [subject, group], "left")
        second = yes(F.col("__second"))
    flags = [(framed & early, "C3_bolus_before_last"), (added, "C3_bolus_post_added"), (F.col("__regions") > 1, "C2_multi_region"), (other, "C2_exam"), (split, "C4_split_session"), (between, "C4_split"), (framed & (F.col("__days") > 1), "C5_midnight"), (framed & untimed, "C5_no_time"), (framed & content, "C5_content"), (framed & straddle, "C5_straddle"), (own.isNull() & (F.col("__base") == "series_number"), "C5_number_guard"), (~framed, "C6_derived"), (second, "C2_second_study")]
    is_first = positive & yes(at_ == F.col("__first.t"))
    by_model = F.max(F.when(is_first, model.cast("int"))).over(whole) == 1
    tag = F.max(F.when(tagged & yes(at_ >= F.col("__first.t")), 1)).over(whole).isNotNull()
    weak = yes(by_model) & (F.col("__others") == 1) & ~tag & ~yes(F.col("__bolus") <= F.col("__first.t"))
    base = F.when(added, "post").when(labelled, F.col("__base"))
    label = F.when(~out_of_frame, F.coalesce(own, F.when(reason.isNull(), base)))
    why = F.when(label.isNull(), F.coalesce(reason, F.col("__base")))
    marked = F.array_join(F.array_compact(F.array(*[F.when(yes(c), F.lit(name)) for c, name in flags])), ",")
    return out.select(*df.columns, label.alias("label"), why.alias("reason"), marked.alias("flags"), weak.alias("weak_first"))


def carried(df: DataFrame, key: str, subject: str, at: str, positive: Column, lo_hours: float, hi_hours: float) -> DataFrame:
    """Rows of a subject that follow a positive one by lo to hi hours: key and hours since the latest such.

    The latest positive up to lo hours before a row is looked up in buckets of hi - lo hours, its own and the one before, so
    no pairs of a subject are formed and a busy subject is spread over its buckets.
    """
    micros, width = F.unix_micros(F.col(at).cast("timestamp")), int((hi_hours - lo_hours) * 3.6e9)
    bucket = lambda t: F.floor(t / F.lit(width))
    known = df.filter(positive).select(F.col(subject).alias("__s"), micros.alias("__t")).distinct()
    known = known.select("__s", "__t", F.explode(F.array(bucket(F.col("__t")), bucket(F.col("__t")) + 1)).alias("__b"), F.col("__t").alias("__hit"), F.lit(0).alias("__ask"))
    asked = df.select(F.col(key), F.col(subject).alias("__s"), (micros - int(lo_hours * 3.6e9)).alias("__t")).filter("__t is not null")
    line = known.unionByName(asked.select("__s", "__t").distinct().select("__s", "__t", bucket(F.col("__t")).alias("__b"), F.lit(None).cast("long").alias("__hit"), F.lit(1).alias("__ask")))
    w = Window.partitionBy("__s", "__b").orderBy("__t", "__ask").rowsBetween(Window.unboundedPreceding, 0)
    found = line.withColumn("__hit", F.last("__hit", True).over(w)).filter((F.col("__ask") == 1) & (F.col("__t") - F.col("__hit") <= width))
    out = asked.join(found.select("__s", "__t", "__hit"), ["__s", "__t"])
    return out.select(key, F.round((F.col("__t") - F.col("__hit") + int(lo_hours * 3.6e9)) / 3.6e9, 4).alias("hours"))


def clock_trust(df: DataFrame, group: str, series: str, second: str, number: str, *, least: int = 2, least_span: float = 120, most_span: float = 14_400, distinct: float = 0.5, floor: float) -> DataFrame:
    """Per group whether its clock can be trusted, judged on its series (the earliest second and least number of each).

    Enough series, all timed, none at midnight exactly, a span within bounds, a least share of distinct times, and a rank
    correlation of time and number of at least `floor`; no correlation (fewer than three series with both, or one value
    only) does not speak against it.
    """
    per = df.groupBy(group, series).agg(F.min(second).alias("__t"), F.min(number).alias("__k"))

    def mean_rank(c: str) -> Column:
        ties = F.count(F.lit(1)).over(Window.partitionBy(group, "__both", c))
        return F.rank().over(Window.partitionBy(group, "__both").orderBy(c)) + (ties - 1) / 2.0

    rows = per.withColumn("__both", F.col("__t").isNotNull() & F.col("__k").isNotNull()).withColumn("__a", mean_rank("__t")).withColumn("__b", mean_rank("__k"))
    pair = lambda c: F.when(F.col("__both"), F.col(c))
    enough = (F.count(F.when(F.col("__both"), 1)) >= 3) & (F.min(pair("__a")) < F.max(pair("__a"))) & (F.min(pair("__b")) < F.max(pair("__b")))
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count("__t").alias("__timed"), F.count(F.when(F.pmod("__t", F.lit(86_400)) == 0, 1)).alias("__midnight"), (F.max("__t") - F.min("__t")).alias("__span"), F.countDistinct("__t").alias("__times"), F.when(enough, F.round(F.corr(pair("__a"), pair("__b")), 6)).alias("rho"))
    ok = (F.col("n") >= least) & (F.col("__timed") == F.col("n")) & (F.col("__midnight") == 0) & F.col("__span").between(least_span, most_span) & (F.col("__times") >= distinct * F.col("n")) & F.coalesce(F.col("rho") >= floor, F.lit(True))
    return out.select(group, "n", "rho", F.coalesce(ok, F.lit(False)).alias("trusted"))


def effect(before: DataFrame, after: DataFrame, key: str, axes: Sequence[str], settled: DataFrame | None = None) -> DataFrame:
    """Moves per axis between two classifications: (axis, from, to, n), and how many settled answers went wrong."""
    long = lambda d, n: d.select(key, F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias(n)) for a in axes])))
    both = long(before, "from").join(long(after, "to"), [key, "axis"], "full_outer").filter(~F.col("from").eqNullSafe(F.col("to")))
    if settled is not None:
        both = both.join(settled.select(key, "axis", "truth"), [key, "axis"], "left")
        wrong = F.count(F.when((F.col("from") == F.col("truth")) & ~F.col("to").eqNullSafe(F.col("truth")), 1))
        return both.groupBy("axis", "from", "to").agg(F.count(F.lit(1)).alias("n"), wrong.alias("made_wrong"))
    return both.groupBy("axis", "from", "to").agg(F.count(F.lit(1)).alias("n"))


def rehearsal(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A fixed-size sample that the seed alone determines."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key).limit(n)


def signals(votes_: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Per axis, value and tier: votes, votes that another value overrode (shadowed), and confidence spread."""
    both = votes_.join(decided.select(key, "axis", F.col("value").alias("__won"), "confidence"), [key, "axis"])
    return both.groupBy("axis", "value", "tier").agg(F.count(F.lit(1)).alias("votes"), F.count(F.when(F.col("value") != F.col("__won"), 1)).alias("shadowed"), F.min("confidence").alias("lo"), F.max("confidence").alias("hi"))


def override_words(votes_: DataFrame, decided: DataFrame, texts_: DataFrame, key: str, text: str, most: int) -> DataFrame:
    """The words of units whose vote another value overrode: (axis, value, word, units), the most frequent of each axis and value."""
    lost = votes_.join(decided.select(key, "axis", F.col("value").alias("__won")), [key, "axis"]).filter(F.col("value") != F.col("__won")).select(key, "axis", "value").distinct()
    words = texts_.select(key, F.explode(F.array_distinct(F.filter(F.split(F.lower(text), "[^a-z0-9#]+"), lambda x: x != ""))).alias("word"))
    n = lost.join(words, key).groupBy("axis", "value", "word").agg(F.count(F.lit(1)).alias("units"))
    ranked = n.withColumn("__r", F.row_number().over(Window.partitionBy("axis", "value").orderBy(F.desc("units"), "word")))
    return ranked.filter(F.col("__r") <= most).drop("__r")


def texts(df: DataFrame, text: str, decided: Column, n: int) -> DataFrame:
    """The most frequent texts, with rows that are and are not decided."""
    return df.groupBy(text).agg(F.count(F.when(decided, 1)).alias("resolved"), F.count(F.when(~decided, 1)).alias("unresolved")).orderBy(F.desc("unresolved"), F.desc("resolved"), text).limit(n)


def disagreements(votes_: DataFrame, key: str) -> DataFrame:
    """Rule pairs of equal tier that gave different values to one unit: (axis, tier, a, b, n)."""
    a = votes_.select(key, "axis", "tier", F.col("rule").alias("a"), F.col("value").alias("__va"))
    b = votes_.select(key, "axis", "tier", F.col("rule").alias("b"), F.col("value").alias("__vb"))
    return a.join(b, [key, "axis", "tier"]).filter("a < b and __va != __vb").groupBy("axis", "tier", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def beaten(votes_: DataFrame, key: str, place: Column) -> DataFrame:
    """Who beat whom: (axis, winner, loser, n) over the units where a rule's value stood over another's; the least place wins."""
    rows = votes_.withColumn("__place", place)
    won = rows.groupBy(key, "axis").agg(F.min(F.struct("__place", "rule", "value")).alias("__w"))
    lost = rows.join(won, [key, "axis"]).filter(F.col("value") != F.col("__w.value"))
    return lost.groupBy("axis", F.col("__w.rule").alias("winner"), F.col("rule").alias("loser")).agg(F.count(F.lit(1)).alias("n"))


def order_independence(asked: DataFrame, reference: DataFrame, key: str, dims: Mapping[str, float | tuple[str, float]], answer: str, parts: int = 4, **how) -> DataFrame:
    """(units, answered, differ): the vote over hash parts of the asked rows, taken forward and backward, and the answers that differ."""
    cut = [asked.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == i) for i in range(parts)]
    run = lambda order, n: reduce(lambda a, b: a.unionByName(b), [neighbour_vote(x, reference, key, dims, answer, **how) for x in order]).select(key, F.struct("voted", "method").alias(n))
    both = run(cut, "a").join(run(cut[::-1], "b"), key, "full_outer")
    return both.agg(F.count(F.lit(1)).alias("units"), F.count("a.voted").alias("answered"), F.count(F.when(~F.col("a").eqNullSafe(F.col("b")), 1)).alias("differ"))


def illegal(df: DataFrame, key: str, constraints: DataFrame, axes: tuple[str, str]) -> DataFrame:
    """Units whose pair of answers is not among the allowed ones; a null answer breaks nothing."""
    a, b = axes
    rows = df.select(key, a, b).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return rows.join(small_or_shuffled(constraints.select(a, b).distinct()), [a, b], "left_anti")


def tally(df: DataFrame, batch: str, kind: str, key: str, samples: int = 3) -> DataFrame:
    """Per batch and kind: rows and the first few keys; only those few are ever gathered."""
    return first_keys(df, [batch, kind], key, samples, "n", "samples")


def holdout(df: DataFrame, key: str, dims: Mapping[str, float], answer: str, share: float, seed: str, **how) -> DataFrame:
    """Hide a seeded share of the decided rows, vote from the rest: asked, answered, right, by method."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    known = df.filter(F.col(answer).isNotNull()).withColumn("__u", u)
    hidden, rest = known.filter(F.col("__u") < share), known.filter(F.col("__u") >= share)
    got = neighbour_vote(hidden.withColumnRenamed(answer, "__truth"), rest, key, dims, answer, keep=["__truth"], **how)
    return got.groupBy("method").agg(F.count(F.lit(1)).alias("asked"), F.count("voted").alias("answered"), F.count(F.when(F.col("voted") == F.col("__truth"), 1)).alias("right"))
