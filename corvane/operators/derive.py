"""Facts of units derived from their rows: keys, orientation, splits, coverage, scales, intervals, health of a dataset."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def signature_key(exact: Sequence[str], rounded: Mapping[str, int]) -> Column:
    """Digest of normalised fields, each escaped so that joined ones cannot be confused."""
    safe = lambda c: F.regexp_replace(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\\", r"\\\\"), r"\|", r"\\|")
    return F.md5(F.concat_ws("|", *[safe(F.col(c)) for c in exact], *[F.coalesce(F.round(F.col(c) * 10**n).cast("long").cast("string"), F.lit("")) for c, n in rounded.items()]))


def units(df: DataFrame, parent: str, key: Column) -> DataFrame:
    """Rows of a parent with equal keys are one unit, numbered in key order."""
    return df.withColumn("unit_key", key).withColumn("unit_index", F.dense_rank().over(Window.partitionBy(parent).orderBy("unit_key")))


def orientation(df: DataFrame, row: Sequence[str], column: Sequence[str]) -> DataFrame:
    """Class from two direction vectors: their cross product's dominant axis, and its share of the length as confidence; of equal axes the first counts."""
    a, b = [F.col(c) for c in row], [F.col(c) for c in column]
    n = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = [F.abs(x) for x in n]
    length = F.sqrt(sum((x * x for x in n), F.lit(0.0)))
    top = F.greatest(*size)
    name = F.when(length < 1e-10, F.lit(None)).when(top == size[0], "sagittal").when(top == size[1], "coronal").otherwise("axial")
    return df.withColumn("orientation", name).withColumn("orientation_confidence", F.round(F.try_divide(top, length), 6))


def merge_split(df: DataFrame, parent: str, rest: Sequence[str], discriminator: str, moment: str, position: str) -> DataFrame:
    """Units equal in all but the discriminator become one where they state fewer than two moments, unless every one
    of them states the moment and all hold the same positions (then the discriminator tells real units apart).

    Adds `merged`: whether the row's rest group is joined.  A unit with a row of unknown position holds no known
    set.  Equal sets, rows counted, are told by a count and two order-free sums of hashes.
    """
    by = [parent, *rest]
    known = F.count(F.lit(1)) == F.count(position)
    sets = df.groupBy(*by, discriminator).agg(F.count(F.lit(1)).alias("__n"), F.bit_xor(F.xxhash64(position)).alias("__x"), F.sum(F.pmod(F.xxhash64(position), F.lit((1 << 31) - 1))).alias("__y"), known.alias("__known"), F.min(moment).alias("__lo"), F.max(moment).alias("__hi"))
    facts = sets.groupBy(*by).agg(F.count(F.lit(1)).alias("__values"), F.countDistinct("__n", "__x", "__y").alias("__sets"), F.min("__known").alias("__known"), F.count("__lo").alias("__timed"), F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))
    one_moment = F.col("__lo").isNull() | (F.col("__lo") == F.col("__hi"))
    apart = F.col("__known") & (F.col("__timed") == F.col("__values")) & (F.col("__sets") == 1)
    return df.join(facts.select(*by, ((F.col("__values") >= 2) & one_moment & ~apart).alias("merged")), by)


def positions(df: DataFrame, key: str, position: str, tolerance: float = 0.01) -> DataFrame:
    """Per key the distinct positions, those within tolerance of a cluster's lowest counted once; span and centre, of the least and greatest, to hundredths."""
    lists = df.filter(F.col(position).isNotNull() & ~F.isnan(F.col(position).cast("double")) & (F.abs(F.col(position).cast("double")) < F.lit(float("inf")))).groupBy(key).agg(F.array_sort(F.collect_set(F.col(position).cast("double"))).alias("__p"))
    kept = F.aggregate("__p", F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) > tolerance), F.concat(acc, F.array(x))).otherwise(acc))
    out = lists.select(key, kept.alias("__k"), F.array_min("__p").alias("__lo"), F.array_max("__p").alias("__hi"))
    return out.select(key, F.size("__k").alias("n_positions"), F.round(F.col("__hi") - F.col("__lo"), 2).alias("span"), F.round((F.col("__lo") + F.col("__hi")) / 2, 2).alias("centre"))


def coverage_differs(n1: Column, n2: Column, span1: Column, span2: Column, centre1: Column, centre2: Column, span_by: float, moved_by: float, least_span: float = 1.0) -> tuple[Column, Column]:
    """(differs, moved) of two coverages: other numbers of positions, or spans further apart than least_span and span_by of the larger; what is absent never differs."""
    apart = F.abs(span1 - span2) > F.greatest(F.lit(least_span), span_by * F.greatest(F.abs(span1), F.abs(span2)))
    differs = F.when(n1.isNull() | n2.isNull(), False).when(n1 != n2, True).otherwise(F.coalesce(apart, F.lit(False)))
    return differs, F.coalesce(F.abs(centre1 - centre2) > moved_by, F.lit(False))


#: Field strengths that scanners are built at, and how far a reading of each may be off; fixed values.
STRENGTHS = ((0.5, 0.15), (1.0, 0.15), (1.5, 0.15), (3.0, 0.3), (7.0, 0.5))


def field_strength(x: Column) -> Column:
    """A reading as struct(normalized, tesla, unit): the first of tesla, gauss and thousandths that lands on a standard
    strength; a reading that never does stands as tesla without one; what is not above 0 is null."""

    def on_grid(t: Column) -> Column:
        return F.coalesce(*[F.when(F.abs(t - s) <= within, F.lit(s)) for s, within in STRENGTHS])

    def read(unit: str, t: Column) -> Column:
        return F.struct(on_grid(t).alias("normalized"), t.alias("tesla"), F.lit(unit).alias("unit"))

    x = F.when((x > 0) & (x < F.lit(float("inf"))), x.cast("double"))
    units_ = [("tesla", x), ("gauss", x / 10_000), ("milli", x / 1_000)]
    landed = F.coalesce(*[F.when(on_grid(t).isNotNull(), read(unit, t)) for unit, t in units_])
    return F.when(x.isNotNull(), F.coalesce(landed, read("tesla", x)))


def first_of(*facts: tuple[Column, str]) -> tuple[Column, Column]:
    """The first fact that is stated, and the name of its source."""
    value, source = F.lit(None), F.lit(None).cast("string")
    for fact, name in reversed(facts):
        value, source = F.when(fact.isNotNull(), fact).otherwise(value), F.when(fact.isNotNull(), name).otherwise(source)
    return value, source


def role(tokens: Column, roles: Sequence[tuple[str, str]], default: str) -> Column:
    """The first role whose token the list holds."""
    out = F.lit(default)
    for token, name in reversed(roles):
        out = F.when(F.array_contains(tokens, token), name).otherwise(out)
    return out


def shells(df: DataFrame, key: str, value: str, step: float, gate: Column, vector: Sequence[str], phase: str) -> DataFrame:
    """Per key, where the gate holds: the distinct values on a grid, sorted; the distinct directions (to two decimals, either sign being one) of rows off
    zero; and the encoding direction, where the rows state just one."""
    on = F.round(F.col(value) / step)
    parts = [F.round(F.col(c), 2) + F.lit(0.0) for c in vector]
    lead = F.coalesce(*[F.when(c != 0, F.signum(c)) for c in parts], F.lit(1.0))
    direction = F.concat_ws(",", *[F.format_string("%.2f", c * lead + F.lit(0.0)) for c in parts])
    every = F.transform(F.array_sort(F.collect_set((on * step).cast("long"))), lambda x: x.cast("string"))
    phases = F.countDistinct(phase)
    return df.filter(gate).groupBy(key).agg(F.array_join(every, ",").alias("shells"), F.countDistinct(F.when(on != 0, direction)).alias("directions"), F.when(phases == 1, F.min(phase)).alias("encoding"))


def frame_interval(df: DataFrame, key: str, position: str, second: str, stated: str | None = None, day: str | None = None) -> DataFrame:
    """Seconds between repeats of a position: (latest - earliest) / (times - 1), then the median over positions; a positive stated value wins.

    A position whose times lie on more than one day is left out.
    """
    days = F.countDistinct(day) if day else F.lit(1)
    per = df.groupBy(key, position).agg(F.min(second).alias("a"), F.max(second).alias("b"), F.countDistinct(second).alias("n"), days.alias("__days"), *([F.max(stated).alias("__s")] if stated else []))
    out = per.groupBy(key).agg(F.median(F.when((F.col("n") > 1) & (F.col("__days") <= 1), (F.col("b") - F.col("a")) / (F.col("n") - 1))).alias("__m"), *([F.max("__s").alias("__s")] if stated else []))
    s = F.when(F.col("__s") > 0, F.col("__s")) if stated else F.lit(None).cast("double")
    return out.select(key, F.round(F.coalesce(s, F.col("__m")), 4).alias("frame_interval"), F.when(s.isNotNull(), "stated").when(F.col("__m").isNotNull(), "derived").alias("interval_source"))


def earliest(df: DataFrame, key: str, day: str, time: str) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct(F.col(day).alias("day"), F.col(time).alias("time"))).alias("m")).select(key, "m.day", "m.time")


def normal_text(text: Column) -> Column:
    """NFKC, white space to single blanks; the one place here that needs Python, batch-wise."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))

    return F.trim(F.regexp_replace(nfkc(text), r"\s+", " "))


def wide(df: DataFrame, key: str, axis: str, value: str, axes: Sequence[str]) -> DataFrame:
    """Long axis table to one row per key; several values of an axis are sorted and comma-joined."""
    return df.groupBy(key).agg(*[F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col(axis) == a, F.col(value)))), ","), F.lit("")).alias(a) for a in axes])


def stale(read_model: DataFrame, recomputed: DataFrame) -> DataFrame:
    """Rows of a kept read model that recomputation does not give."""
    return read_model.exceptAll(recomputed.select(*read_model.columns))


def childless(parents: DataFrame, children: DataFrame, key: str, link: str) -> DataFrame:
    return parents.join(children.select(F.col(link).alias(key)), key, "left_anti")


def header_health(df: DataFrame, dataset: str, name: str, maker: str, known_words: Sequence[str], known_makers: Sequence[str], most: float) -> DataFrame:
    """Per dataset the shares of nameless rows, of rows whose name holds no known word and of unseen makers, and whether one passes the bar."""
    word = F.exists(F.split(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+"), lambda w: w.isin(list(known_words)))
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = df.groupBy(dataset).agg(share(F.coalesce(name, F.lit("")) == "").alias("nameless"), share(~word).alias("unknown_words"), share(~F.col(maker).isin(list(known_makers))).alias("unseen_maker"))
    return out.withColumn("damaged", F.greatest("nameless", "unknown_words", "unseen_maker") > most)
