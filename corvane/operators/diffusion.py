"""What the image rows of a unit say about diffusion: weightings, directions played, the way the phase was encoded.

Measured values come first; text is read only where they are silent, and the loose patterns of a text (a count of
directions, a way) only once something specific says that this is diffusion at all.  One aggregation by unit; what a
unit gathers is bounded by the 10,001 weightings there can be, and directions are counted, not listed.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST = 10_000  # a weighting above this is a sentinel or a misread
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# A b at the start of a token or after iso, a number or a range of them; a trailing t or #index may follow, no other letter or digit.
# Possessive throughout, so that a part of a longer number or range is never read.
_SHELL = r"(?i)(?:(?<![^_ =\-:/*\t])|(?<=iso))b[ =\-]?+([0-9]{1,4}+(?:[-/_][0-9]{1,4}+)*+)(?:t|#[0-9]{0,4}+)?+(?![0-9a-z])"
_WAY = r"(?i)(?<![0-9a-z])(AP|PA|RL|LR)(?![0-9a-z])"
_COUNT = r"(?i)(?<![0-9])([0-9]{1,3}+) *+(?:dir|rikt)"


class Fields(NamedTuple):
    """The columns of image rows.  None: not recorded.  cosines: six numbers, row then column, between backslashes or commas."""

    private: Sequence[str] = ()
    standard: str | None = None
    gradient: str | None = None
    directionality: Sequence[str] = ()
    counted: str | None = None
    cosines: str | None = None
    in_plane: str | None = None
    positive: str | None = None
    text: str | None = None


def _numbers(text: Column) -> Column:
    """The numbers between the backslashes of a text; parts that are none are left out."""
    parts = F.transform(F.split(text, r"\\"), lambda p: F.trim(p))
    return F.transform(F.filter(parts, lambda p: p.rlike(_NUMBER)), lambda p: p.cast("double"))


def _plausible(values: Column) -> Column:
    """Whole weightings of an array of doubles, without those out of range."""
    return F.transform(F.filter(values, lambda v: v.isNotNull() & ~F.isnan(v) & F.round(v).between(0, MOST)), lambda v: F.round(v).cast("int"))


def shells_within(text: Column) -> Column:
    """The weightings written into a name: b1000, b=1000, isob1000, *ep_b1000t, *ep_b1000#32, b0-500-1000; a length or a word is none."""
    runs = F.regexp_extract_all(text, F.lit(_SHELL), F.lit(1))
    return F.array_distinct(F.flatten(F.transform(runs, lambda run: F.transform(F.split(run, "[-/_]"), lambda n: n.cast("int")))))


def way_within(text: Column) -> Column:
    """The first of AP, PA, RL, LR that stands alone in a text, or null."""
    return F.nullif(F.upper(F.regexp_extract(text, _WAY, 1)), F.lit(""))


def count_within(text: Column) -> Column:
    """A count of directions (2 to 256) written into a name: the first number before dir or rikt, else the number after the first dir."""
    fits = lambda n: n.between(2, 256)
    before = F.get(F.filter(F.transform(F.regexp_extract_all(text, F.lit(_COUNT), F.lit(1)), lambda n: n.cast("int")), fits), F.lit(0))
    rest = F.substring(text, F.locate("dir", F.lower(text)), F.length(text))
    after = F.nullif(F.regexp_extract(rest, r"(?i)^dir[ _]*+([0-9]{1,3}+)", 1), F.lit("")).cast("int")
    return F.coalesce(before, F.when((F.locate("dir", F.lower(text)) > 0) & fits(after), after))


def _cosines(text: Column) -> Column:
    return _numbers(F.replace(text, F.lit(","), F.lit("\\")))


def _way(cosines: Column, in_plane: Column, positive: Column) -> Column:
    plane = F.upper(F.trim(in_plane))
    at = F.when(plane == "COL", 3).when(plane == "ROW", 0)
    x, y, z = (F.get(cosines, at + i) for i in range(3))
    top = F.greatest(F.abs(x), F.abs(y), F.abs(z))
    ways = ((z, "IS", "SI"), (y, "AP", "PA"), (x, "RL", "LR"))
    out = F.lit(None).cast("string")
    for part, along, against in reversed(ways):
        out = F.when(F.abs(part) == top, F.when((part >= 0) == (positive == 1), along).otherwise(against)).otherwise(out)
    return F.when((F.size(cosines) >= 6) & positive.isNotNull() & (top >= 1e-6), out)


def way_of(cosines: Column, in_plane: Column, positive: Column) -> Column:
    """The way along which the phase ran: the in-plane axis's cosine of greatest size (the later axis of equals), its sign, and
    whether the encoding ran with it.  Null where the axis, the flag or six cosines are not given: no guess."""
    return _way(_cosines(cosines), in_plane, positive)


def _played(vector: Column, directionality: Sequence[str]) -> Column:
    kind = F.upper(F.coalesce(*[F.col(c) for c in directionality], F.lit("")))
    return ~kind.rlike("NONE|ISOTROPIC") & (F.size(vector) == 3) & F.exists(vector, lambda p: F.abs(p) > 0.001)


def _places(vector: Column) -> Column:
    return F.transform(vector, lambda p: F.round(p * 10_000).cast("long"))


def _only(value: Column) -> Column:
    """The one value that the rows of a unit state; null if they state none or several."""
    return F.when(F.min(value) == F.max(value), F.min(value))


def facts(images: DataFrame, unit: str, fields: Fields) -> DataFrame:
    """One row for each unit: shell, shells and their source, way and its source, directions and their source.

    shell: the greatest weighting (0 if that is all); shells: all of them, rising, between commas; source: private, standard,
    text, in this order.  The text is asked for weightings only if the rows measure none but 0.  way: by geometry, else by
    text; rows that contradict each other give none, and then the text is not asked (source conflict).  directions: the
    scanner's own count (1 to 1,024), else the distinct gradients of weighted rows to four places, else a text's count; counts
    that differ between rows are no answer.  A unit that nothing specific calls diffusion has nulls throughout.
    """
    none = lambda kind: F.lit(None).cast(kind)
    col = lambda name, kind="string": F.col(name) if name else none(kind)
    private = _plausible(F.array(*[F.col(c).cast("double") for c in fields.private]).cast("array<double>"))
    standard = F.coalesce(_plausible(_numbers(col(fields.standard))), F.array().cast("array<int>"))
    said = [F.col(c).isNotNull() for c in (*fields.private, fields.standard, fields.gradient, *fields.directionality) if c]
    counted = col(fields.counted, "long").cast("long")
    # numbers are read in a projection of their own, so that what uses them more than once does not read them again
    read = images.withColumns({"__cosines": _cosines(col(fields.cosines)), "__gradient": _numbers(col(fields.gradient))})
    rows = read.select(
        F.col(unit),
        private.alias("__private"),
        standard.alias("__standard"),
        (F.greatest(*said, F.lit(False)) if said else F.lit(False)).alias("__said"),
        F.when(_played(F.col("__gradient"), fields.directionality), _places(F.col("__gradient"))).alias("__vector"),
        counted.alias("__counted"),
        _way(F.col("__cosines"), col(fields.in_plane), col(fields.positive, "int")).alias("__way"),
        shells_within(col(fields.text)).alias("__named"),
        way_within(col(fields.text)).alias("__text_way"),
        count_within(col(fields.text)).alias("__text_count"),
    )
    # distinct weightings of a unit: every row's array is one of few, and equal ones are combined before the shuffle
    every = lambda name: F.array_distinct(F.flatten(F.collect_set(F.when(F.size(name) > 0, F.col(name)))))
    g = rows.groupBy(unit).agg(
        every("__private").alias("p"),
        every("__standard").alias("s"),
        every("__named").alias("t"),
        F.max("__said").alias("said"),
        F.count("__counted").alias("counts"),
        _only(F.when(F.col("__counted").between(1, 1024), F.col("__counted"))).alias("counted"),
        F.countDistinct("__vector").alias("vectors"),
        F.min("__way").alias("way"),
        F.max("__way").alias("other_way"),
        F.min("__text_way").alias("text_way"),
        F.max("__text_way").alias("other_text_way"),
        _only(F.col("__text_count")).alias("text_count"),
    )
    measured = F.array_union("p", "s")
    asked = F.forall(measured, lambda v: v == 0)
    t = F.when(asked, F.col("t")).otherwise(F.array().cast("array<int>"))
    g = g.withColumn("b", F.array_sort(F.array_union(measured, t))).withColumn("from_text", F.size(t) > 0)
    sources = F.concat_ws(",", *[F.when(on, name) for on, name in ((F.size("p") > 0, "private"), (F.size("s") > 0, "standard"), (F.col("from_text"), "text"))])
    found = F.size("b") > 0
    diffusion = F.col("said") | (F.col("counts") > 0) | found
    clash = F.when(F.col("said") & F.col("way").isNotNull(), F.col("way") != F.col("other_way")).otherwise(F.col("text_way") != F.col("other_text_way"))
    by_shape = F.col("said") & F.col("way").isNotNull()
    way = F.when(clash, None).otherwise(F.when(by_shape, F.col("way")).otherwise(F.col("text_way")))
    way_source = F.when(clash, "conflict").when(by_shape, "geometry").when(F.col("text_way").isNotNull(), "text")
    ways = F.coalesce("counted", F.nullif("vectors", F.lit(0)), "text_count")
    ways_source = F.when(F.col("counted").isNotNull(), "vendor_count").when(F.col("vectors") > 0, "gradients").when(F.col("text_count").isNotNull(), "text")
    return g.select(
        unit,
        F.when(found, F.array_max("b")).alias("shell"),
        F.when(found, F.array_join(F.transform("b", lambda v: v.cast("string")), ",")).alias("shells"),
        F.when(found, sources).alias("shell_source"),
        F.when(diffusion, way).alias("way"),
        F.when(diffusion, way_source).alias("way_source"),
        F.when(diffusion, ways).cast("long").alias("directions"),
        F.when(diffusion, ways_source).alias("directions_source"),
    )


def directions_played(images: DataFrame, unit: str, gradient: str, directionality: Sequence[str] = ()) -> DataFrame:
    """(unit, direction): each distinct direction of weighted rows once, as x,y,z to four places, so that units can be compared."""
    read = images.withColumn("__gradient", _numbers(F.col(gradient)))
    whole = _places(F.col("__gradient"))
    text = F.array_join(F.transform(whole, lambda n: F.format_string("%s%d.%04d", F.when(n < 0, "-").otherwise(""), F.floor(F.abs(n) / 10_000), F.abs(n) % 10_000)), ",")
    return read.filter(_played(F.col("__gradient"), directionality)).select(unit, text.alias("direction")).distinct()
