"""The first rows of groups, however large: parts of a group keep what they can contribute, then the group is decided on that."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Parts a group is dealt into; each keeps its first n.
PARTS = 64


def first_n(df: DataFrame, by: Sequence[str], order: Sequence[Column], dealt: str, n: int, name: str = "__rank", most: Column | None = None) -> DataFrame:
    """The first n rows of each group, numbered from 1 in column `name`; rows are dealt by column `dealt`.  With `most`, a number of the group's own, of these only so many."""
    parts = Window.partitionBy(*by, "__part").orderBy(*order)
    few = df.withColumn("__part", F.pmod(F.xxhash64(dealt), F.lit(PARTS))).withColumn(name, F.row_number().over(parts)).filter(F.col(name) <= n).drop("__part")
    out = few.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)
    return out if most is None else out.filter(F.col(name) <= most)


def beside(df: DataFrame, totals: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """Rows with the totals of their group; a null is a group."""
    other = totals.select(*[F.col(c).alias(f"__by{i}") for i, c in enumerate(by)], *[c for c in totals.columns if c not in by])
    same = [F.col(c).eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    return df.join(other, same, how).drop(*[f"__by{i}" for i in range(len(by))])


def first_share(df: DataFrame, by: Sequence[str], digest: Column, key: str, n: Column) -> DataFrame:
    """The first n rows of each group by an even hexadecimal digest, then key; n is an expression over __n, the group's rows.

    A group's rows are counted by the first 16 bits of their digests.  Cells before the one in which the n-th row falls are
    taken whole, and only rows of that cell are ordered.
    """
    rows = df.withColumn("__digest", digest).withColumn("__cell", F.conv(F.substring("__digest", 1, 4), 16, 10).cast("int"))
    cells = rows.groupBy(*by, "__cell").agg(F.count(F.lit(1)).alias("__size"))
    ahead = Window.partitionBy(*by).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)  # over 65,536 cells at most
    cells = cells.withColumn("__n", F.sum("__size").over(Window.partitionBy(*by))).withColumn("__ahead", F.coalesce(F.sum("__size").over(ahead), F.lit(0)))
    cells = cells.withColumn("__left", n.cast("bigint") - F.col("__ahead")).filter("__left > 0")
    rows = beside(rows, cells.select(*by, "__cell", "__size", "__left"), [*by, "__cell"])
    whole = rows.filter("__size <= __left")
    last = rows.filter("__size > __left").withColumn("__rank", F.row_number().over(Window.partitionBy(*by, "__cell").orderBy("__digest", key))).filter(F.col("__rank") <= F.col("__left"))
    hidden = ["__digest", "__cell", "__size", "__left"]
    return whole.drop(*hidden).unionByName(last.drop(*hidden, "__rank"))
