"""Grains as data: for each grain a relation, its key, its parent's key, its subject and its day.

The set operators take these names as arguments, so they run over any star of
tables.  retail() binds the grains to orders of customers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Grain:
    name: str
    key: str
    parent: str | None = None
    subject: str | None = None
    day: str | None = None


@dataclass
class GrainModel:
    """Base relations by grain, with the standing conditions that every question starts from."""

    grains: dict[str, Grain]
    frames: dict[str, DataFrame]
    standing: dict[str, Column] = field(default_factory=dict)

    def scan(self, grain: str, *columns: str) -> DataFrame:
        """The base relation of a grain: standing condition, spine and named columns only."""
        g, df = self.grains[grain], self.frames[grain]
        if grain in self.standing:
            df = df.filter(self.standing[grain])
        spine = [c for c in (g.key, g.parent, g.subject, g.day) if c]
        return df.select(*dict.fromkeys([*spine, *(columns or df.columns)]))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def retail(spark: SparkSession, sf_dir: str) -> GrainModel:
    """cohort = nation, subject = customer, session = order, unit = order line, event = event."""
    table = lambda n: read(spark, sf_dir, n)
    orders = table("orders").withColumn("day", F.to_date("o_orderdate"))
    lines = table("lineitem").withColumn("line_key", F.col("l_orderkey") * 8 + F.col("l_linenumber")).withColumn("day", F.to_date("l_shipdate"))
    events = table("events").withColumn("day", F.to_date("ts"))
    return GrainModel(
        {
            "cohort": Grain("cohort", "n_nationkey"),
            "subject": Grain("subject", "c_custkey", "c_nationkey", "c_custkey"),
            "session": Grain("session", "o_orderkey", "o_custkey", "o_custkey", "day"),
            "unit": Grain("unit", "line_key", "l_orderkey", None, "day"),
            "event": Grain("event", "event_id", "user_id", "user_id", "day"),
        },
        {"cohort": table("nation"), "subject": table("customer"), "session": orders, "unit": lines, "event": events},
        {"unit": F.col("l_quantity") > 0, "event": F.col("event_id").isNotNull()},
    )
