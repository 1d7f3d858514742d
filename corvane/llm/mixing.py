"""Mixing sources to target weights by temperature, with DataFrame functions only.

A source's weight is its token share to the power of an exponent, normalised.
The exponent is bisected to meet a target entropy or a repetition limit: each
round sums the entropies (or finds the ratios) at 31 inner points of the interval in one
aggregation over the sources, which takes five bisection steps at once.  The
weights are realised as a budgeted block permutation: a source's documents are
ordered by an even hash, in another order in each pass, passed over whole as often as its budget allows, and
the last pass stops where the budget is met; a placement's block follows from how far its source
has come, so every block holds the sources in their weights.

Defined results: a null source is a source of its own; texts without words have
no tokens and are placed with the first pass only; documents of a repeated
doc_id are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

_POINTS = 32
BLOCKS = 1024


def shares(rows: DataFrame) -> DataFrame:
    """(__source, tokens, share) from rows of (__source, n_tokens); sources without tokens have share 0."""
    sums = rows.groupBy("__source").agg(F.sum("n_tokens").alias("tokens"))
    return C.stored(sums.crossJoin(F.broadcast(sums.agg(F.sum("tokens").alias("__all")))).select("__source", "tokens", F.coalesce(F.try_divide("tokens", "__all"), F.lit(0.0)).alias("share")))


def _bisect(rows: DataFrame, below: Column, rounds: int = 7) -> float:
    """The exponent in [0, 1] where `below`, an aggregate of (t, share) that turns from true to false as t grows, turns."""
    lo, hi = 0.0, 1.0
    points = F.explode(F.sequence(F.lit(0), F.lit(_POINTS)))
    for _ in range(rounds):
        grid = rows.filter("share > 0").select("share", points.alias("i")).withColumn("t", F.lit(lo) + (F.lit(hi) - F.lit(lo)) * F.col("i") / _POINTS)
        good = grid.groupBy("i").agg(below.alias("ok")).filter("ok").agg(F.max("i")).first()[0]
        if good is None:
            return lo
        step = (hi - lo) / _POINTS
        lo, hi = lo + step * good, min(hi, lo + step * (good + 1))
    return lo


def exponent_for_entropy(rows: DataFrame, target: float) -> float:
    """The greatest exponent whose weights have at least the target entropy (nats)."""
    power = F.pow("share", F.col("t"))
    entropy = F.log(F.sum(power)) - F.sum(power * F.col("t") * F.log("share")) / F.sum(power)
    return _bisect(rows, entropy >= F.lit(target))


def exponent_for_repetition(rows: DataFrame, most: float) -> float:
    """The least exponent at which no source is repeated more than `most` times as often as the least repeated one."""
    spread = F.pow(F.max("share") / F.min("share"), 1 - F.max("t"))
    return min(1.0, _bisect(rows, spread > F.lit(most)) + 1e-9)


def weights(rows: DataFrame, exponent: float, budget: int | None) -> DataFrame:
    """(__source, tokens, weight, goal, target): goal is the source's budget, target the whole tokens
    before whose last one a document must begin to be placed.

    Without a budget it is the least with which every document is placed once.
    """
    powers = rows.withColumn("__p", F.when(F.col("share") > 0, F.pow("share", F.lit(exponent))).otherwise(0.0))
    total = powers.agg(F.sum("__p").alias("__all"), F.max(F.try_divide("tokens", "__p")).alias("__cover"))
    given = F.col("__cover") if budget is None else F.try_divide(F.lit(float(budget)), F.col("__all"))
    goal = F.coalesce(F.col("__p") * given, F.lit(0.0))
    return powers.crossJoin(F.broadcast(total)).select("__source", "tokens", F.coalesce(F.try_divide("__p", "__all"), F.lit(0.0)).alias("weight"), goal.alias("goal"), F.ceil(goal * (1 - 4e-16) - 1e-6).cast("long").alias("target"))


def _rows(docs: DataFrame, *more: str) -> DataFrame:
    source = F.coalesce(F.concat(F.lit("s:"), F.col("source").cast("string")), F.lit("n:"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), source.alias("__source"), C.n_words(F.col("text")).alias("n_tokens"), F.length("text").alias("__len"), F.monotonically_increasing_id().alias("__row_id"), *more)


def _placed(rows: DataFrame, ties: list[str], entropy: float | None, repetition: float, budget: int | None, blocks: int) -> DataFrame:
    """Stored rows of _rows, each as often as it is placed, with weight, pass, block and the whole rank.

    Each pass over a source has an order of its own, by an even hash of the row and the pass.
    """
    per = shares(rows)
    exponent = exponent_for_repetition(per, repetition) if entropy is None else exponent_for_entropy(per, entropy)
    mix = weights(per, exponent, budget)
    # whole passes, and the tokens of the last one, which stops where the budget ends; texts of sources without tokens are placed once
    some = F.col("tokens") > 0
    mix = mix.withColumn("whole", F.when(some, F.expr("target div nullif(tokens, 0)")).otherwise(1)).withColumn("room", F.when(some, F.expr("target % nullif(tokens, 0)")).otherwise(0))
    last = F.greatest(F.lit(0).cast("long"), F.col("whole") + (F.col("room") > 0).cast("long") - 1).cast("int")
    turns = rows.join(C.hinted(mix), "__source").withColumn("pass", F.explode(F.sequence(F.lit(0), last)))
    turns = turns.filter((F.col("n_tokens") > 0) | (F.col("pass") == 0)).withColumn("__key", C.dealt_key(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), "__row_id")), F.col("__len"), F.col("pass")))
    placed = C.ranked(turns, ["__source", "pass"], "__key", "n_tokens", ties)
    placed = placed.filter((F.col("pass") < F.col("whole")) | (F.col("sum_before") < F.col("room")))
    rank = F.coalesce(F.least(F.lit(1.0), F.try_divide(F.col("pass") * F.col("tokens") + F.col("sum_before"), F.col("goal"))), F.lit(0.0))
    return placed.withColumn("rank", rank).withColumn("block", F.least(F.floor(F.col("rank") * blocks).cast("int"), F.lit(blocks - 1)))


def plan(docs: DataFrame, entropy: float | None = None, repetition: float = 2.0, budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """One row per placement: doc_id, source, n_tokens, weight, pass, block, rank (0 to 1, the order of the mixture)."""
    placed = _placed(C.stored(_rows(docs)), ["doc_id", "__len"], entropy, repetition, budget, blocks)
    return placed.select("doc_id", F.when(F.col("__source") != "n:", F.substring("__source", 3, 1 << 30)).alias("source"), "n_tokens", F.round("weight", 9).alias("weight"), "pass", "block", F.round("rank", 9).alias("rank"))


def mix(docs: DataFrame, entropy: float | None = None, repetition: float = 2.0, budget: int | None = None, blocks: int = BLOCKS) -> DataFrame:
    """docs, all columns, each row as often as the plan places it, in the order of its blocks and ranks.

    Rows get a number and are stored with it, so that a placement finds its own row whatever repeats.
    """
    at, turn, block, rank = C.fresh(docs, "mix_at", "mix_pass", "mix_block", "mix_rank")
    since = C.mark()
    numbered = C.stored(docs.withColumn(at, F.monotonically_increasing_id()))
    placed = _placed(C.stored(_rows(numbered, at)), ["doc_id", "__len", at], entropy, repetition, budget, blocks)
    placed = C.stored(placed.select(at, F.col("pass").alias(turn), F.col("block").alias(block), F.col("rank").alias(rank)))
    C.discard(docs.sparkSession, since, numbered, placed)
    out = numbered.join(C.hinted(placed), at).orderBy(block, rank, at, turn)
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
