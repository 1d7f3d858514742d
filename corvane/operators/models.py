"""Work around models: scores, gates, pools, samples, calibration, fusion, heads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from corvane.plans.storage import small_or_shuffled, stored

from .firsts import beside, first_n, first_share


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a) * dot(b, b)))


def zero_shot(df: DataFrame, prompts: DataFrame, key: str, vector: str, temperature: float) -> DataFrame:
    """(key, label, probability, margin): softmax of cosines with each label's prompt vector; margin to the next label.

    Prompts are a handful, so they travel to the vectors; more than a thousand are refused.
    """
    if prompts.limit(1001).count() > 1000:
        raise ValueError("prompts are compared with every vector; at most 1,000 are taken")
    pairs = df.select(key, vector).crossJoin(F.broadcast(prompts.select("label", F.col("prompt"))))
    scored = pairs.select(key, "label", F.exp(cosine(F.col(vector), F.col("prompt")) * temperature).alias("e"))
    one = scored.groupBy(key).agg(F.sum("e").alias("__all"), F.sort_array(F.collect_list(F.struct("e", "label")), asc=False).alias("__l"))
    return one.select(key, F.element_at("__l", 1)["label"].alias("label"), F.round(F.element_at("__l", 1)["e"] / F.col("__all"), 6).alias("probability"), F.round((F.element_at("__l", 1)["e"] - F.element_at("__l", 2)["e"]) / F.col("__all"), 6).alias("margin"))


def threshold_gate(df: DataFrame, by: str, score: str, threshold: float, floor: int = 20) -> DataFrame:
    """Rows over the threshold; where fewer than min(floor, n) of a group pass, its best rows up to that number."""
    key = next((c for c in df.columns if c != score), score)
    passes = F.count(F.when(F.col(score) >= threshold, 1))
    groups = df.groupBy(by).agg(passes.alias("__pass"), F.least(F.lit(floor).cast("bigint"), F.count(F.lit(1))).alias("__need")).withColumn("__enough", F.col("__pass") >= F.col("__need"))
    over = beside(df.filter(F.col(score) >= threshold), groups.filter("__enough").select(by), [by])
    best = first_n(beside(df, groups.filter("not __enough").select(by, "__need"), [by]), [by], [F.desc(score), F.col(key)], key, floor, "__r", F.col("__need"))
    return over.unionByName(best.drop("__need", "__r"))


def _gap(against: np.ndarray):
    """Least of a known gap and the cosine distances of a vector to some unit vectors, to 9 digits."""

    @F.pandas_udf("double")
    def gap(vectors: pd.Series, before: pd.Series) -> pd.Series:
        x = np.stack(vectors.to_numpy()) if len(vectors) else np.zeros((0, against.shape[1]))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.Series(np.round(np.minimum(before.to_numpy(), 1 - (x @ against.T).max(axis=1, initial=-2.0)), 9))

    return gap


def diverse(df: DataFrame, key: str, vector: str, n: int, seed: str = "0") -> DataFrame:
    """(key, place): farthest-point pick of up to n rows by cosine distance, exact over all rows.

    The first is the row with the least seeded digest of its key; each next one is the row whose least
    distance to those picked is greatest (to 9 digits; equal ones by key).  It ends early where every row left lies on a
    picked one.  Each pick is one pass that keeps a single row; the least distances are stored every few picks.
    """
    rows = df.filter(F.col(vector).isNotNull()).select(F.col(key).alias("__k"), F.col(vector).cast("array<double>").alias("__v"), F.lit(2.0).cast("double").alias("__gap"))
    first = rows.select("__k", "__v").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "__k")), "__k").first()
    picked, fresh = [], []
    while first is not None:
        picked.append(first["__k"])
        fresh.append(np.asarray(first["__v"], float))
        if len(picked) == n:
            break
        against = np.stack(fresh)
        against /= np.maximum(np.linalg.norm(against, axis=1, keepdims=True), 1e-12)
        now = rows.select("__k", "__v", _gap(against)("__v", "__gap").alias("__gap"))
        if len(fresh) == 8:
            rows, fresh = stored(now), []
            now = rows
        # the greatest gap first, then the one row that has it and the least key
        top = now.agg(F.min(F.struct((-F.col("__gap")).alias("g"), F.col("__k").alias("k")))).first()[0]
        if top is None or -top["g"] <= 0:
            break
        first = now.filter(F.col("__k") == F.lit(top["k"])).select("__k", "__v").first()
    kind = df.schema[key].dataType
    return df.sparkSession.createDataFrame([(k, i) for i, k in enumerate(picked)], T.StructType([T.StructField(key, kind), T.StructField("place", T.IntegerType())]))


def pools(df: DataFrame, by: str, score: str, key: str, prior: float, budget: int) -> DataFrame:
    """Split a budget per group between scored (prior share) and unscored rows; what one pool cannot use the other gets."""
    scored = F.col(score).isNotNull()
    n1, n0, want1 = F.count(F.when(scored, 1)), F.count(F.when(~scored, 1)), F.lit(int(np.floor(budget * prior)))
    take1 = F.least(F.col("__n1"), want1 + F.greatest(F.lit(0).cast("bigint"), F.lit(budget) - want1 - F.col("__n0")))
    groups = df.groupBy(by).agg(n1.alias("__n1"), n0.alias("__n0")).withColumn("__take1", take1)
    groups = groups.select(by, "__take1", F.least(F.col("__n0"), F.lit(budget) - F.col("__take1")).alias("__take0"))
    rows = beside(df.withColumn("__scored", scored), groups, [by])
    taken = first_n(rows, [by, "__scored"], [F.desc(score), F.col(key)], key, budget, "__r", F.when(F.col("__scored"), F.col("__take1")).otherwise(F.col("__take0")))
    return taken.drop("__scored", "__take1", "__take0", "__r")


def stratified(df: DataFrame, cells: Sequence[str], key: str, cap: int, seed: str) -> DataFrame:
    """Seeded subsample in proportion to the cells' sizes, at least one row of each: the first max(1, round(cap * share)) by digest."""
    n = F.lit(df.count())
    return first_share(df, cells, F.md5(F.concat_ws(":", F.lit(seed), F.col(key))), key, F.greatest(F.lit(1), F.round(F.col("__n") * cap / n)))


def unit_answer(df: DataFrame, unit: str, position: str, label: str, p: str, orientation: str, top: str, bottom: str, both: str) -> DataFrame:
    """(unit, answer, p, rule): slices' probabilities, a row for each slice and label, to one answer per unit.

    An axial unit of four slices or more whose first 40 % are mostly `top` and last 40 % mostly `bottom` is `both`, with the
    lesser of the two means; the middle slice of sagittal and coronal units counts twice; else means
    decide, of equal ones the first label.
    """
    w = Window.partitionBy(unit, label)
    rows = df.withColumn("__at", F.row_number().over(w.orderBy(position)) - 1).withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__o", F.lower(F.trim(F.coalesce(orientation, F.lit("")))))
    edge = F.greatest(F.lit(1), F.floor(F.col("__n") * 2 / 5))
    twice = F.col("__o").isin("sagittal", "coronal") & (F.col("__at") == F.floor(F.col("__n") / 2))
    weight = F.when(twice, 2.0).otherwise(1.0)
    mean = lambda c: F.round(F.avg(c), 9)
    per = rows.groupBy(unit, label).agg(F.max("__o").alias("__o"), F.max("__n").alias("__n"), F.round(F.sum(F.col(p) * weight) / F.sum(weight), 9).alias("__mean"), mean(F.when(F.col("__at") < edge, F.col(p))).alias("__first"), mean(F.when(F.col("__at") >= F.col("__n") - edge, F.col(p))).alias("__last"))
    best = lambda c: F.min(F.struct((-F.col(c)).alias("p"), F.col(label).alias("label")))
    of = per.groupBy(unit).agg(F.max("__o").alias("__o"), F.max("__n").alias("__n"), best("__mean").alias("__m"), best("__first").alias("__f"), best("__last").alias("__l"), F.count(F.when(F.col(label) == both, 1)).alias("__known"))
    composed = (F.col("__o") == "axial") & (F.col("__n") >= 4) & (F.col("__known") > 0) & (F.col("__f.label") == top) & (F.col("__l.label") == bottom)
    rule = F.when(composed, "composed").when(F.col("__o").isin("sagittal", "coronal"), "centre").otherwise("mean")
    return of.select(unit, F.when(composed, both).otherwise(F.col("__m.label")).alias("answer"), F.round(F.when(composed, F.least(-F.col("__f.p"), -F.col("__l.p"))).otherwise(-F.col("__m.p")), 6).alias("p"), rule.alias("rule"))


def head(df: DataFrame, vector: str, label: str, components: Sequence[int], folds: int = 3, seed: int = 7):
    """Scaler, principal components chosen by cross-validation, and a class-balanced logistic model; the fitted model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__k"))
    rows = df.join(F.broadcast(n.crossJoin(total)), label).withColumn("weight", F.col("__all") / (F.col("__k") * F.col("__n"))).withColumn("x", array_to_vector(F.col(vector).cast("array<double>"))).withColumn("label", F.col(label).cast("double"))
    pca = PCA(inputCol="scaled", outputCol="features", k=components[0])
    stages = [StandardScaler(inputCol="x", outputCol="scaled", withMean=True), pca, LogisticRegression(weightCol="weight", maxIter=50, regParam=0.01)]
    grid = ParamGridBuilder().addGrid(pca.k, list(components)).build()
    return CrossValidator(estimator=Pipeline(stages=stages), estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed).fit(rows.select("x", "label", "weight"))


def temperature(df: DataFrame, logits: str, label: str, grid: Sequence[float]) -> DataFrame:
    """(temperature, loss) of every grid point in one pass; the least loss is the fit."""
    t = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("temperature")
    rows = df.select(logits, label, t)
    scaled = F.transform(logits, lambda z: z.cast("double") / F.col("temperature"))
    top = F.array_max(scaled)
    loss = F.log(F.aggregate(scaled, F.lit(0.0), lambda s, z: s + F.exp(z - top))) + top - F.element_at(scaled, F.col(label).cast("int") + 1)
    return rows.groupBy("temperature").agg(F.round(F.avg(loss), 9).alias("loss"))


def calibration_error(df: DataFrame, p: str, right: Column, bins: int = 15) -> DataFrame:
    """Expected calibration error over equal bins of confidence."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    per = df.groupBy(b.alias("b")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("p"), F.avg(right.cast("double")).alias("r"))
    return per.agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("r"))) / F.sum("n"), 9).alias("ece"))


def brier(df: DataFrame, probabilities: str, label: str) -> DataFrame:
    """Multi-class Brier score."""
    hot = F.transform(probabilities, lambda p, i: F.pow(p.cast("double") - F.when(i == F.col(label), 1.0).otherwise(0.0), 2))
    return df.agg(F.round(F.avg(F.aggregate(hot, F.lit(0.0), lambda s, x: s + x)), 9).alias("brier"))


def platt(df: DataFrame, site: str, score: str, label: str, least: int = 20, rounds: int = 200, halvings: int = 20) -> tuple[DataFrame, DataFrame]:
    """(site, a, b, rows, converged) of a logistic curve per site with smoothed targets; and sites left out with their rows.

    Newton's method with halving: a step is taken at the first of 1, 1/2, 1/4, ... of its length that lowers the mean loss.  A round is two
    aggregations over all rows, one of the gradient and curvature and one of the losses of all lengths, for all sites at
    once, and is stored.  Only sites with `least` rows of both classes are fitted.
    """
    n = df.groupBy(site).agg(F.count(F.when(F.col(label) == 1, 1)).alias("pos"), F.count(F.when(F.col(label) == 0, 1)).alias("neg"))
    good = n.filter((F.col("pos") >= least) & (F.col("neg") >= least))
    target = F.when(F.col(label) == 1, (F.col("pos") + 1) / (F.col("pos") + 2)).otherwise(1 / (F.col("neg") + 2))
    rows = df.filter(F.col(label).isin(0, 1)).join(small_or_shuffled(good), site).select(site, F.col(score).cast("double").alias("s"), target.alias("t"))
    rows = stored(rows.groupBy(site, "s", "t").agg(F.count(F.lit(1)).cast("double").alias("n")))
    state = stored(good.select(site, F.lit(0.0).alias("a"), F.lit(0.0).alias("b"), F.lit(False).alias("done"), F.lit(False).alias("converged")))

    def loss(a: Column, b: Column) -> Column:
        f = a * F.col("s") + b
        return F.sum(F.col("n") * (F.greatest(f, F.lit(0.0)) + F.log1p(F.exp(-F.abs(f))) - F.col("t") * f))

    for _ in range(rounds):
        open_ = state.filter(~F.col("done"))
        if open_.isEmpty():
            break
        at = rows.join(small_or_shuffled(open_.select(site, "a", "b")), site).withColumn("p", 1 / (1 + F.exp(-(F.col("a") * F.col("s") + F.col("b")))))
        w, g = F.col("p") * (1 - F.col("p")) * F.col("n"), (F.col("p") - F.col("t")) * F.col("n")
        sums = at.groupBy(site, "a", "b").agg(F.sum("n").alias("n"), F.sum(g * F.col("s")).alias("g1"), F.sum(g).alias("g0"), F.sum(w * F.col("s") * F.col("s")).alias("h11"), F.sum(w * F.col("s")).alias("h10"), F.sum(w).alias("h00"), loss(F.col("a"), F.col("b")).alias("now"))
        part = lambda c: F.col(c) / F.col("n")
        h11, h00 = part("h11") + 1e-12, part("h00") + 1e-12
        det = h11 * h00 - part("h10") * part("h10")
        step = stored(sums.select(site, "a", "b", "now", F.greatest(F.abs(part("g1")), F.abs(part("g0"))).alias("flat"), ((h00 * part("g1") - part("h10") * part("g0")) / det).alias("da"), ((h11 * part("g0") - part("h10") * part("g1")) / det).alias("db")))
        tried = rows.join(small_or_shuffled(step), site).groupBy(site).agg(*[loss(F.col("a") - F.col("da") * 2.0**-i, F.col("b") - F.col("db") * 2.0**-i).alias(f"l{i}") for i in range(halvings)])
        length = F.coalesce(*[F.when(F.col(f"l{i}") < F.col("now"), F.lit(2.0**-i)) for i in range(halvings)])
        moved = step.join(tried, site).withColumn("len", F.when(F.col("flat") >= 1e-8, length))
        small = F.greatest(F.abs(F.col("len") * F.col("da")), F.abs(F.col("len") * F.col("db"))) < 1e-9
        moved = moved.select(site, (F.col("a") - F.coalesce("len", F.lit(0.0)) * F.col("da")).alias("a"), (F.col("b") - F.coalesce("len", F.lit(0.0)) * F.col("db")).alias("b"), (F.col("len").isNull() | small).alias("done"), F.when(F.col("len").isNull(), F.col("flat") < 1e-6).otherwise(small).alias("converged"))
        state = stored(state.filter("done").unionByName(moved))
    fitted = state.join(n.select(site, (F.col("pos") + F.col("neg")).alias("rows")), site)
    return fitted.select(site, F.round("a", 6).alias("a"), F.round("b", 6).alias("b"), "rows", "converged"), n.join(good.select(site), site, "left_anti")


def fused(df: DataFrame, arms: Mapping[str, tuple[float, float]], bias: float) -> Column:
    """Log-odds from several arms: weight times value, or the arm's missing weight where it is null."""
    return sum((F.when(F.col(c).isNotNull(), F.col(c) * w).otherwise(F.lit(m)) for c, (w, m) in arms.items()), F.lit(bias))


def reusable(asked: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Asked rows with the newest stored result under the same result key that no person rejected and no newer version replaced; null where there is none."""
    good = results.filter("not rejected and not replaced").groupBy(key).agg(F.max(F.struct("made", "result"))["result"].alias("result"))
    return asked.join(good, key, "left")


def to_do(units: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Work left: units without a result under the key that is neither rejected nor replaced."""
    return units.join(done.filter("not rejected and not replaced").select(*key), list(key), "left_anti")
