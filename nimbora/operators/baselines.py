"""Plain forecasts of the bust probability, against which a model is measured."""

from __future__ import annotations

import math
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.functions.normal import erf
from nimbora.operators.neighbours import nearest_of_all, nearest_rows
from nimbora.operators.ordered import written
from nimbora.operators.quantiles import quantiles


def climatology(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds p: the training rate of y."""
    return rows.crossJoin(F.broadcast(train.agg(F.avg("y").alias("p"))))


def cell_frequency(train: DataFrame, rows: DataFrame, cell: list[str], wide: list[str], least: int = 30) -> DataFrame:
    """Adds p: the rate of the row's cell if it has enough training rows, else of its wider cell, else of all."""
    fine = train.groupBy(*cell).agg(F.avg("y").alias("_p0"), F.count(F.lit(1)).alias("_n0")).where(F.col("_n0") >= least).drop("_n0")
    coarse = train.groupBy(*wide).agg(F.avg("y").alias("_p1"))
    base = train.agg(F.avg("y").alias("_p2"))
    made = rows.join(fine, cell, "left").join(F.broadcast(coarse), wide, "left").crossJoin(F.broadcast(base))
    return made.withColumn("p", F.coalesce("_p0", "_p1", "_p2")).drop("_p0", "_p1", "_p2")


def emos_fit(rows: DataFrame, least: int = 50) -> DataFrame:
    """Least squares of the scaled error on the spread for each variable: variable, a, b, n."""
    scaled = F.col("actual_err") * math.sqrt(math.pi / 2)
    fit = rows.where("spread IS NOT NULL AND actual_err IS NOT NULL").withColumn("e", scaled).groupBy("variable").agg(F.regr_slope("e", "spread").alias("slope"), F.regr_intercept("e", "spread").alias("cut"), F.avg("actual_err").alias("mean"), F.count(F.lit(1)).alias("n"))
    floor = F.greatest(F.col("mean") * math.sqrt(math.pi / 2) * 1e-3, F.lit(1e-6))
    return fit.where(F.col("n") >= least).select("variable", F.greatest("cut", floor).alias("a"), F.greatest("slope", F.lit(0.0)).alias("b"), "n")


def emos_probability(rows: DataFrame, fit: DataFrame, cuts: DataFrame, keys: list[str], gamma: float = 1.0) -> DataFrame:
    """The probability that any variable's error passes its threshold: keys, p."""
    median = quantiles(rows, F.col("spread"), {"_mid": 0.5}, ["variable"])
    met = rows.join(F.broadcast(fit), "variable").join(F.broadcast(cuts), "variable").join(F.broadcast(median), "variable")
    sigma = F.greatest(F.col("a") + F.col("b") * F.coalesce("spread", "_mid"), F.lit(1e-6))
    inside = F.greatest(erf(F.col("bust_threshold") / (sigma * math.sqrt(2))), F.lit(1e-300))
    return met.groupBy(*keys).agg((1 - F.exp(gamma * F.sum(F.ln(inside)))).alias("p"))


#: Exponents that the joint probability of no bust is tried with, as variables do not miss independently.
EXPONENTS = [0.05 + 0.95 * k / 39 for k in range(40)]


def emos_exponent(probabilities: DataFrame) -> DataFrame:
    """The one row (gamma, brier): the exponent of 1 - p whose forecasts have the least Brier score, the smaller on ties.

    ``probabilities`` has p, with exponent 1, and the outcome y.
    """
    tried = probabilities.where("p IS NOT NULL AND y IS NOT NULL").select("y", (1 - F.col("p")).alias("none"), F.explode(F.array(*map(F.lit, EXPONENTS))).alias("gamma"))
    miss = 1 - F.pow("none", F.col("gamma")) - F.col("y")
    scored = tried.groupBy("gamma").agg(F.avg(miss * miss).alias("brier"))
    return scored.orderBy(F.round("brier", 9), "gamma").limit(1)


def standardised(vectors: DataFrame) -> DataFrame:
    """``vectors`` (v, ...) with each component less its mean over all rows, divided by its deviation (by 1 where that is 0)."""
    parts = vectors.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"))
    found = sorted(parts.collect())  # a row for each component
    mean, deviation = (F.array(*[F.lit(float(x)) for x in c]) for c in ([r["m"] for r in found], [r["s"] or 1.0 for r in found]))
    scaled = F.zip_with(F.zip_with("v", mean, lambda x, m: x - m), deviation, lambda x, s: x / s)
    return vectors.withColumn("v", scaled)


def _whole(vectors: DataFrame) -> DataFrame:
    return written(standardised(vectors).select(F.col("id").cast("long").alias("id"), "v", F.col("label").cast("long").alias("label")))


def analog_votes(vectors: DataFrame, queries: Column, k: int = 50) -> DataFrame:
    """Share of each label among the ``k`` nearest other rows (all, if fewer): query_id, label, share.

    ``vectors`` has id, v (doubles, all of one length) and label (whole numbers); the rows where ``queries`` holds are
    asked about. Components are standardised over all rows; ties go to the smaller id. Every pair is compared: in many
    dimensions no box rules out rows.
    """
    scaled = _whole(vectors)
    n = scaled.count()
    if n < 2:
        return vectors.sparkSession.createDataFrame([], "query_id long, label long, share double")
    best = nearest_of_all(scaled, queries, k)
    return best.groupBy("query_id", "label").agg((F.count(F.lit(1)) / min(k, n - 1)).alias("share"))


def analog_probability(vectors: DataFrame, queries: Column, k: int = 50) -> tuple[DataFrame, DataFrame]:
    """The mean label (0 or 1) of the ``k`` nearest other rows: query_id, p; and how many pairs were opened, of how many."""
    best, opened = nearest_rows(_whole(vectors), queries, k)
    return best.groupBy("query_id").agg(F.avg("label").alias("p")), opened


def best_rung(scores: DataFrame, least: float = 0.01) -> DataFrame:
    """The rung (name, skill) of the highest skill, by name on ties, and whether that skill is negligible."""
    top = scores.where("skill IS NOT NULL").orderBy(F.desc("skill"), "name").limit(1)
    return top.select("name", "skill", (F.col("skill") < least).alias("negligible"))


def skill_by(rows: DataFrame, by: list[str], least: int = 20) -> DataFrame:
    """Brier skill for each group with enough rows and both outcomes."""
    made = rows.groupBy(*by).agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"), F.avg("y").alias("rate"), F.count(F.lit(1)).alias("n"))
    reference: Column = F.col("rate") * (1 - F.col("rate"))
    return made.where((F.col("n") >= least) & (reference > 0)).withColumn("skill", 1 - F.col("brier") / reference)
