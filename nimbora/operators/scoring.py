"""The scoring chain: regressors of the error, a classifier of the bust, calibration and bands, fitted once, saved and served.

What scores a cycle is made of forecasts alone: lead and spread give each variable's predicted error, and that against its
usual largest the confidence; predicted errors, confidences and spreads give the probability. In training the classifier sees predicted errors from other folds of runs only.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import events, models
from nimbora.operators.models import EVENT_KEYS, Fitted
from nimbora.operators.ordered import written

#: What a regressor is given.
GIVEN = ["lead", "spread"]


@dataclass
class Scorer:
    """Fitted models with the numbers that go with them; variables without enough rows have no regressor."""

    variables: list[str]
    regressors: dict[str, Fitted]
    classifier: Fitted
    calibration: tuple[float, float] | None
    p90: dict[str, float]
    thresholds: dict[str, float]
    cuts: tuple[float, float]
    columns: list[str] = field(default_factory=list)


def _given(rows: DataFrame) -> DataFrame:
    return rows.withColumn("lead", F.col("lead_time_days").cast("double"))


#: What the classifier is given of each variable.
OF_VARIABLES = ["pred_err", "conf", "spread"]


def _by_variable(numbers: dict[str, float]) -> Column:
    """The row's variable's number; null without one above 0."""
    found = F.lit(None).cast("double")
    for v, x in numbers.items():
        found = F.when((F.col("variable") == v) & F.lit(x > 0), F.lit(x)).otherwise(found)
    return found


def _rated(rows: DataFrame, p90: dict[str, float]) -> DataFrame:
    """Adds conf: the confidence of pred_err; null where there is no error predicted, or no usual one."""
    error, usual = F.col("pred_err"), _by_variable(p90)
    return rows.withColumn("conf", F.when(error.isNotNull() & usual.isNotNull(), events.confidence(error, usual)))


def _frame(rows: DataFrame, variables: list[str], *more: Column) -> DataFrame:
    """One row an event: lead, predicted error, confidence and spread of each variable, and ``more`` aggregates."""
    return events.pivot(rows, variables, OF_VARIABLES, *more).withColumn("lead", F.col("lead_time_days").cast("double"))


def _columns(variables: list[str]) -> list[str]:
    return ["lead", *[f"{c}_{v}" for v in variables for c in OF_VARIABLES]]


def _numbers(rows: DataFrame, name: str) -> dict[str, float]:
    return {r["variable"]: r[name] for r in rows.collect()}  # a row a variable


def fit_scorer(rows: DataFrame, labels: DataFrame, variables: list[str], trees: int = 10, k: int = 3, embargo: int = 10) -> Scorer:
    """Fits the chain on event ``rows`` (keys, variable, spread, actual_err) and ``labels`` (keys, y).

    A third of the runs calibrates the probability; the bands' cuts are those of the calibrated scores.
    """
    given = written(models.with_folds(_given(rows).select(*EVENT_KEYS, "variable", *GIVEN, "actual_err"), k, embargo).sortWithinPartitions("variable"))
    fits = models.fitted_apart(given, "variable", variables, GIVEN, "actual_err", k, trees, whole=True)
    regressors = {v: fits[v, models.WHOLE] for v in variables if (v, models.WHOLE) in fits}
    kept = [*EVENT_KEYS, "variable", "spread"]
    apart = models.predicted_apart(given, fits, "variable", variables, k).select(*kept, F.col("predicted").alias("pred_err"))
    others = given.where(~F.coalesce(F.col("variable").isin(variables), F.lit(False))).select(*kept, F.lit(None).cast("double").alias("pred_err"))
    usual = _numbers(events.thresholds(given, "actual_err", 0.9, "p90"), "p90")
    frame = written(_frame(_rated(apart.unionByName(others), usual), variables).join(labels.select(*EVENT_KEYS, "y"), EVENT_KEYS))
    columns = _columns(variables)
    held = models.fold_of(F.col("init_date"), 3) == 2
    classifier = models.fitted_classifier(frame.where(~held), columns, trees)
    raw = written(models.raw_probability(classifier, frame).select("init_date", "y", "raw_p"))
    calibration = models.platt_fit(raw.where(held))
    cuts = events.band_cuts(models.platt_applied(raw, calibration), "p").first()
    return Scorer(
        variables, regressors, classifier, calibration,
        usual, dict(usual), (cuts["medium"], cuts["high"]), columns,
    )


def save_scorer(scorer: Scorer, spark: SparkSession, path: str) -> None:
    """Saves all models and numbers below ``path``; the numbers come last, so a broken save is no scorer."""
    for v, fitted in scorer.regressors.items():
        fitted.model.write().save(f"{path}/regressor-{scorer.variables.index(v)}")
    scorer.classifier.model.write().save(f"{path}/classifier")
    numbers = {
        "variables": scorer.variables, "columns": scorer.columns, "calibration": scorer.calibration, "p90": scorer.p90, "thresholds": scorer.thresholds, "cuts": scorer.cuts,
        "medians": {v: f.medians for v, f in scorer.regressors.items()}, "classifier": scorer.classifier.medians,
    }
    spark.createDataFrame([(json.dumps(numbers),)], "value string").coalesce(1).write.text(f"{path}/numbers")


def load_scorer(spark: SparkSession, path: str) -> Scorer:
    """What ``save_scorer`` put at ``path``."""
    n = json.loads(spark.read.text(f"{path}/numbers").first()[0])
    regressors = {v: Fitted(GBTRegressionModel.load(f"{path}/regressor-{n['variables'].index(v)}"), m) for v, m in n["medians"].items()}
    classifier = Fitted(GBTClassificationModel.load(f"{path}/classifier"), n["classifier"])
    calibration = None if n["calibration"] is None else tuple(n["calibration"])
    return Scorer(n["variables"], regressors, classifier, calibration, n["p90"], n["thresholds"], tuple(n["cuts"]), n["columns"])


def predicted(scorer: Scorer, rows: DataFrame) -> DataFrame:
    """``rows`` (keys, variable, spread) with pred_err, conf and ratio (pred_err against the threshold); null without a regressor."""
    given = _given(rows)
    out = None
    for v in scorer.variables:
        mine = given.where(F.col("variable") == v)
        if v in scorer.regressors:
            part = scorer.regressors[v].transform(mine).select(*EVENT_KEYS, "variable", "spread", F.greatest(F.col("prediction"), F.lit(0.0)).alias("pred_err"))
        else:
            part = mine.select(*EVENT_KEYS, "variable", "spread", F.lit(None).cast("double").alias("pred_err"))
        out = part if out is None else out.unionByName(part)
    return _rated(out, scorer.p90).withColumn("ratio", F.try_divide(F.col("pred_err"), _by_variable(scorer.thresholds)))


def score(scorer: Scorer, rows: DataFrame) -> DataFrame:
    """Scores the events of ``rows`` (keys, variable, spread): keys, p, band, dominant_variable, confidence.

    The last two are null if no error is predicted; confidence is the mean of the variables that have one.
    """
    # numbers alone are aggregated, all in one pass; the largest ratio is told from them, by name on ties
    least = [F.min(F.when(F.col("variable") == v, -F.col("ratio"))).alias(f"_least{i}") for i, v in enumerate(scorer.variables)]
    frame = _frame(predicted(scorer, rows), scorer.variables, *least)
    top = F.array_min(F.array(*[F.when(F.col(f"_least{i}").isNotNull(), F.struct(F.col(f"_least{i}").alias("r"), F.lit(v).alias("v"))) for i, v in enumerate(scorer.variables)]))
    p = models.platt_applied(models.raw_probability(scorer.classifier, frame), scorer.calibration)
    banded = p.withColumn("band", events.band(F.col("p"), F.lit(scorer.cuts[0]), F.lit(scorer.cuts[1])))
    mean, _ = events.across([F.col(f"conf_{v}") for v in scorer.variables])
    return banded.select(*EVENT_KEYS, "p", "band", top["v"].alias("dominant_variable"), mean.alias("confidence"))
