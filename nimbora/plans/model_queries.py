"""Queries on models; their numbers depend on the learner, so they have no reference SQL."""

from __future__ import annotations

import functools
import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import baselines, events, models, scores, scoring, shapley
from nimbora.operators.ordered import shared_folder, written
from nimbora.plans.forecast_queries import cuts, event_rows
from nimbora.plans.registry import Registry
from nimbora.plans.score_queries import S, scored
from nimbora.plans.views import EVENT, VARIABLES, with_sql

R = Registry()
COLUMNS = ["lead_time_days", *[f"spread_{v}" for v in VARIABLES]]


def labelled_tables(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Event rows by variable, written in order of the variable, and the events' labels (y); the pairs are not kept."""
    rows = written(event_rows(s, d).select(*EVENT, "variable", "spread", "actual_err").sortWithinPartitions("variable"))
    return rows, events.label(rows, cuts(rows)).select(*EVENT, F.col("y_bust").alias("y"))


def framed(s: SparkSession, d: str) -> DataFrame:
    """Events with label, spreads by variable and lead, written: learners read their rows many times."""
    rows, labels = labelled_tables(s, d)
    made = labels.join(events.pivot(rows, VARIABLES, ["spread"]), EVENT)
    return written(made.withColumns({c: F.col(c).cast("double") for c in COLUMNS}))


def _halves(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = framed(s, d)
    return rows.where("dayofmonth(init_date) <= 15"), rows.where("dayofmonth(init_date) > 15")


def _regressor(s: SparkSession, d: str) -> DataFrame:
    """Out-of-fold error of each variable's own regressor."""
    rows = event_rows(s, d).select(*EVENT, "variable", F.col("lead_time_days").cast("double").alias("lead"), "spread", "actual_err")
    made = models.out_of_fold_by(rows, "variable", VARIABLES, ["lead", "spread"], "actual_err", trees=5)
    e = F.col("actual_err") - F.col("predicted")
    found = made.groupBy("variable").agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), F.count(F.lit(1)).alias("n"))
    return s.createDataFrame([(v,) for v in VARIABLES], "variable string").join(found, "variable", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def _classifier(s: SparkSession, d: str) -> DataFrame:
    train, rows = _halves(s, d)
    held = train.where("dayofmonth(init_date) > 10")
    fit = train.where("dayofmonth(init_date) <= 10")
    model = models.fitted_classifier(fit, COLUMNS)
    return models.platt(models.raw_probability(model, held), models.raw_probability(model, rows)).select(*EVENT, "y", "raw_p", "p")


R.add("gbt_regressor_oof", _regressor)
R.add("gbt_classifier_platt", _classifier)
R.add("feature_importance", lambda s, d: models.importances(framed(s, d).withColumn("y", F.col("y").cast("double")), COLUMNS, "y"))
R.add("baseline_logistic", lambda s, d: models.logistic(*_halves(s, d), ["lead_time_days"]).select(*EVENT, "y", "p"))
R.add("baseline_idr", lambda s, d: models.isotonic(*_halves(s, d), "spread_view").select(*EVENT, "y", "p"))
def _scored_chain(s: SparkSession, d: str) -> DataFrame:
    """Bands and mean confidence of every run, by a chain fitted on the runs of first half-months, saved and loaded again."""
    path = f"{shared_folder(s)}/nimbora-{uuid.uuid4().hex}"
    rows, labels = labelled_tables(s, d)
    early = "dayofmonth(init_date) <= 15"
    scoring.save_scorer(scoring.fit_scorer(rows.where(early), labels.where(early), VARIABLES, trees=3, k=2, embargo=2), s, path)
    found = scoring.score(scoring.load_scorer(s, path), rows.where(f"NOT {early}").drop("actual_err"))
    return found.groupBy("init_date", "band").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_p"), F.count("dominant_variable").alias("n_dominant"), F.avg("confidence").alias("mean_confidence"))


R.add("score_cycle", _scored_chain)


def _folds(s: SparkSession, d: str) -> DataFrame:
    """Rows of each fold of runs, and rows that may train its regressors."""
    rows = scored(s, d).select("init_date").withColumn("_fold", models.fold_of(F.col("init_date"), 3, 9))
    parts = [models.apart_from_fold(rows, k, 2).agg(F.lit(k).alias("fold"), F.count(F.lit(1)).alias("n_train")) for k in range(3)]
    held = rows.groupBy(F.col("_fold").alias("fold")).agg(F.count(F.lit(1)).alias("n"))
    return held.join(functools.reduce(DataFrame.unionByName, parts), "fold")


R.add(
    "embargoed_folds",
    _folds,
    with_sql(*S, "f AS (SELECT init_date, CAST((floor(datediff('day', DATE '2000-01-01', init_date) / 9) % 3 + 3) % 3 AS INTEGER) AS fold FROM scored)", "days AS (SELECT DISTINCT fold, init_date FROM f)", "t AS (SELECT h.fold, count(*) AS n_train FROM f JOIN (SELECT DISTINCT fold FROM f) h ON f.fold <> h.fold WHERE NOT EXISTS (SELECT 1 FROM days WHERE days.fold = h.fold AND abs(datediff('day', days.init_date, f.init_date)) <= 2) GROUP BY 1)")
    + "SELECT fold, n, n_train FROM (SELECT fold, count(*) AS n FROM f GROUP BY 1) JOIN t USING (fold)",
)


def _spread_frame(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Training and test events with lead, mean and largest spread and a column for each season."""
    each, labels = labelled_tables(s, d)
    rows = each.groupBy(*EVENT).agg(F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"))
    season = events.season_of(F.col("valid_date"))
    made = labels.join(rows, EVENT).withColumns({"lead": F.col("lead_time_days").cast("double"), **{f"is_{x}": (season == x).cast("double") for x in ("DJF", "MAM", "JJAS", "ON")}})
    made = written(made)
    return made.where("dayofmonth(init_date) <= 15"), made.where("dayofmonth(init_date) > 15")


RUNGS = {"lead": ["lead"], "spread": ["spread_mean", "spread_max"], "lead, spread and season": ["lead", "spread_mean", "spread_max", "is_DJF", "is_MAM", "is_JJAS", "is_ON"]}


def _ladder(s: SparkSession, d: str) -> DataFrame:
    """Brier score and skill of each logistic rung on the same test events, and which is best."""
    train, rows = _spread_frame(s, d)
    parts = [scores.brier(models.logistic(train, rows, columns)).select(F.lit(name).alias("name"), "brier", "skill", "n") for name, columns in RUNGS.items()]
    made = written(functools.reduce(DataFrame.unionByName, parts))
    return made.join(baselines.best_rung(made).select("name", F.lit(True).alias("best"), "negligible"), "name", "left")


R.add("baseline_ladder", _ladder)
def _attributions(s: SparkSession, d: str) -> DataFrame:
    """Mean absolute Shapley values of the classifier's columns, over all test events and by lead."""
    train, rows = _halves(s, d)
    model = models.fitted_classifier(train, COLUMNS)
    return shapley.mean_attributions(shapley.attributed(model, rows, COLUMNS, ["lead_time_days"]), COLUMNS, ["lead_time_days"])


R.add("feature_attributions", _attributions)


def _additivity(s: SparkSession, d: str) -> DataFrame:
    """For each test event the raw score by the model and by base and Shapley values, which agree."""
    train, rows = _halves(s, d)
    model = models.fitted_classifier(train, COLUMNS)
    by_model = model.transform(rows).select(*EVENT, vector_to_array("rawPrediction")[1].alias("by_model"))
    return shapley.attributed(model, rows, COLUMNS, EVENT).select(*EVENT, "base", F.col("raw_score").alias("by_parts")).join(by_model, EVENT)


R.add("shapley_additivity", _additivity)
