"""Models of forecast error and bust probability, with Spark ML."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool
from typing import Any, TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.ordered import written
from nimbora.operators.quantiles import quantiles

CLIP = 1e-6

EVENT_KEYS = ["region_id", "init_date", "valid_date", "lead_time_days"]

#: Rows that a regressor needs.
LEAST_ROWS = 30

#: Rows that a task of a fit goes over, about: a fit has many short jobs, and with fewer rows tasks cost more than the work.
ROWS_A_TASK = 50_000

#: What stands for all rows among the folds of ``fitted_apart``.
WHOLE = -1

#: Models that are fitted at a time: their jobs are many and short.
AT_ONCE = 5

X, Y = TypeVar("X"), TypeVar("Y")


def side_by_side(spark: SparkSession, made: Callable[[X], Y], given: Iterable[X]) -> list[Y]:
    """``made`` of each of ``given``, in order, AT_ONCE at a time."""
    with ThreadPool(AT_ONCE) as pool:
        return pool.map(inheritable_thread_target(spark)(made), list(given), chunksize=1)


def _known(column: str) -> Column:
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def _with_features(rows: DataFrame, medians: dict[str, float]) -> DataFrame:
    known = {f"{c}__filled": F.coalesce(_known(c), F.lit(m)) for c, m in medians.items()}
    return VectorAssembler(inputCols=list(known), outputCol="features").transform(rows.withColumns(known)).drop(*known)


@dataclass
class Fitted:
    """A fitted learner with the medians that stand for missing values (0 where a column has none)."""

    model: Any
    medians: dict[str, float]

    def transform(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the learner's columns."""
        return self.model.transform(_with_features(rows, self.medians))


def _fitted(learner, train: DataFrame, columns: list[str]) -> Fitted:
    """The learner fitted on ``train``, of which only what it needs is written: medians and learners go over it many times."""
    others = [learner.getOrDefault(p) for p in ("labelCol", "validationIndicatorCol") if learner.hasParam(p) and learner.isDefined(p)]
    train = written(train.select(*dict.fromkeys([*columns, *others])))
    values = train.select([_known(c).alias(c) for c in columns]).unpivot([], columns, "column", "value")
    found = {r["column"]: r["median"] for r in quantiles(values, F.col("value"), {"median": 0.5}, ["column"]).collect()}  # a row a column
    medians = {c: float(found.get(c, 0.0)) for c in columns}
    return Fitted(learner.fit(_with_features(train, medians)), medians)


def fold_of(date: Column, k: int, block: int = 3) -> Column:
    """The fold of a run: blocks of days dealt in turn."""
    return F.pmod(F.floor(F.datediff(date, F.lit("2000-01-01").cast("date")) / block), F.lit(k)).cast("int")


def apart_from_fold(folded: DataFrame, fold: int, days: int) -> DataFrame:
    """The rows of other folds (_fold) whose init_date is more than ``days`` days from every one of the fold's."""
    near = folded.where(F.col("_fold") == fold).select(F.explode(F.sequence(F.date_sub("init_date", days), F.date_add("init_date", days))).alias("init_date")).distinct()
    return folded.where(F.col("_fold") != fold).join(near, "init_date", "left_anti")


def with_folds(rows: DataFrame, k: int, embargo: int) -> DataFrame:
    """Adds _fold, and _near: the folds with a run within ``embargo`` days of the row's, its own among them; none may learn from the row."""
    folded = rows.withColumn("_fold", fold_of(F.col("init_date"), k))
    runs = folded.where("init_date IS NOT NULL").select("init_date", "_fold").distinct()
    days = runs.select(F.explode(F.sequence(F.date_sub("init_date", embargo), F.date_add("init_date", embargo))).alias("init_date"), "_fold")
    near = days.groupBy("init_date").agg(F.collect_set("_fold").alias("_near"))  # a row a day: a small table
    return folded.join(F.broadcast(near), "init_date", "left").select(*folded.columns, "_near")


def fitted_apart(folded: DataFrame, by: str, groups: list[str], columns: list[str], target: str, k: int, trees: int, whole: bool = False) -> dict[tuple[str, int], Fitted]:
    """Boosted trees of ``target`` for each of ``groups`` (values of ``by``) and fold, from rows that are not near the fold.

    ``folded`` comes from ``with_folds`` and is written, sorted by ``by`` so that a fit passes over others' pages. With ``whole`` there is one more for each group, from all of its
    rows, under WHOLE. Where fewer than LEAST_ROWS rows are left to learn from there is none. Counts and medians of all
    are made at once.
    """
    known = folded.where(F.col(by).isin(groups) & F.col(target).isNotNull())
    sets = [F.when(~F.array_contains("_near", f), F.lit(f)) for f in range(k)] + ([F.lit(WHOLE)] if whole else [])
    dealt = known.select(F.col(by).alias("_of"), F.explode(F.array_compact(F.array(*sets))).alias("_set"), *columns)
    counts = {(r["_of"], r["_set"]): r["n"] for r in dealt.groupBy("_of", "_set").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a fit
    values = dealt.select("_of", "_set", *[_known(c).alias(c) for c in columns]).unpivot(["_of", "_set"], columns, "_column", "_value")
    found = {(r["_of"], r["_set"], r["_column"]): r["median"] for r in quantiles(values, F.col("_value"), {"median": 0.5}, ["_of", "_set", "_column"]).collect()}

    def fit(which: tuple[str, int]) -> Fitted:
        g, f = which
        mine = known.where((F.col(by) == g) & (F.lit(True) if f == WHOLE else ~F.array_contains("_near", f)))
        medians = {c: float(found.get((g, f, c), 0.0)) for c in columns}
        learner = GBTRegressor(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=3, seed=7)
        given = mine.select(*dict.fromkeys([*columns, target])).coalesce(-(-counts[which] // ROWS_A_TASK))
        return Fitted(learner.fit(_with_features(given, medians)), medians)

    which = [(g, f) for g in groups for f in [*range(k), WHOLE] if counts.get((g, f), 0) >= LEAST_ROWS]
    return dict(zip(which, side_by_side(folded.sparkSession, fit, which), strict=True))


def predicted_apart(folded: DataFrame, fits: dict[tuple[str, int], Fitted], by: str, groups: list[str], k: int) -> DataFrame:
    """Adds predicted to the rows of ``groups``: by the trees of ``fitted_apart`` that are apart from the row's fold; null without."""
    kept = [c for c in folded.columns if c not in ("_fold", "_near")]
    parts = []
    for g in groups:
        for f in range(k):
            held = folded.where((F.col(by) == g) & (F.col("_fold") == f)).select(*kept)
            p = F.greatest(F.col("prediction"), F.lit(0.0)) if (g, f) in fits else F.lit(None).cast("double")
            parts.append((fits[g, f].transform(held) if (g, f) in fits else held).select(*kept, p.alias("predicted")))
    return functools.reduce(DataFrame.unionByName, parts)


def out_of_fold_by(rows: DataFrame, by: str, groups: list[str], columns: list[str], target: str, k: int = 3, trees: int = 10, embargo: int = 0) -> DataFrame:
    """The rows of each of ``groups`` (values of ``by``) with predicted, as ``out_of_fold`` has it, by the group's own trees."""
    folded = written(with_folds(rows.where(F.col(by).isin(groups)), k, embargo).sortWithinPartitions(by))
    return predicted_apart(folded, fitted_apart(folded, by, groups, columns, target, k, trees), by, groups, k)


def out_of_fold(rows: DataFrame, columns: list[str], target: str, k: int = 3, trees: int = 10, embargo: int = 0) -> DataFrame:
    """Adds predicted: each row's target from boosted trees that never saw its fold of runs, nor runs ``embargo`` days near it.

    It is null for a fold that leaves fewer than LEAST_ROWS rows to learn from.
    """
    return out_of_fold_by(rows.withColumn("_all", F.lit("all")), "_all", ["all"], columns, target, k, trees, embargo).drop("_all")


def predicted_errors(rows: DataFrame, variables: list[str], columns: list[str], k: int = 3, trees: int = 10, embargo: int = 10) -> DataFrame:
    """pred_err of each event and variable: out-of-fold boosted trees of actual_err on ``columns``, one for each variable.

    ``rows`` has the event keys, variable, actual_err and ``columns``. A row's error comes from trees that saw neither its
    fold of runs nor runs within ``embargo`` days of it.
    """
    kept = [*EVENT_KEYS, "variable"]
    given = rows.select(*dict.fromkeys([*kept, *columns, "actual_err"]))
    return out_of_fold_by(given, "variable", variables, columns, "actual_err", k, trees, embargo).select(*kept, F.col("predicted").alias("pred_err"))


def importances(rows: DataFrame, columns: list[str], target: str, trees: int = 10) -> DataFrame:
    """Each column's share in the trees' gains."""
    model = _fitted(GBTRegressor(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=3, seed=7), rows, columns)
    shares = model.model.featureImportances.toArray()
    return rows.sparkSession.createDataFrame([(c, float(s)) for c, s in zip(columns, shares, strict=True)], "feature string, importance double")


def fitted_classifier(train: DataFrame, columns: list[str], trees: int = 10, depth: int = 3) -> Fitted:
    """Boosted trees of y on ``columns``."""
    return _fitted(GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=depth, seed=7), train, columns)


def fitted_regressor(train: DataFrame, columns: list[str], target: str, trees: int = 10, depth: int = 3) -> Fitted:
    """Boosted trees of ``target`` on ``columns``."""
    return _fitted(GBTRegressor(labelCol=target, featuresCol="features", maxIter=trees, maxDepth=depth, seed=7), train, columns)


def classified(train: DataFrame, rows: DataFrame, columns: list[str], trees: int = 10, held: DataFrame | None = None) -> DataFrame:
    """Adds raw_p: the probability of y by boosted trees; with ``held``, no more trees than help on those rows."""
    learner = GBTClassifier(labelCol="y", featuresCol="features", maxIter=trees, maxDepth=3, seed=7)
    if held is not None:
        train = train.withColumn("_held", F.lit(False)).unionByName(held.withColumn("_held", F.lit(True)))
        learner = learner.setValidationIndicatorCol("_held")
    model = _fitted(learner, train, columns)
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("raw_p"))


def _logit(p: Column) -> Column:
    bounded = F.greatest(F.lit(CLIP), F.least(F.lit(1 - CLIP), p))
    return F.ln(bounded / (1 - bounded))


def raw_probability(model: Fitted, rows: DataFrame) -> DataFrame:
    """``rows`` with raw_p: the classifier's probability of y."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("raw_p"))


def platt_fit(held: DataFrame) -> tuple[float, float] | None:
    """Slope and cut of a logistic fit of y on the logit of raw_p; None with one class, or if the fit would turn it round."""
    held = written(held.select("y", "raw_p"))
    if held.select("y").distinct().count() < 2:
        return None
    made = VectorAssembler(inputCols=["_x"], outputCol="_v").transform(held.withColumn("_x", _logit(F.col("raw_p"))))
    fit = LogisticRegression(labelCol="y", featuresCol="_v", regParam=0.0).fit(made)
    a, b = float(fit.coefficients[0]), float(fit.intercept)
    return (a, b) if a > 0 else None


def platt_applied(rows: DataFrame, fit: tuple[float, float] | None) -> DataFrame:
    """Adds p: raw_p put right by ``fit``, or as it is without one."""
    return rows.withColumn("p", F.col("raw_p") if fit is None else 1 / (1 + F.exp(-(fit[0] * _logit(F.col("raw_p")) + fit[1]))))


def platt(held: DataFrame, rows: DataFrame) -> DataFrame:
    """Adds p: raw_p put right by a logistic fit on held-out rows; left as it is if the fit would turn it round."""
    return platt_applied(rows, platt_fit(held))


def logistic(train: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Adds p: a logistic regression on columns filled with their medians."""
    model = _fitted(LogisticRegression(labelCol="y", featuresCol="features"), train, columns)
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("p"))


def isotonic(train: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Adds p: the isotonic fit of y on one column."""
    shaped = train.where(F.col(column).isNotNull()).select(F.col("y").cast("double").alias("y"), F.col(column).cast("double").alias("_x"))
    model = IsotonicRegression(labelCol="y", featuresCol="_x").fit(shaped)
    return model.transform(rows.where(F.col(column).isNotNull()).withColumn("_x", F.col(column).cast("double"))).select(*rows.columns, F.col("prediction").alias("p"))
