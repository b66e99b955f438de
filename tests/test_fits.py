"""What learners are given is computed once, however often they go over it."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nimbora.operators import models, scoring
from nimbora.plans import model_queries

KEYS = "region_id int, init_date date, valid_date date, lead_time_days int"


def counting(spark, column):
    """``column`` through a function that counts its calls."""
    seen = spark.sparkContext.accumulator(0)

    def same(x):
        seen.add(1)
        return x

    return F.udf(same, "int")(column), seen


def events(n):
    rng = random.Random(2)
    start = dt.date(2024, 1, 1)
    return [(k, start + dt.timedelta(days=k % 40), start + dt.timedelta(days=k % 40 + 1), 1 + k % 3, v, rng.random(), rng.random()) for k in range(n) for v in ("t", "r")]


def test_a_scorer_computes_its_labels_once(spark):
    rows = spark.createDataFrame(events(200), KEYS + ", variable string, spread double, actual_err double").cache()
    marked, seen = counting(spark, (F.col("region_id") % 3 == 0).cast("int"))
    labels = rows.select(*models.EVENT_KEYS).distinct().withColumn("y", marked)
    scoring.fit_scorer(rows, labels, ["t", "r"], trees=2, k=2, embargo=1)
    assert seen.value == 200


@pytest.mark.parametrize("fit", ["classifier", "regressor"])
def test_a_learner_computes_its_rows_once(spark, fit):
    marked, seen = counting(spark, (F.col("x") * 10 > 4).cast("int"))
    train = spark.createDataFrame([(float(x % 17) / 17, float(x)) for x in range(120)], "x double, z double").withColumn("y", marked)
    models.fitted_classifier(train, ["x", "z"], trees=2) if fit == "classifier" else models.fitted_regressor(train, ["x", "z"], "y", trees=2)
    assert seen.value == 120


def test_the_platt_query_fits_one_classifier(spark, monkeypatch):
    fits, plain = [], models._fitted
    monkeypatch.setattr(models, "_fitted", lambda *given: fits.append(1) or plain(*given))
    made = model_queries.R.queries["gbt_classifier_platt"](spark, "/root/testdata/sf0.001")
    assert made.count() > 0 and len(fits) == 1


def test_frames_are_read_from_what_was_written(spark):
    files = model_queries.framed(spark, "/root/testdata/sf0.001").inputFiles()
    assert files and all("/nimbora-" in f for f in files)


def test_results_of_side_by_side_keep_their_order(spark):
    assert models.side_by_side(spark, lambda n: spark.range(n).count(), [7, 3, 0, 5, 2, 9]) == [7, 3, 0, 5, 2, 9]
