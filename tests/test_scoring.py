"""The scoring chain: saved and loaded models give the same scores, of forecasts alone; ladders and rungs."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nimbora.operators import baselines, scoring

KEYS = ["region_id", "init_date", "valid_date", "lead_time_days"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    out = []
    for region in range(6):
        for day in range(60):
            date = dt.date(2024, 1, 1) + dt.timedelta(days=day)
            for v in ("t", "r"):
                spread = rng.random() * (2 if region % 2 else 1)
                out.append((region, date, date, 1, v, spread if rng.random() > 0.05 else None, spread * (1 + rng.random())))
    out += [(9, dt.date(2024, 1, 1), dt.date(2024, 1, 1), 1, "rare", 1.0, 1.0)]
    return spark.createDataFrame(out, "region_id int, init_date date, valid_date date, lead_time_days int, variable string, spread double, actual_err double").cache()


@pytest.fixture(scope="module")
def scorer(rows):
    labels = rows.groupBy(*KEYS).agg((F.max("actual_err") > 1.8).cast("int").alias("y"))
    return scoring.fit_scorer(rows, labels, ["t", "r", "rare"], trees=3, embargo=1), labels


def test_saved_models_score_the_same(spark, rows, scorer, tmp_path):
    made, labels = scorer
    scoring.save_scorer(made, spark, f"file://{tmp_path}/model")
    forecasts_alone = rows.drop("actual_err")
    first = sorted(map(tuple, scoring.score(made, forecasts_alone).collect()))
    again = sorted(map(tuple, scoring.score(scoring.load_scorer(spark, f"file://{tmp_path}/model"), forecasts_alone).collect()))
    assert first == again and len(first) == 361
    met = scoring.score(made, forecasts_alone).join(labels, KEYS)
    means = {r["y"]: r["p"] for r in met.groupBy("y").agg(F.avg("p").alias("p")).collect()}
    assert means[1] > means[0] and {x[5] for x in first} <= {"low", "medium", "high"}


def test_a_variable_without_a_regressor_has_no_error(rows, scorer):
    made, _ = scorer
    assert set(made.regressors) == {"t", "r"}
    out = scoring.predicted(made, rows).collect()
    assert all((r["pred_err"] is None) == (r["variable"] == "rare") for r in out)
    top = {r["region_id"]: r["dominant_variable"] for r in scoring.score(made, rows).collect()}
    assert top[9] is None and set(top.values()) <= {"t", "r", None}


def test_best_rung(spark):
    scores = spark.createDataFrame([("b", 0.2), ("a", 0.2), ("c", None), ("d", -1.0)], "name string, skill double")
    assert tuple(baselines.best_rung(scores).first()) == ("a", 0.2, False)
    assert tuple(baselines.best_rung(scores.where("name = 'd'")).first()) == ("d", -1.0, True)
    assert baselines.best_rung(scores.where("name = 'c'")).count() == 0
