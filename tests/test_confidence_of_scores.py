"""The confidence of a predicted error reaches the classifier and the scores."""

import dataclasses
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from nimbora.operators import models, scoring
from nimbora.plans.model_queries import R

KIND = "region_id int, init_date date, valid_date date, lead_time_days int, variable string, spread double, actual_err double"


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=k) for k in range(40)]
    made = [(k, days[k % 40], days[k % 40], 1, v, x, x * (0.5 + rng.random())) for k in range(200) for v in ("t", "r") for x in [rng.random()]]
    return spark.createDataFrame([*made, (900, days[0], days[0], 1, "rare", 1.0, 1.0), (0, days[0], days[0], 1, "rare", 1.0, 1.0)], KIND).cache()


@pytest.fixture(scope="module")
def scorer(rows):
    labels = rows.groupBy(*models.EVENT_KEYS).agg((F.max("actual_err") > 0.6).cast("int").alias("y"))
    return scoring.fit_scorer(rows, labels, ["t", "r", "rare"], trees=3, k=2, embargo=1)


def by_event(scored):
    return {r["region_id"]: r["confidence"] for r in scored.collect()}


def test_scores_tell_the_mean_confidence(rows, scorer):
    known = {}
    for r in scoring.predicted(scorer, rows.drop("actual_err")).where("variable <> 'rare'").collect():
        known.setdefault(r["region_id"], []).append(min(1.0, max(0.0, 1 - r["pred_err"] / scorer.p90[r["variable"]])))
    found = by_event(scoring.score(scorer, rows.drop("actual_err")))
    assert found.keys() == {*known, 900} and found[900] is None  # nothing is predicted of rare, nor counted where others are
    assert all(abs(found[g] - sum(x) / 2) < 1e-9 and len(x) == 2 for g, x in known.items())


def test_other_usual_errors_give_other_scores(rows, scorer):
    wider = dataclasses.replace(scorer, p90={v: 4 * x for v, x in scorer.p90.items()})
    first, second = (by_event(scoring.score(s, rows.drop("actual_err"))) for s in (scorer, wider))
    assert all(second[g] > x for g, x in first.items() if x is not None)


def test_the_classifier_is_given_confidences(rows, scorer):
    assert {f"conf_{v}" for v in ("t", "r", "rare")} <= set(scorer.columns) == set(scorer.classifier.medians)
    assert scorer.classifier.medians["conf_rare"] == 0.0 < scorer.classifier.medians["conf_t"] < 1.0


def test_the_query_tells_it(spark):
    found = R.queries["score_cycle"](spark, "/root/testdata/sf0.001").collect()
    assert found and all(0 <= r["mean_confidence"] <= 1 for r in found)
    assert len({r["mean_confidence"] for r in found}) > 1
