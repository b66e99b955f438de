"""The learners of all variables and folds share what they need: medians made at once, rows read once, few ranges looked at."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from nimbora.operators import models, ordered, quantiles, scoring
from nimbora.plans import model_queries
from nimbora.plans.score_queries import scored
from nimbora.plans.views import EVENT

KIND = "region_id int, init_date date, valid_date date, lead_time_days int, variable string, spread double, actual_err double"
START = dt.date(2024, 1, 1)


def events(n, variables=("t", "r")):
    rng = random.Random(2)
    return [(k, START + dt.timedelta(days=k % 40), START + dt.timedelta(days=k % 40 + 1), 1 + k % 3, v, rng.random() if rng.random() > 0.2 else None, rng.random()) for k in range(n) for v in variables]


def test_medians_of_all_fits_are_made_at_once(spark, monkeypatch):
    made, plain = [], models.quantiles
    monkeypatch.setattr(models, "quantiles", lambda *given: made.append(1) or plain(*given))
    rows = spark.createDataFrame(events(200), KIND)
    labels = rows.select(*models.EVENT_KEYS).distinct().withColumn("y", (F.col("region_id") % 3 == 0).cast("int"))
    scorer = scoring.fit_scorer(rows, labels, ["t", "r"], trees=2, k=2, embargo=1)
    assert len(made) == 2  # the regressors' and the classifier's
    for v in ("t", "r"):
        assert abs(scorer.regressors[v].medians["spread"] - statistics.median(x[5] for x in events(200) if x[4] == v and x[5] is not None)) < 1e-12


def test_events_are_scored_in_one_pass(spark, tmp_path):
    rows = spark.createDataFrame(events(200), KIND)
    rows.write.parquet(f"{tmp_path}/rows")
    labels = rows.select(*models.EVENT_KEYS).distinct().withColumn("y", (F.col("region_id") % 3 == 0).cast("int"))
    scorer = scoring.fit_scorer(rows, labels, ["t", "r"], trees=2, k=2, embargo=1)
    again = spark.read.parquet(f"{tmp_path}/rows").drop("actual_err")
    out = scoring.score(scorer, again)
    assert out._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 2  # a read for each variable
    ratio = {}
    for r in scoring.predicted(scorer, again).collect():
        ratio.setdefault(r["region_id"], []).append((-r["ratio"], r["variable"]))
    assert {r["region_id"]: r["dominant_variable"] for r in out.collect()} == {g: min(x)[1] for g, x in ratio.items()}


def test_rows_apart_from_each_fold(spark):
    rows = spark.createDataFrame([(k, START + dt.timedelta(days=k)) for k in range(40) if k % 7] + [(99, None)], "id int, init_date date")
    for k, embargo in ((2, 2), (3, 0), (3, 4)):
        folded = models.with_folds(rows, k, embargo)
        assert folded.count() == rows.count()
        for f in range(k):
            apart = {r["id"] for r in models.apart_from_fold(folded.drop("_near"), f, embargo).collect()}
            assert {r["id"] for r in folded.where(~F.array_contains("_near", f)).collect()} == apart


def test_a_group_with_few_rows_or_none_is_predicted_null(spark):
    rows = spark.createDataFrame(events(200) + events(20, ("few",)), KIND)
    out = models.out_of_fold_by(rows, "variable", ["t", "few", "none"], ["spread"], "actual_err", k=2, trees=2).collect()
    assert {(r["variable"], r["predicted"] is None) for r in out} == {("t", False), ("few", True)} and len(out) == 220


def test_quantiles_look_at_the_ranges_that_hold_them(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counted = spark.range(8_000).select(F.xxhash64("id").cast("double").alias("_v"), F.lit(1).cast("long").alias("_c"))
        dealt = ordered.by_ranges(counted, [F.col("_v")])
        assert dealt.select("_range").distinct().count() == 4
        met = quantiles._holding(dealt, [F.floor((F.col("_n") - 1) * 0.9)], [])
        assert met.select("_range").distinct().count() == 1 and met.count() < 4_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_labels_without_pairs_are_those_of_the_scored_events(spark):
    _, labels = model_queries.labelled_tables(spark, "/root/testdata/sf0.001")
    whole = scored(spark, "/root/testdata/sf0.001").select(*EVENT, "y")
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, whole.collect())) and labels.count() > 0
