"""Hand-computed cases."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from nimbora.functions import circular, moisture, normal
from nimbora.operators import bias, events, grids, models, pairing, scores, trajectories
from nimbora.streaming import tiers

NOV = [dt.date(2024, 11, d) for d in (6, 7, 8, 9)]


def runs(spark, values, n=2, spread=1.0):
    rows = [("r", "t", dt.date(2024, 11, 10), d, n, float(v), spread) for d, v in zip(NOV, values)]
    return spark.createDataFrame(rows, "region_id string, variable string, valid_date date, init_date date, n_members long, fc_mean double, spread double")


def test_jumps(spark):
    out = {r["init_date"].day: r for r in trajectories.jumpiness(runs(spark, [30, 32, 31, 35]), "dir").collect()}
    assert [out[d]["jump_abs"] for d in (9, 8, 7, 6)] == [4, 1, 2, None]
    assert out[9]["jump_std"] == pytest.approx(math.sqrt(14 / 3)) and out[8]["jump_std"] == pytest.approx(1.0) and out[7]["jump_std"] is None
    assert (out[9]["jump_flips"], out[8]["jump_flips"], out[7]["jump_flips"]) == (2, 1, None)
    flat = {r["init_date"].day: r["jump_flips"] for r in trajectories.jumpiness(runs(spark, [0, 1, 1, 0]), "dir").collect()}
    assert flat[9] == 1 and flat[8] == 0
    turned = {r["init_date"].day: r["jump_abs"] for r in trajectories.jumpiness(runs(spark, [350, 10, 5, 355]), "t").collect()}
    assert turned[7] == pytest.approx(20) and turned[9] == pytest.approx(10)


def test_lagged_pool(spark):
    rows = spark.createDataFrame([("r", "t", NOV[3], NOV[0], 2, 32.0, 1.0), ("r", "t", NOV[3], NOV[1], 2, 30.0, 1.0), ("r", "t", NOV[3], NOV[2], 2, 30.0, math.sqrt(2))], "region_id string, variable string, valid_date date, init_date date, n_members long, fc_mean double, spread double").withColumns({"east": F.lit(0.0), "north": F.lit(1.0)})
    last = trajectories.lagged_pool(rows, "angle").where(F.col("init_date") == NOV[2]).first()
    assert last["laf_size"] == 4 and last["laf_mean"] == pytest.approx(30.5) and last["laf_std"] == pytest.approx(math.sqrt(5 / 3))


def test_lagged_pool_of_angles(spark):
    """Members at 350 and 10 degrees pooled with an earlier mean of 90: a vector of (1, 2 cos 10) over 3."""
    north = math.cos(math.radians(10))
    own = math.degrees(math.sqrt(-2 * math.log(north)))
    rows = spark.createDataFrame([("r", "angle", NOV[3], NOV[0], 1, 90.0, None, 1.0, 0.0), ("r", "angle", NOV[3], NOV[1], 2, 0.0, own, 0.0, north)], "region_id string, variable string, valid_date date, init_date date, n_members long, fc_mean double, spread double, east double, north double")
    last = trajectories.lagged_pool(rows, "angle").where(F.col("init_date") == NOV[1]).first()
    std = math.degrees(math.sqrt(-2 * math.log(math.hypot(1, 2 * north) / 3)))
    assert last["laf_mean"] == pytest.approx(math.degrees(math.atan2(1, 2 * north))) and last["laf_std"] == pytest.approx(std) and last["laf_ratio"] == pytest.approx(std / own)


def test_bias_levels_and_thin_cells(spark):
    rows = [("a", "t", 1, dt.date(2024, 7, 1), 30.0, 28.0)] * 150 + [("b", "t", 1, dt.date(2024, 7, 1), 20.0, 21.5)] * 40 + [("c", "t", 1, dt.date(2024, 7, 1), 5.0, 0.0)] * 29
    df = spark.createDataFrame(rows, "region_id string, variable string, lead_time_days int, valid_date date, fc_mean double, obs_mean double")
    table = bias.fit_bias(df)
    got = {(r["region_id"], r["lead_time_days"], r["month"]): r["bias"] for r in table.collect()}
    assert got[("a", 1, 7)] == 2.0 and got[("b", -1, -1)] == -1.5 and not [k for k in got if k[0] == "c"]
    applied = bias.apply_bias(df, table).groupBy("region_id").agg(F.max("corrected").alias("c")).collect()
    assert {r["region_id"]: r["c"] for r in applied} == {"a": 28.0, "b": 21.5, "c": None}


def test_circular_and_moisture(spark):
    one = spark.range(1)
    r = one.select(circular.separation(F.lit(355.0), F.lit(5.0)).alias("a"), circular.separation(F.lit(350.0), F.lit(10.0)).alias("b"), moisture.wind_from(F.lit(0.0), F.lit(-1.0)).alias("n"), normal.erf(F.lit(1.0)).alias("e"), normal.cdf(normal.quantile(F.lit(0.975))).alias("q"), normal.quantile(F.lit(0.001)).alias("t")).first()
    assert (r["a"], r["b"]) == (10, 20) and r["n"] == pytest.approx(0) and r["e"] == pytest.approx(0.8427008, abs=2e-7) and r["q"] == pytest.approx(0.975, abs=1e-6) and r["t"] == pytest.approx(-3.0902323, abs=1e-6)


def test_thresholds_and_bands(spark):
    rows = spark.createDataFrame([("t", float(i)) for i in range(100)], "variable string, e double")
    assert events.thresholds(rows, "e", 0.9, "x").first()["x"] == pytest.approx(89.1)
    cuts = events.band_cuts(spark.createDataFrame([(0.0,)] * 5, "p double"), "p").first()
    assert (cuts["medium"], cuts["high"]) == (0.33, 0.66)


def test_scores(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.35), (1, 0.8)], "y int, p double")
    assert scores.roc_auc(rows).first()["auc"] == pytest.approx(0.75)
    tied = spark.createDataFrame([(0, 0.5), (1, 0.5)], "y int, p double")
    assert scores.roc_auc(tied).first()["auc"] == 0.5
    assert scores.roc_auc(rows.where("y = 1")).first()["auc"] is None
    fit = spark.createDataFrame([(y, float(p)) for p, y in enumerate([0, 1, 0, 1])], "y int, p double")
    assert [r["fitted"] for r in scores.pooled_adjacent(fit).orderBy("p").collect()] == [0, 0.5, 0.5, 1]
    d = scores.brier_decomposition(rows).first()
    assert d["brier"] == pytest.approx(d["mcb"] - d["dsc"] + d["unc"])


def test_spread_needs_two_members(spark):
    rows = spark.createDataFrame([("r", "t", 1.0), ("r", "dir", 359.0), ("r", "dir", 1.0)], "region_id string, variable string, forecast_value double")
    out = {r["variable"]: r for r in pairing.ensemble(rows, "dir", ["region_id", "variable"]).collect()}
    assert out["t"]["spread"] is None and min(out["dir"]["fc_mean"], 360 - out["dir"]["fc_mean"]) == pytest.approx(0, abs=1e-9) and out["dir"]["spread"] == pytest.approx(1.0, abs=0.01)


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (2, 1), (0, 4))])
    r = spark.range(1).select(grids.inside(F.lit(2.0), F.lit(0.5), ring).alias("a"), grids.inside(F.lit(2.0), F.lit(3.0), ring).alias("b"), grids.ring_area(ring).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (True, False, 10.0)


def test_platt_refuses_one_class(spark):
    rows = spark.createDataFrame([(1, 0.3), (1, 0.4)], "y int, raw_p double")
    assert [r["p"] for r in models.platt(rows, rows).collect()] == [0.3, 0.4]


def test_upsert_is_repeatable(spark, tmp_path):
    schema = "k long, day date, value double, status string, ingested_at long"
    day = dt.date(2024, 1, 1)
    path = f"file://{tmp_path}/store"
    first = spark.createDataFrame([(1, day, 1.0, "provisional", 5), (2, day, 2.0, "final", 1)], schema)
    second = spark.createDataFrame([(1, day, 9.0, None, 2), (2, day, 7.0, "provisional", 9)], schema)
    for batch in (first, second, second, first):
        tiers.upsert(batch, path, ["k", "day"], "day")
    out = {r["k"]: r["value"] for r in spark.read.parquet(path).collect()}
    assert out == {1: 9.0, 2: 2.0}
