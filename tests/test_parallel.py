"""Labels, running sums, pooling, splits, analogs and streams against plain Python."""

import datetime as dt
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators import baselines, events, frames, ingest, models, neighbours, ordered, scores, store, trajectories
from nimbora.streaming import tiers


def test_labels_do_not_hang_on_the_order_of_a_sum(spark):
    """Two events of equal errors, whose means are summed in two orders, get the same label."""
    values = [0.1, 0.2, 0.3, 0.7, 1e-3, 5.55]
    rows = []
    for region, order in enumerate([values, values[::-1], sorted(values, key=lambda x: -abs(x - 0.3))]):
        rows += [(region, dt.date(2024, 1, 1), dt.date(2024, 1, 2), 1, "t", v, 0.05, v) for v in order]
    paired = spark.createDataFrame(rows, "region_id int, init_date date, valid_date date, lead_time_days int, variable string, forecast_value double, observed_value double, abs_error double")
    for parts in (1, 5):
        made = events.event_rows(paired.repartition(parts), "angle")
        assert made.select("actual_err").distinct().count() == 1
        out = events.label(made, events.thresholds(made, "actual_err", 0.9, "bust_threshold")).collect()
        assert [(r["bust_ratio"], r["y_bust"]) for r in out] == [(1.0, 1)] * 3


def sample(seed, n=300, places=2):
    rng = random.Random(seed)
    return [(round(rng.random(), places), int(rng.random() < 0.4)) for _ in range(n)]


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_running_sums(spark, many_ranges):
    data = [(g, i, (i * 7) % 11) for g in "ab" for i in random.Random(1).sample(range(500), 90)]
    rows = spark.createDataFrame(data, "g string, i int, x int")
    for inclusive in (True, False):
        out = {(r["g"], r["i"]): r["s"] for r in ordered.running_sums(rows, [F.col("i")], {"s": "x"}, ["g"], inclusive).collect()}
        assert out == {(g, i): sum(x for h, j, x in data if h == g and (j < i or inclusive and j == i)) for g, i, _ in data}
    whole = {(r["g"], r["i"]): r["s"] for r in ordered.running_sums(rows, [F.desc("i"), F.col("g")], {"s": "x"}).collect()}
    assert whole == {(g, i): sum(x for h, j, x in data if (-j, h) <= (-i, g)) for g, i, _ in data}


def test_area_and_value_over_ranges(spark, many_ranges):
    data = sample(2)
    rows = spark.createDataFrame(data, "p double, y int")
    pairs = [(a, b) for (a, y), (b, z) in itertools.product(data, data) if y == 1 and z == 0]
    auc = sum((a > b) + (a == b) / 2 for a, b in pairs) / len(pairs)
    assert abs(scores.roc_auc(rows).first()["auc"] - auc) < 1e-12
    ranked = sorted({p for p, _ in data}, reverse=True)
    ap = sum(sum(y for p, y in data if p == t) * sum(y for p, y in data if p >= t) / sum(p >= t for p, _ in data) for t in ranked) / sum(y for _, y in data)
    assert abs(scores.average_precision(rows).first()["average_precision"] - ap) < 1e-12
    s = np.mean([y for _, y in data])
    curve = {round(r["alpha"], 2): r["value"] for r in scores.economic_value(rows).collect()}
    for a in (0.1, 0.33, 0.8):
        best = min([s] + [a * np.mean([p >= t for p, _ in data]) + np.mean([y and p < t for p, y in data]) for t in ranked])
        assert abs(curve[a] - (min(a, s) - best) / (min(a, s) - a * s)) < 1e-9
    q = sorted(1 - p if y else p for p, y in data)[min(int(np.ceil((len(data) + 1) * 0.9)), len(data)) - 1]
    assert abs(scores.conformal_threshold(rows, 0.1).first()["q"] - q) < 1e-12


@pytest.mark.parametrize("data", [sample(3, 400, 3), [(i / 50, 0) for i in range(50)], [(i / 50, i >= 25) for i in range(50)], [(1 - i / 50, i % 3) for i in range(50)]])
def test_pooling_in_ranges(spark, many_ranges, data):
    data = [(p, int(bool(y))) for p, y in data]
    out = {r["p"]: r["fitted"] for r in scores.pooled_adjacent(spark.createDataFrame(data, "p double, y int")).collect()}
    points = sorted({p for p, _ in data})
    n = [[sum(1 for p, _ in data if p == x), sum(y for p, y in data if p == x)] for x in points]
    mean = lambda i, j: sum(b for _, b in n[i : j + 1]) / sum(a for a, _ in n[i : j + 1])
    if len(points) > 60:
        points, keep = points, range(0, len(points), 37)
    else:
        keep = range(len(points))
    for k in keep:
        want = max(min(mean(i, j) for j in range(k, len(points))) for i in range(k + 1))
        assert abs(out[points[k]] - want) < 1e-12


def test_scores_without_rows_or_with_one_class(spark):
    none = spark.createDataFrame([], "p double, y int")
    one = spark.createDataFrame([(0.2, 1), (0.9, 1)], "p double, y int")
    assert scores.roc_auc(one).first()["auc"] is None and scores.economic_value(one).count() == 0
    assert scores.pooled_adjacent(none).count() == 0 and scores.average_precision(none).first()[0] is None
    assert scores.binormal(one).first()["binormal_auc"] is None


def test_bootstrap_interval_holds_the_area(spark):
    rng = random.Random(5)
    data = [(dt.date(2024, 1, 1) + dt.timedelta(days=i // 40), round(min(1.0, max(0.0, rng.gauss(0.4 + 0.2 * y, 0.2))), 2), y) for i in range(800) for y in [int(rng.random() < 0.4)]]
    rows = spark.createDataFrame(data, "init_date date, p double, y int")
    found, area = scores.block_bootstrap(rows, draws=60).first(), scores.roc_auc(rows).first()["auc"]
    assert found["draws"] == 60 and found["low"] < area < found["high"] and found["high"] - found["low"] < 0.2
    assert scores.block_bootstrap(rows, draws=60).first() == found


def splits(spark, days, **kw):
    rows = spark.createDataFrame([(dt.date(2024, 1, 1) + dt.timedelta(days=d),) for d in days], "init_date date")
    return {(r["init_date"] - dt.date(2024, 1, 1)).days: r["split"] for r in events.split_cycles(rows, **kw).collect()}


def test_splits_keep_their_distance(spark):
    assert splits(spark, [0, 1]) == {0: "train", 1: "train"}
    far = splits(spark, range(0, 400, 20))
    assert [k for k, v in far.items() if v == "train"] and set(far.values()) == {"train", "val", "test"} and len(far) == 20
    # all of validation lies next to the test: training keeps its distance from the test instead
    close = splits(spark, [0, 50, 93, 94, 95, 96, 97, 98, 99, 100])
    assert "val" not in close.values() and {k for k, v in close.items() if v == "train"} == {0, 50} or min(k for k, v in close.items() if v == "test") - max(k for k, v in close.items() if v == "train") >= 10
    year = spark.createDataFrame([(dt.date(2022, 6, 1) + dt.timedelta(days=20 * i),) for i in range(40)], "init_date date")
    named = events.split_year(year, 2023).collect()
    assert {r["split"] for r in named if r["init_date"].year == 2023} == {"test"} and {r["split"] for r in named if r["init_date"].year == 2022} == {"train", "val"} and all(r["init_date"].year < 2024 for r in named)


def test_as_of(spark):
    day = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
    readings = spark.createDataFrame([(day(0), 1.0), (day(3), 2.0), (day(4), None)], "date date, value double")
    dates = spark.createDataFrame([(day(k),) for k in (-1, 0, 2, 3, 4, 9, 10)] + [(None,)], "date date")
    out = {r["date"]: r["value"] for r in trajectories.as_of(dates, readings, 5).collect()}
    assert out == {day(-1): None, day(0): 1.0, day(2): 1.0, day(3): 2.0, day(4): None, day(9): None, day(10): None, None: None}


def test_analogs_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 32)
    monkeypatch.setattr(neighbours, "ASKED", 3)
    monkeypatch.setattr(neighbours, "LEAF", 8)
    rng = np.random.default_rng(1)
    data = [(i, [float(x) for x in rng.normal(size=4) * [1, 100, 0.01, 0]], int(rng.integers(0, 3))) for i in range(140)]
    data += [(200 + i, data[0][1], 1) for i in range(5)]
    out = {(r["query_id"], r["label"]): r["share"] for r in baselines.analog_votes(spark.createDataFrame(data, "id long, v array<double>, label int"), F.col("id") % 20 == 0, 9).collect()}
    m = np.array([v for _, v, _ in data])
    z = (m - m.mean(axis=0)) / np.where(m.std(axis=0) > 0, m.std(axis=0), 1)
    want = {}
    for k, (i, _, _) in enumerate(data):
        if i % 20 == 0:
            near = sorted((round(float(((z[j] - z[k]) ** 2).sum()), 9), data[j][0], data[j][2]) for j in range(len(data)) if j != k)[:9]
            for _, _, label in near:
                want[(i, label)] = want.get((i, label), 0) + 1 / 9
    assert out.keys() == want.keys() and all(abs(out[k] - want[k]) < 1e-9 for k in want)
    assert baselines.analog_votes(spark.createDataFrame(data[:1], "id long, v array<double>, label int"), F.lit(True)).count() == 0


def test_names_that_fit_more_than_one_region_give_none(spark):
    names = spark.createDataFrame([("North-East", 1), ("north east", 2), ("South", 3), ("SOUTH ", 3)], "name string, region_id int")
    rows = spark.createDataFrame([("north east",), ("south",), (None,)], "label string")
    assert {r["label"]: r["region_id"] for r in ingest.resolve(rows, names, "label").collect()} == {"north east": None, "south": 3, None: None}


def test_null_days_survive_an_upsert(spark, tmp_path):
    schema = "k int, day date, value double, status string, ingested_at long"
    path = f"file://{tmp_path}/store"
    day = dt.date(2024, 1, 1)
    tiers.upsert(spark.createDataFrame([(1, None, 1.0, "final", 1), (2, day, 2.0, "provisional", 1)], schema), path, ["k", "day"], "day")
    tiers.upsert(spark.createDataFrame([(3, None, 3.0, "final", 2), (2, day, 5.0, "final", 2)], schema), path, ["k", "day"], "day")
    tiers.upsert(spark.createDataFrame([(2, day, 9.0, "provisional", 3)], schema), path, ["k", "day"], "day")
    assert {(r["k"], r["day"], r["value"]) for r in spark.read.schema(schema).parquet(path).collect()} == {(1, None, 1.0), (3, None, 3.0), (2, day, 5.0)}


def test_cycles_are_done_once_oldest_first(spark):
    days = [dt.date(2024, 1, k) for k in (3, 1, 2, 1)]
    wanted, done = (spark.createDataFrame([(x,) for x in d], "init_date date") for d in (days, days[2:3]))
    assert [r[0].day for r in tiers.unfinished(wanted, done).collect()] == [1, 3]
    windows = tiers.tier_windows(spark.createDataFrame([(days[0],)], "today date")).first()
    assert (str(windows["final_until"]), str(windows["provisional_until"])) == ("2023-12-29", "2024-01-02")


def test_frames_refuse_and_blank(spark):
    rows = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.7, 2.0)], "k int, p double, obs double")
    assert {r["other_p"] for r in frames.shared_events(rows, rows, ["k"], "p").collect()} == {0.5, 0.7}
    for others in (rows.union(rows), rows.where("k = 1")):
        with pytest.raises(ValueError):
            frames.shared_events(rows, others, ["k"], "p")
    assert {(r["p"], r["obs"]) for r in frames.as_of_issue(rows, ["obs", "p"], ["p"]).collect()} == {(0.5, None), (0.7, None)}


def test_samples_are_the_same_each_time(spark):
    rows = spark.range(500).select(F.col("id"), (F.col("id") % 3).alias("s"))
    first = sorted(tuple(r) for r in store.stratified_sample(rows, ["s"], ["id"], 7).collect())
    assert len(first) == 21 and first == sorted(tuple(r) for r in store.stratified_sample(rows.repartition(5), ["s"], ["id"], 7).collect())


def test_models_learn(spark):
    """Each learner beats the base rate on data that it can learn, and misses no row."""
    rng = random.Random(8)
    data = []
    for i in range(600):
        x = rng.random()
        data.append((i, dt.date(2024, 1, 1) + dt.timedelta(days=i % 60), x if i % 10 else None, rng.random(), int(rng.random() < x), 3 * x))
    rows = spark.createDataFrame(data, "k int, init_date date, x double, noise double, y int, e double")
    held = models.out_of_fold(rows, ["x", "noise"], "e", trees=5)
    assert held.count() == 600 and held.where("x IS NOT NULL").agg(F.avg(F.abs(F.col("predicted") - F.col("e")))).first()[0] < 0.3
    shares = {r["feature"]: r["importance"] for r in models.importances(rows, ["x", "noise"], "e", trees=5).collect()}
    assert shares["x"] > 0.7 and abs(sum(shares.values()) - 1) < 1e-6
    base = rows.agg(F.var_pop("y")).first()[0]
    train, rest = rows.where("k < 400"), rows.where("k >= 400")
    calibrated = models.platt(models.classified(train.where("k < 250"), train.where("k >= 250"), ["x", "noise"], trees=3), models.classified(train.where("k < 250"), rest, ["x", "noise"], trees=3))
    for made in (models.logistic(train, rest, ["x"]), models.isotonic(train, rest, "x"), calibrated):
        assert made.where("x IS NOT NULL").agg(F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y")))).first()[0] < base
