"""Cycles told again, by hand: order, story of the leads, what is charted, divergence and its charts; models' queries on a small table."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from nimbora.operators import replay, serving
from nimbora.plans import catalogue

DATA = "/root/testdata/sf0.001"
EV = "region_id string, init_date date, valid_date date, lead_time_days int, p double, band string, dominant_variable string"
VAL = "region_id string, init_date date, valid_date date, lead_time_days int, variable string, predicted_value double, observed_value double, spread double, bust_threshold double"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def band(p):
    return "unknown" if p is None else "high" if p >= 0.5 else "medium" if p >= 0.3 else "low"


def events_of(spark, rows):
    return spark.createDataFrame([(r, day(c), day(c + lead), lead, p, band(p), v) for r, c, lead, p, v in rows], EV)


def values_of(spark, rows):
    return spark.createDataFrame([(r, day(c), day(c + lead), lead, v, a, b, s, t) for r, c, lead, v, a, b, s, t in rows], VAL)


def test_list_says_how_far_the_peak_was_missed(spark):
    ev = events_of(spark, [("a", 0, 1, 0.2, "rain"), ("a", 0, 5, 0.9, "rain"), ("b", 0, 5, 0.9, "temp"), ("b", 0, 1, None, None), ("a", 1, 1, 0.4, "wind"), ("c", 2, 1, None, None)])
    val = values_of(spark, [("a", 0, 5, "rain", 10.0, 4.0, 1.0, 3.0), ("a", 0, 1, "rain", 2.0, 4.0, 1.0, 3.0), ("b", 0, 5, "temp", 1.0, None, 1.0, 2.0), ("a", 1, 1, "wind", 350.0, 10.0, 1.0, 20.0)])
    made = {r["init_date"]: r for r in replay.cycle_list(ev, val, ["wind"]).collect()}
    first = made[day(0)]
    # both regions peak at 0.9: the smaller name is the peak; rain there was missed by 6 and by 2
    assert (first["peak_region"], first["peak_lead"], first["n_high_at_peak"], first["leads"], first["n_regions"]) == ("a", 5, 2, 2, 2)
    assert (first["verified_leads"], first["peak_abs_err"], first["peak_rel_err"]) == (2, 4.0, pytest.approx(4 / 3))
    assert first["growth"] == pytest.approx(0.7)
    # an angle's error is no plain difference; a lead alone grows by nothing
    assert made[day(1)]["peak_abs_err"] is None and made[day(1)]["verified_leads"] == 1 and made[day(1)]["growth"] == 0
    assert made[day(2)]["peak_p"] is None and made[day(2)]["n_high_at_peak"] == 0
    assert replay.cycle_list(ev.limit(0), val.limit(0), []).count() == 0


def test_order_puts_coverage_first(spark):
    kind = "init_date date, n_regions long, verified_leads long, peak_rel_err double, growth double, peak_p double"
    rows = [
        (day(0), 36, 5, 3.0, 0.5, 0.99),  # few regions, badly missed
        (day(1), 660, 0, None, 0.1, 0.8),
        (day(2), 666, 3, 0.5, 0.0, 0.4),  # verified, in the same tier as the others
        (day(3), 640, 3, 1.5, -0.2, 0.3),  # missed by more
        (day(4), 666, 0, None, 0.1, 0.8),  # alike but newer than day 1
    ]
    made = replay.ordered_cycles(spark.createDataFrame(rows, kind)).orderBy("place")
    assert [r["init_date"] for r in made.collect()] == [day(k) for k in (3, 2, 4, 1, 0)]


def test_story_of_the_leads(spark):
    ev = events_of(spark, [("a", 0, 1, 0.2, "rain"), ("b", 0, 1, 0.3, "temp"), ("a", 0, 2, 0.6, "rain"), ("b", 0, 2, 0.31, "temp"), ("c", 0, 2, 0.1, "rain"), ("a", 0, 4, 0.62, "rain"), ("c", 0, 4, 0.5, "rain"), ("b", 0, 5, 0.9, "temp")])
    made = {r["lead_time_days"]: r for r in replay.lead_story(ev).collect()}
    assert made[1]["top_region"] == "b" and made[1]["new_driver"] == "temp" and made[1]["rising_region"] is None
    assert (made[2]["rising_region"], made[2]["from_p"], made[2]["to_p"], made[2]["new_driver"], made[2]["n_high"], made[2]["n_medium"]) == ("a", 0.2, 0.6, "rain", 1, 1)
    assert made[4]["rising_region"] == "c" and made[4]["new_driver"] is None
    assert made[5]["rising_region"] is None and made[5]["new_driver"] == "temp"  # b was not there at lead 4
    told = replay.trend(replay.lead_story(ev)).first()
    assert (told["first_lead"], told["last_lead"], told["trend"]) == (1, 5, "climbs")
    flat = events_of(spark, [("a", 0, 1, 0.4, None), ("a", 0, 2, 0.42, None), ("a", 1, 1, 0.4, None), ("a", 1, 2, 0.37, None)])
    assert {r["init_date"]: r["trend"] for r in replay.trend(replay.lead_story(flat)).collect()} == {day(0): "holds", day(1): "eases"}


def test_focus_falls_back(spark):
    ev = events_of(spark, [("a", 0, 1, 0.9, "wind"), ("a", 0, 2, 0.1, "rain"), ("b", 0, 1, 0.5, "rain"), ("c", 0, 1, 0.95, "rain"), ("d", 0, 1, 0.2, "snow")])
    val = values_of(
        spark,
        [("a", 0, 1, "wind", 9.0, 1.0, None, 1.0), ("a", 0, 2, "rain", 1.0, 2.0, None, 10.0), ("a", 0, 1, "temp", 1.0, 1.5, None, 1.0)]  # an angle leads: the largest ratio
        + [("b", 0, 1, "temp", 0.0, 50.0, None, 1.0), ("b", 0, 2, "rain", 1.0, 1.0, 0.5, 1.0), ("b", 0, 1, "rain", 2.0, 1.0, 0.5, 1.0)]  # the dominant one is there
        + [("c", 0, 1, "rain", 2.0, None, 0.5, 1.0)]  # not verified
        + [("d", 0, 1, "rain", 2.0, 4.0, 0.5, None), ("d", 0, 1, "temp", 2.0, 5.0, 0.5, 0.0)],  # no thresholds: the largest error
    )
    made = {r["region_id"]: r for r in replay.focus(ev, val, ["wind"]).collect()}
    assert {k: r["variable"] for k, r in made.items()} == {"a": "temp", "b": "rain", "d": "temp"}
    assert [x["lead_time_days"] for x in made["b"]["points"]] == [1, 2]
    assert [k for k, r in made.items() if r["is_default"]] == ["a"]
    chosen = {r["region_id"]: r["is_default"] for r in replay.focus(ev, val, ["wind"], region="d").collect()}
    assert chosen == {"a": False, "b": False, "d": True}
    assert [r["region_id"] for r in replay.focus(ev, val, ["wind"], region="c").where("is_default").collect()] == ["a"]


def test_divergence_and_its_charts(spark):
    def curve(region, cycle, variable, spreads, cut):
        return [(region, cycle, k, variable, 1.0 * k, 2.0 if k < 3 else None, s, cut) for k, s in enumerate(spreads, 1)]

    val = values_of(
        spark,
        curve("a", 0, "rain", [1.0, 1.0, 2.0, 3.0, 5.0, 5.0], 4.0)  # (5 - 1) / 4
        + curve("b", 0, "temp", [0.1, 0.1, 1.1], 1.0)  # the same growth, of a higher p
        + curve("b", 0, "wind", [0.1, 0.1, 9.0], 1.0)  # an angle
        + curve("c", 0, "temp", [0.1, 9.0], 1.0)  # too short
        + curve("c", 0, "rain", [0.0, 0.0, 0.1], 1.0)  # hardly any spread
        + curve("c", 0, "snow", [0.0, 0.0, 9.0], 0.0)  # no threshold
        + curve("a", 20, "rain", [1.0, None, 1.0, 2.0], 4.0),
    )
    ev = events_of(spark, [("a", 0, 1, 0.4, "rain"), ("b", 0, 1, 0.3, "temp"), ("b", 0, 2, 0.7, "temp"), ("c", 0, 3, 0.6, "temp"), ("a", 20, 1, 0.1, "rain"), ("a", 15, 1, 0.2, "rain")])
    made = {r["init_date"]: r for r in replay.divergence(ev, val, ["wind"], 0.5).collect()}
    first = made[day(0)]
    assert (first["region_id"], first["variable"], first["gain"], first["crossover_lead"]) == ("b", "temp", 1.0, 2)
    assert (first["n_regions"], first["n_high_regions"], first["high_by_lead"], first["mean_p"], first["prior_mean_p"]) == (3, 2, 2, 0.5, None)
    later = made[day(20)]
    assert (later["early"], later["late"], later["gain"], later["prior_init_date"], later["prior_mean_p"]) == (1.0, 2.0, 0.25, day(15), 0.2)
    pinned = {r["init_date"]: r["region_id"] for r in replay.divergence(ev, val, ["wind"], 0.5, region="a").collect()}
    assert pinned == {day(0): "a", day(20): "a"}

    kind = "region_id string, init_date date, variable string, member string, is_control boolean, lead_time_days int, valid_date date, forecast_value double"
    members = spark.createDataFrame([("b", day(0), "temp", m, m == "c00", k, day(k), float(k)) for m in ("p02", "a01", "c00") for k in (2, 1)] + [("b", day(0), "temp", None, False, 1, day(1), 0.0), ("a", day(0), "rain", "c00", True, 1, day(1), 0.0)], kind)
    charts = {r["init_date"]: r for r in replay.traces(replay.divergence(ev, val, ["wind"], 0.5), members, val).collect()}
    chart = charts[day(0)]
    assert [(m["member"], m["is_control"]) for m in chart["members"]] == [("c00", True), ("a01", False), ("p02", False)]
    assert [x["lead_time_days"] for x in chart["members"][0]["points"]] == [1, 2]
    assert len(chart["mean"]) == 3 and len(chart["observed"]) == 2
    assert charts[day(20)]["members"] is None and len(charts[day(20)]["mean"]) == 4


def test_agreement_in_percent_of_the_threshold(spark):
    rows = spark.createDataFrame([("rain", 1.0, 3.0), ("rain", 4.0, 4.0), ("temp", 1.0, 2.0), ("snow", 1.0, 2.0)], "variable string, a double, b double")
    cuts = spark.createDataFrame([("rain", 4.0), ("temp", 0.0)], "variable string, bust_threshold double")
    made = serving.against_threshold(serving.agreement(rows, ["variable"], "a", "b"), cuts).collect()
    assert {r["variable"]: r["mae_pct_of_threshold"] for r in made} == {"rain": 25.0, "temp": None, "snow": None}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no test data")
def test_scoring_queries_on_given_tables(spark):
    """The queries without SQL give whole results: every later event is scored once, and rungs are compared on the same events."""
    found = catalogue.queries()["score_cycle"](spark, "/root/testdata/sf0.01").collect()
    from nimbora.plans.score_queries import scored

    later = scored(spark, "/root/testdata/sf0.01").where("dayofmonth(init_date) > 15").groupBy("init_date").agg(F.count(F.lit(1)).alias("n")).collect()
    totals = {}
    for r in found:
        assert r["band"] in ("low", "medium", "high") and 0 <= r["mean_p"] <= 1 and r["n_dominant"] <= r["n"]
        totals[r["init_date"]] = totals.get(r["init_date"], 0) + r["n"]
    assert totals == {r["init_date"]: r["n"] for r in later}

    rungs = catalogue.queries()["baseline_ladder"](spark, "/root/testdata/sf0.01").collect()
    assert {r["name"] for r in rungs} == {"lead", "spread", "lead, spread and season"} and {r["n"] for r in rungs} == {sum(totals.values())}
    assert [r["name"] for r in rungs if r["best"]] == [max(sorted(rungs, key=lambda r: r["name"]), key=lambda r: r["skill"])["name"]]
