"""Queries that tell cycles again: the list, the leads, the charts, and where members part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import events, replay, serving
from nimbora.operators.ordered import written
from nimbora.plans.forecast_queries import cuts, event_rows
from nimbora.plans.registry import Registry
from nimbora.plans.score_queries import S, scored
from nimbora.plans.views import ANGLE, EVENT, forecasts, with_sql

R = Registry()
HIGH = 0.5


def told(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scored events with their dominant variable, and their variables; outcomes after a month's 20th are not known yet."""
    rows = written(event_rows(s, d).select(*EVENT, "variable", "fc_mean", "obs_mean", "pred_err", "actual_err", "spread"))
    usual = written(cuts(rows))
    main = events.dominant(rows, usual).select(*EVENT, "dominant_variable")
    known = F.when(F.dayofmonth("valid_date") <= 20, F.col("obs_mean"))
    values = rows.join(F.broadcast(usual), "variable").select(*EVENT, "variable", F.col("fc_mean").alias("predicted_value"), known.alias("observed_value"), "spread", "bust_threshold")  # a row a variable
    return written(scored(s, d).join(main, EVENT, "left")), values


KEYS = ", ".join(EVENT)
TOLD = (
    *S,
    f"dom AS (SELECT {KEYS}, variable AS dominant_variable FROM (SELECT {KEYS}, variable, row_number() OVER (PARTITION BY {KEYS} ORDER BY pred_err / bust_threshold DESC, variable) AS k FROM evt JOIN thr USING (variable) WHERE bust_threshold > 0) WHERE k = 1)",
    f"evs AS (SELECT s.*, dominant_variable FROM scored s LEFT JOIN dom USING ({KEYS}))",
    f"val AS (SELECT {KEYS}, variable, fc_mean AS predicted_value, CASE WHEN day(valid_date) <= 20 THEN obs_mean END AS observed_value, spread, bust_threshold FROM evt JOIN thr USING (variable))",
    "known AS (SELECT *, abs(predicted_value - observed_value) AS abs_err FROM val WHERE observed_value IS NOT NULL)",
)
LIST = (
    *TOLD,
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY init_date ORDER BY p DESC, lead_time_days, region_id) AS k FROM evs) WHERE k = 1)",
    "c AS (SELECT init_date, count(DISTINCT lead_time_days) AS leads, count(DISTINCT region_id) AS n_regions, coalesce(avg(p) FILTER (lead_time_days > 3) - avg(p) FILTER (lead_time_days <= 3), 0) AS growth FROM evs GROUP BY 1)",
    "v AS (SELECT init_date, count(DISTINCT lead_time_days) AS verified_leads FROM known GROUP BY 1)",
    "miss AS (SELECT init_date, region_id, variable, avg(abs_err) AS err FROM known WHERE variable <> 'error' GROUP BY ALL)",
    "high AS (SELECT init_date, lead_time_days, count(*) FILTER (band = 'high') AS n FROM evs GROUP BY ALL)",
    """cycles AS (
  SELECT c.init_date, leads, n_regions, t.p AS peak_p, t.lead_time_days AS peak_lead, t.region_id AS peak_region, t.dominant_variable AS peak_variable, high.n AS n_high_at_peak,
    coalesce(verified_leads, 0) AS verified_leads, err AS peak_abs_err, CASE WHEN bust_threshold > 0 THEN err / bust_threshold END AS peak_rel_err, growth
  FROM c JOIN top t ON t.init_date = c.init_date JOIN high ON high.init_date = c.init_date AND high.lead_time_days = t.lead_time_days LEFT JOIN v ON v.init_date = c.init_date
    LEFT JOIN miss ON miss.init_date = c.init_date AND miss.region_id = t.region_id AND miss.variable = t.dominant_variable LEFT JOIN thr ON thr.variable = t.dominant_variable)""",
)
R.add(
    "replay_cycles",
    lambda s, d: replay.ordered_cycles(replay.cycle_list(*told(s, d), [ANGLE])),
    with_sql(*LIST)
    + """SELECT *, CAST(row_number() OVER (ORDER BY round_even(n_regions / greatest((SELECT max(n_regions) FROM cycles), 1) / 0.1::DOUBLE, 0) DESC, verified_leads > 0 DESC, round_even(coalesce(peak_rel_err, 0), 3) DESC,
  round_even(greatest(growth, 0), 3) DESC, round_even(coalesce(peak_p, 0), 3) DESC, verified_leads DESC, init_date DESC) AS INTEGER) AS place FROM cycles""",
    ("peak_abs_err", "peak_rel_err", "growth"),
)
STEPS = (
    *TOLD,
    "st AS (SELECT init_date, lead_time_days, min(valid_date) AS valid_date, count(*) FILTER (band = 'high') AS n_high, count(*) FILTER (band = 'medium') AS n_medium, avg(p) AS mean_p FROM evs GROUP BY ALL)",
)
R.add(
    "replay_steps",
    lambda s, d: replay.lead_story(told(s, d)[0]),
    with_sql(
        *STEPS,
        "tp AS (SELECT init_date, lead_time_days, region_id AS top_region, p AS top_p, dominant_variable AS driver FROM (SELECT *, row_number() OVER (PARTITION BY init_date, lead_time_days ORDER BY p DESC, region_id) AS k FROM evs) WHERE k = 1)",
        "b AS (SELECT *, lag(lead_time_days) OVER w AS prev, lag(driver) OVER w AS before FROM st JOIN tp USING (init_date, lead_time_days) WINDOW w AS (PARTITION BY init_date ORDER BY lead_time_days))",
        "m AS (SELECT b.init_date, b.lead_time_days, e.region_id, f.p AS from_p, e.p AS to_p, row_number() OVER (PARTITION BY b.init_date, b.lead_time_days ORDER BY round(e.p - f.p, 9) DESC, e.region_id) AS k FROM b JOIN evs e ON e.init_date = b.init_date AND e.lead_time_days = b.lead_time_days JOIN evs f ON f.init_date = b.init_date AND f.lead_time_days = b.prev AND f.region_id = e.region_id)",
    )
    + "SELECT b.init_date, b.lead_time_days, valid_date, n_high, n_medium, mean_p, top_region, top_p, driver, CASE WHEN driver IS DISTINCT FROM coalesce(before, '') THEN driver END AS new_driver, m.region_id AS rising_region, from_p, to_p FROM b LEFT JOIN m ON m.init_date = b.init_date AND m.lead_time_days = b.lead_time_days AND m.k = 1 AND round(to_p - from_p, 9) >= 0.05",
    ("mean_p",),
)
R.add(
    "replay_trend",
    lambda s, d: replay.trend(replay.lead_story(told(s, d)[0])),
    with_sql(*STEPS, "ends AS (SELECT init_date, min(lead_time_days) AS first_lead, arg_min(mean_p, lead_time_days) AS first_p, max(lead_time_days) AS last_lead, arg_max(mean_p, lead_time_days) AS last_p FROM st GROUP BY 1)")
    + "SELECT *, CASE WHEN round(last_p - first_p, 9) > 0.02 THEN 'climbs' WHEN round(last_p - first_p, 9) < -0.02 THEN 'eases' ELSE 'holds' END AS trend FROM ends",
    ("first_p", "last_p"),
)


def _focus(s: SparkSession, d: str) -> DataFrame:
    made = replay.focus(*told(s, d), [ANGLE])
    return made.select("init_date", "region_id", "worst_p", "variable", "is_default", F.explode("points").alias("x")).select("init_date", "region_id", "worst_p", "variable", "is_default", "x.lead_time_days", "x.predicted_value", "x.observed_value")


R.add(
    "replay_focus",
    _focus,
    with_sql(
        *TOLD,
        "w AS (SELECT * FROM (SELECT init_date, region_id, p AS worst_p, dominant_variable, row_number() OVER (PARTITION BY init_date, region_id ORDER BY p DESC, lead_time_days) AS k FROM evs) WHERE k = 1)",
        "sr AS (SELECT init_date, region_id, variable, round(avg(abs_err), 9) AS err, round(avg(CASE WHEN bust_threshold > 0 THEN abs_err / bust_threshold END), 9) AS ratio FROM known WHERE variable <> 'error' GROUP BY ALL)",
        "ch AS (SELECT init_date, region_id, variable, worst_p, row_number() OVER (PARTITION BY init_date, region_id ORDER BY variable IS DISTINCT FROM dominant_variable, ratio IS NULL, ratio DESC, err DESC, variable) AS place FROM sr JOIN w USING (init_date, region_id))",
        "d AS (SELECT *, row_number() OVER (PARTITION BY init_date ORDER BY worst_p DESC, region_id) = 1 AS is_default FROM ch WHERE place = 1)",
    )
    + "SELECT init_date, region_id, worst_p, variable, is_default, lead_time_days, predicted_value, observed_value FROM d JOIN known USING (init_date, region_id, variable)",
    ("predicted_value", "observed_value"),
)
SUBJECT = (
    *TOLD,
    "cv AS (SELECT *, row_number() OVER (PARTITION BY init_date, region_id, variable ORDER BY lead_time_days) AS k, count(*) OVER (PARTITION BY init_date, region_id, variable) AS n FROM val WHERE variable <> 'error' AND spread IS NOT NULL AND bust_threshold > 0)",
    "en AS (SELECT init_date, region_id, variable, min(bust_threshold) AS bust_threshold, avg(spread) FILTER (k <= greatest(1, n // 3)) AS early, avg(spread) FILTER (k > n - greatest(1, n // 3)) AS late FROM cv WHERE n >= 3 GROUP BY ALL)",
    "pk AS (SELECT init_date, region_id, max(p) AS peak_p, min(lead_time_days) FILTER (p >= 0.5) AS crossover_lead FROM evs GROUP BY ALL)",
    "rk AS (SELECT *, round((late - early) / bust_threshold, 9) AS gain FROM en LEFT JOIN pk USING (init_date, region_id) WHERE round(late, 9) >= round(0.15::DOUBLE * bust_threshold, 9))",
    "sb AS (SELECT * EXCLUDE k FROM (SELECT *, row_number() OVER (PARTITION BY init_date ORDER BY gain DESC, coalesce(peak_p, 0) DESC, region_id, variable) AS k FROM rk) WHERE k = 1)",
    "cy AS (SELECT init_date, avg(p) AS mean_p, count(DISTINCT region_id) AS n_regions, count(DISTINCT region_id) FILTER (p >= 0.5) AS n_high_regions, min(lead_time_days) FILTER (p >= 0.5) AS high_by_lead FROM evs GROUP BY 1)",
    "pr AS (SELECT *, CASE WHEN datediff('day', lag(init_date) OVER w, init_date) <= 7 THEN lag(init_date) OVER w END AS prior_init_date, CASE WHEN datediff('day', lag(init_date) OVER w, init_date) <= 7 THEN lag(mean_p) OVER w END AS prior_mean_p FROM cy WINDOW w AS (ORDER BY init_date))",
)
R.add(
    "ensemble_divergence",
    lambda s, d: replay.divergence(*told(s, d), [ANGLE], HIGH),
    with_sql(*SUBJECT) + "SELECT * FROM sb JOIN pr USING (init_date)",
    ("early", "late", "gain", "bust_threshold", "mean_p", "prior_mean_p"),
)


def _charts(s: SparkSession, d: str) -> DataFrame:
    found, values = told(s, d)
    members = forecasts(s, d).withColumn("is_control", F.col("member") == 0)
    made = replay.traces(replay.divergence(found, values, [ANGLE], HIGH), members, values)
    key = ["init_date", "region_id", "variable"]
    counts = [F.size("mean").cast("long").alias("n_mean"), F.size("observed").cast("long").alias("n_observed")]
    lines = made.select(*key, *counts, F.posexplode("members").alias("place", "m"))
    return lines.select(*key, "n_mean", "n_observed", "place", "m.member", "m.is_control", F.explode("m.points").alias("x")).select(*key, "n_mean", "n_observed", "place", "member", "is_control", "x.lead_time_days", "x.value")


R.add(
    "divergence_traces",
    _charts,
    with_sql(*SUBJECT, "n AS (SELECT init_date, count(*) AS n_mean, count(observed_value) AS n_observed FROM val JOIN sb USING (init_date, region_id, variable) GROUP BY 1)")
    + "SELECT init_date, region_id, variable, n_mean, n_observed, CAST(dense_rank() OVER (PARTITION BY init_date ORDER BY member <> 0, member) - 1 AS INTEGER) AS place, member, member = 0 AS is_control, fc.lead_time_days, fc.forecast_value AS value FROM fc JOIN (SELECT init_date, region_id, variable FROM sb) USING (init_date, region_id, variable) JOIN n USING (init_date)",
    ("value",),
)


def _by_run(s: SparkSession, d: str) -> DataFrame:
    made = serving.detail(scored(s, d), event_rows(s, d)).withColumn("n_curve", F.size("curve").cast("long"))
    return made.select("region_id", "init_date", "n_curve", F.explode("series").alias("v")).select("region_id", "init_date", "n_curve", "v.variable", F.size("v.points").cast("long").alias("n_points"), F.element_at("v.points", -1)["lead_time_days"].alias("last_lead"))


R.add(
    "region_detail_by_run",
    _by_run,
    with_sql(*S) + "SELECT e.region_id, e.init_date, n_curve, variable, count(*) AS n_points, max(lead_time_days) AS last_lead FROM evt e JOIN (SELECT region_id, init_date, count(*) AS n_curve FROM scored GROUP BY ALL) c ON c.region_id = e.region_id AND c.init_date = e.init_date GROUP BY ALL",
)
