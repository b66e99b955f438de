"""Queries on pairing, ensembles, trajectories, bias and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import bias, events, frames, pairing, trajectories
from nimbora.operators.ordered import written
from nimbora.plans.registry import Registry
from nimbora.plans.views import ANGLE, EVENT, EVENTS, FC, LABELLED, MEMBERS, OB, PAIRED, THRESHOLDS, VARIABLES, forecasts, observations, table, with_sql

R = Registry()

RANGES = {"click": (5.0, 400.0), "error": (0.0, 300.0)}
CAPS = {"view": 5, "signup": 3}


def paired(spark: SparkSession, d: str, how: str = "inner") -> DataFrame:
    """All forecasts with their observations."""
    return pairing.pair(forecasts(spark, d), observations(spark, d), ANGLE, how)


def members(spark: SparkSession, d: str) -> DataFrame:
    """Run statistics of each event and variable."""
    return pairing.ensemble(forecasts(spark, d), ANGLE, [*EVENT, "variable"])


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Run statistics of each trajectory."""
    return pairing.ensemble(forecasts(spark, d), ANGLE, ["region_id", "variable", "valid_date", "init_date"])


def event_rows(spark: SparkSession, d: str) -> DataFrame:
    """Event rows by variable."""
    return events.event_rows(paired(spark, d), ANGLE)


def cuts(rows: DataFrame) -> DataFrame:
    """Bust thresholds."""
    return events.thresholds(rows, "actual_err", 0.9, "bust_threshold")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """Events with their label."""
    rows = event_rows(spark, d)
    return events.label(rows, cuts(rows))


EVT = (FC, OB, PAIRED, EVENTS)
ALL = (*EVT, THRESHOLDS, LABELLED)
RUNS = MEMBERS.replace("SELECT region_id, init_date, valid_date, lead_time_days, variable,", "SELECT region_id, variable, valid_date, init_date,").replace("GROUP BY region_id, init_date, valid_date, lead_time_days, variable", "GROUP BY region_id, variable, valid_date, init_date")

R.add("observed_means", lambda s, d: pairing.observed_means(observations(s, d)), with_sql(FC, OB) + "SELECT region_id, variable, valid_date, observed_value, n_obs FROM ob", ("observed_value",))
R.add(
    "pair_inner",
    lambda s, d: paired(s, d).select("region_id", "variable", "valid_date", "init_date", "lead_time_days", "member", "forecast_value", "observed_value", "abs_error"),
    with_sql(FC, OB, PAIRED) + "SELECT region_id, variable, valid_date, init_date, lead_time_days, member, forecast_value, observed_value, abs_error FROM paired",
    ("forecast_value", "observed_value", "abs_error"),
)
R.add(
    "pair_left",
    lambda s, d: pairing.pair(forecasts(s, d), observations(s, d).where("dayofmonth(valid_date) < 20"), ANGLE, "left").select("region_id", "variable", "valid_date", "member", "forecast_value", "observed_value"),
    with_sql(FC, OB) + "SELECT fc.region_id, fc.variable, fc.valid_date, member, forecast_value, observed_value FROM fc LEFT JOIN (SELECT * FROM ob WHERE day(valid_date) < 20) o ON fc.region_id = o.region_id AND fc.variable = o.variable AND fc.valid_date = o.valid_date",
    ("forecast_value", "observed_value"),
)
R.add(
    "implausible_filter",
    lambda s, d: pairing.drop_implausible(forecasts(s, d), RANGES).groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.max("forecast_value").alias("most")),
    with_sql(FC) + "SELECT variable, count(*) AS n, max(forecast_value) AS most FROM fc WHERE NOT ((variable = 'click' AND forecast_value NOT BETWEEN 5 AND 400) OR (variable = 'error' AND forecast_value NOT BETWEEN 0 AND 300)) GROUP BY 1",
    ("most",),
)
R.add(
    "lead_cap_filter",
    lambda s, d: pairing.drop_beyond_lead(forecasts(s, d), CAPS).groupBy("variable", "lead_time_days").agg(F.count(F.lit(1)).alias("n")),
    with_sql(FC) + "SELECT variable, lead_time_days, count(*) AS n FROM fc WHERE NOT (variable = 'view' AND lead_time_days > 5 OR variable = 'signup' AND lead_time_days > 3) GROUP BY ALL",
)
R.add("ensemble_mean_spread", lambda s, d: members(s, d).drop("east", "north"), with_sql(FC, MEMBERS) + "SELECT region_id, init_date, valid_date, lead_time_days, variable, n_members, fc_mean, spread FROM members", ("fc_mean", "spread"))
R.add("circular_mean", lambda s, d: members(s, d).where(F.col("variable") == ANGLE).select(*EVENT, "fc_mean"), with_sql(FC, MEMBERS) + "SELECT region_id, init_date, valid_date, lead_time_days, fc_mean FROM members WHERE variable = 'error'", ("fc_mean",))
R.add("trajectories", lambda s, d: runs(s, d).drop("east", "north"), with_sql(FC, RUNS) + "SELECT region_id, variable, valid_date, init_date, n_members, fc_mean, spread FROM members", ("fc_mean", "spread"))

JUMPS = """steps AS (
  SELECT *, fc_mean - lag(fc_mean) OVER w AS e0, lag(fc_mean, 1) OVER w - lag(fc_mean, 2) OVER w AS e1,
    lag(fc_mean, 2) OVER w - lag(fc_mean, 3) OVER w AS e2, lag(fc_mean, 3) OVER w - lag(fc_mean, 4) OVER w AS e3
  FROM members WINDOW w AS (PARTITION BY region_id, variable, valid_date ORDER BY init_date)),
turned AS (
  SELECT *, CASE WHEN variable = 'error' THEN (((e0 + 180) % 360) + 360) % 360 - 180 ELSE e0 END AS d0,
    CASE WHEN variable = 'error' THEN (((e1 + 180) % 360) + 360) % 360 - 180 ELSE e1 END AS d1,
    CASE WHEN variable = 'error' THEN (((e2 + 180) % 360) + 360) % 360 - 180 ELSE e2 END AS d2,
    CASE WHEN variable = 'error' THEN (((e3 + 180) % 360) + 360) % 360 - 180 ELSE e3 END AS d3 FROM steps),
rel AS (SELECT *, list_filter([0, -d0, -d0 - d1, -d0 - d1 - d2, -d0 - d1 - d2 - d3], lambda x: x IS NOT NULL) AS vals,
  list_filter([sign(d0), sign(d1), sign(d2), sign(d3)], lambda x: x IS NOT NULL AND x <> 0) AS signs FROM turned),
jumps AS (
  SELECT region_id, variable, valid_date, init_date, abs(d0) AS jump_abs,
    CASE WHEN len(vals) >= 3 THEN list_aggregate(vals, 'stddev_samp') END AS jump_std,
    CASE WHEN len(vals) >= 3 THEN CAST(len(list_filter(range(1, len(signs)), lambda i: signs[i] <> signs[i + 1])) AS INTEGER) END AS jump_flips
  FROM rel)"""
KEYS4 = ["region_id", "variable", "valid_date", "init_date"]
R.add(
    "jumpiness",
    lambda s, d: trajectories.jumpiness(runs(s, d), ANGLE).select(*KEYS4, "jump_abs", "jump_std", "jump_flips"),
    with_sql(FC, RUNS, JUMPS) + "SELECT region_id, variable, valid_date, init_date, jump_abs, jump_std, jump_flips FROM jumps",
    ("jump_abs", "jump_std"),
)
R.add("jump_circular", lambda s, d: trajectories.jumpiness(runs(s, d), ANGLE).where(F.col("variable") == ANGLE).select(*KEYS4, "jump_abs"), with_sql(FC, RUNS, JUMPS) + "SELECT region_id, variable, valid_date, init_date, jump_abs FROM jumps WHERE variable = 'error'", ("jump_abs",))


def _jump_climatology(s: SparkSession, d: str) -> DataFrame:
    jumps = trajectories.jumpiness(runs(s, d), ANGLE)
    return jumps.groupBy("region_id", "variable").agg(F.avg("jump_abs").alias("usual_jump"), F.count("jump_abs").alias("n")).where("n > 0")


def _jump_relative(s: SparkSession, d: str) -> DataFrame:
    jumps = trajectories.jumpiness(runs(s, d), ANGLE)
    usual = jumps.groupBy("region_id", "variable").agg(F.avg("jump_abs").alias("usual_jump"))
    return jumps.join(usual, ["region_id", "variable"]).select(*KEYS4, F.when(F.col("usual_jump") > 0, F.col("jump_abs") / F.col("usual_jump")).alias("relative"))


R.add("jump_climatology", _jump_climatology, with_sql(FC, RUNS, JUMPS) + "SELECT region_id, variable, avg(jump_abs) AS usual_jump, count(jump_abs) AS n FROM jumps GROUP BY ALL HAVING count(jump_abs) > 0", ("usual_jump",))
R.add("jump_relative", _jump_relative, with_sql(FC, RUNS, JUMPS) + "SELECT region_id, variable, valid_date, init_date, CASE WHEN usual > 0 THEN jump_abs / usual END AS relative FROM (SELECT *, avg(jump_abs) OVER (PARTITION BY region_id, variable) AS usual FROM jumps)", ("relative",))
LAF = """prior AS (
  SELECT *, coalesce(list(fc_mean) OVER (PARTITION BY region_id, variable, valid_date ORDER BY init_date ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), []) AS p FROM members),
vec AS (SELECT *, n_members + len(p) AS laf_size, n_members * east + coalesce(list_sum(list_transform(p, lambda x: sin(radians(x)))), 0) AS pe,
    n_members * north + coalesce(list_sum(list_transform(p, lambda x: cos(radians(x)))), 0) AS pn FROM prior),
pool AS (SELECT *, CASE WHEN variable = 'error' THEN ((degrees(atan2(pe, pn)) % 360) + 360) % 360
    ELSE (n_members * fc_mean + coalesce(list_sum(p), 0)) / laf_size END AS laf_mean FROM vec),
dev AS (SELECT *, CASE WHEN laf_size < 2 THEN NULL WHEN variable = 'error' THEN degrees(sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt(pe * pe + pn * pn) / laf_size))))) ELSE sqrt((CASE WHEN n_members > 1 THEN (n_members - 1) * spread * spread ELSE 0 END
    + n_members * (fc_mean - laf_mean) ** 2 + coalesce(list_sum(list_transform(p, lambda x: (x - laf_mean) ** 2)), 0)) / (laf_size - 1)) END AS laf_std FROM pool)"""
R.add(
    "laf_pool",
    lambda s, d: trajectories.lagged_pool(runs(s, d), ANGLE).select(*KEYS4, "laf_size", "laf_mean", "laf_std", "laf_ratio"),
    with_sql(FC, RUNS, LAF) + "SELECT region_id, variable, valid_date, init_date, laf_size, laf_mean, laf_std, CASE WHEN n_members < 2 THEN NULL WHEN len(p) = 0 THEN 1.0 WHEN spread = 0 THEN NULL ELSE laf_std / spread END AS laf_ratio FROM dev",
    ("laf_mean", "laf_std", "laf_ratio"),
)


def _one_member(s: SparkSession, d: str) -> DataFrame:
    return forecasts(s, d).groupBy("region_id", "init_date", "member", "variable", "valid_date", "lead_time_days").agg(F.avg("forecast_value").alias("forecast_value"))


ONE = "one AS (SELECT region_id, init_date, member, variable, valid_date, lead_time_days, avg(forecast_value) AS forecast_value FROM fc GROUP BY ALL)"
R.add(
    "rate_of_change",
    lambda s, d: trajectories.rate_of_change(_one_member(s, d), ["region_id", "init_date", "member", "variable"]).select("region_id", "init_date", "member", "variable", "valid_date", "rate"),
    with_sql(FC, ONE) + "SELECT region_id, init_date, member, variable, valid_date, CASE WHEN datediff('day', lag(valid_date) OVER w, valid_date) > 0 THEN (forecast_value - lag(forecast_value) OVER w) / datediff('day', lag(valid_date) OVER w, valid_date) END AS rate FROM one WINDOW w AS (PARTITION BY region_id, init_date, member, variable ORDER BY valid_date)",
    ("rate",),
)


def _error_lag(s: SparkSession, d: str) -> DataFrame:
    rows = paired(s, d).groupBy("region_id", "init_date", "variable", "member", "lead_time_days").agg(F.avg("abs_error").alias("abs_error"))
    return trajectories.error_lag(rows)


R.add("error_lag", _error_lag, with_sql(FC, OB, PAIRED, "g AS (SELECT region_id, init_date, variable, member, lead_time_days, avg(abs_error) AS abs_error FROM paired GROUP BY ALL)") + "SELECT *, lag(abs_error) OVER (PARTITION BY region_id, init_date, variable, member ORDER BY lead_time_days) AS error_lag FROM g", ("abs_error", "error_lag"))
R.add(
    "concurrent_pivot",
    lambda s, d: trajectories.concurrent(forecasts(s, d), [*EVENT, "member"], VARIABLES),
    with_sql(FC) + "SELECT region_id, init_date, valid_date, lead_time_days, member, " + ", ".join(f"avg(CASE WHEN variable = '{v}' THEN forecast_value END) AS {v}" for v in VARIABLES) + " FROM fc GROUP BY ALL",
    tuple(VARIABLES),
)


def _as_of(s: SparkSession, d: str) -> DataFrame:
    readings = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))
    dates = table(s, d, "lineitem").select(F.to_date("l_shipdate").alias("date")).distinct()
    return trajectories.as_of(dates, readings, 5)


R.add(
    "asof_index",
    _as_of,
    """WITH readings AS (SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1),
dates AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem)
SELECT date, CASE WHEN datediff('day', r.day, date) <= 5 THEN value END AS value FROM dates ASOF LEFT JOIN readings r ON date >= r.day""",
    ("value",),
)
R.add(
    "dimension_lookup",
    lambda s, d: forecasts(s, d).groupBy("region_id").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))), F.col("region_id") == F.col("n_nationkey"), "left").select("region_id", "n", "n_name", "r_name"),
    with_sql(FC) + "SELECT f.region_id, f.n, n_name, r_name FROM (SELECT region_id, count(*) AS n FROM fc GROUP BY 1) f LEFT JOIN nation ON region_id = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey",
)
R.add(
    "bias_grouping_sets",
    lambda s, d: bias.fit_bias(event_rows(s, d)),
    with_sql(*EVT) + """SELECT region_id, variable, coalesce(lead, -1) AS lead_time_days, coalesce(month, -1) AS month, s / n AS bias, n FROM (
  SELECT region_id, variable, lead, month, sum(diff) AS s, count(diff) AS n FROM (SELECT region_id, variable, lead_time_days AS lead, CAST(month(valid_date) AS INTEGER) AS month, fc_mean - obs_mean AS diff FROM evt)
  GROUP BY GROUPING SETS ((region_id, variable, lead, month), (region_id, variable, month), (region_id, variable))) WHERE n >= 30""",
    ("bias",),
)


def _backoff(s: SparkSession, d: str) -> DataFrame:
    rows = event_rows(s, d)
    return bias.apply_bias(rows.select(*EVENT, "variable", "fc_mean", "obs_mean"), bias.fit_bias(rows, 8)).drop("obs_mean")


R.add(
    "bias_backoff_apply",
    _backoff,
    with_sql(*EVT, "diffs AS (SELECT *, month(valid_date) AS month, fc_mean - obs_mean AS diff FROM evt)", "a AS (SELECT region_id, variable, lead_time_days, month, avg(diff) AS b FROM diffs GROUP BY ALL HAVING count(*) >= 8)", "b AS (SELECT region_id, variable, month, avg(diff) AS b FROM diffs GROUP BY ALL HAVING count(*) >= 8)", "c AS (SELECT region_id, variable, avg(diff) AS b FROM diffs GROUP BY ALL HAVING count(*) >= 8)")
    + """SELECT region_id, init_date, valid_date, lead_time_days, variable, fc_mean, coalesce(a.b, b.b, c.b) AS bias, fc_mean - coalesce(a.b, b.b, c.b) AS corrected, abs(fc_mean - coalesce(a.b, b.b, c.b) - obs_mean) AS corrected_err
FROM diffs LEFT JOIN a USING (region_id, variable, lead_time_days, month) LEFT JOIN b USING (region_id, variable, month) LEFT JOIN c USING (region_id, variable)""",
    ("fc_mean", "bias", "corrected", "corrected_err"),
    10,
)
R.add("event_rows", lambda s, d: event_rows(s, d).select(*EVENT, "variable", "fc_mean", "obs_mean", "pred_err", "spread", "n_rows", "actual_err"), with_sql(*EVT) + "SELECT region_id, init_date, valid_date, lead_time_days, variable, fc_mean, obs_mean, pred_err, spread, n_rows, actual_err FROM evt", ("fc_mean", "obs_mean", "pred_err", "spread", "actual_err"))
WIDE = [f"{c}_{v}" for v in VARIABLES for c in ("pred_err", "spread")]
R.add(
    "event_pivot",
    lambda s, d: events.pivot(event_rows(s, d), VARIABLES, ["pred_err", "spread"]),
    with_sql(*EVT) + "SELECT region_id, init_date, valid_date, lead_time_days, " + ", ".join(f"avg(CASE WHEN variable = '{v}' THEN {c} END) AS {c}_{v}" for v in VARIABLES for c in ("pred_err", "spread")) + " FROM evt GROUP BY ALL",
    tuple(WIDE),
)


def _row_stats(s: SparkSession, d: str) -> DataFrame:
    wide = events.pivot(event_rows(s, d), VARIABLES, ["pred_err"])
    mean, most = events.across([F.col(f"pred_err_{v}") for v in VARIABLES])
    return wide.select(*EVENT, mean.alias("mean_err"), most.alias("most_err"))


R.add("row_mean_max", _row_stats, with_sql(*EVT) + "SELECT region_id, init_date, valid_date, lead_time_days, avg(pred_err) AS mean_err, max(pred_err) AS most_err FROM evt GROUP BY ALL", ("mean_err", "most_err"))
R.add("p90_thresholds", lambda s, d: cuts(event_rows(s, d)), with_sql(*EVT, THRESHOLDS) + "SELECT variable, bust_threshold FROM thr", ("bust_threshold",))
R.add("member_p90", lambda s, d: events.thresholds(paired(s, d), "abs_error", 0.9, "member_p90"), with_sql(*EVT, THRESHOLDS) + "SELECT variable, member_p90 FROM p90", ("member_p90",))
R.add("bust_label", labelled, with_sql(*ALL) + "SELECT region_id, init_date, valid_date, lead_time_days, bust_ratio, y_bust FROM labelled", ("bust_ratio",))
R.add(
    "confidence",
    lambda s, d: event_rows(s, d).join(F.broadcast(events.thresholds(paired(s, d), "abs_error", 0.9, "member_p90")), "variable").select(*EVENT, "variable", events.confidence(F.col("pred_err"), F.col("member_p90")).alias("confidence")),
    with_sql(*EVT, THRESHOLDS) + "SELECT region_id, init_date, valid_date, lead_time_days, variable, greatest(0.0, least(1.0, 1.0 - pred_err / member_p90)) AS confidence FROM evt JOIN p90 USING (variable)",
    ("confidence",),
)


def _dominant(s: SparkSession, d: str) -> DataFrame:
    rows = event_rows(s, d)
    return events.dominant(rows, cuts(rows))


R.add("dominant_variable", _dominant, with_sql(*EVT, THRESHOLDS) + "SELECT region_id, init_date, valid_date, lead_time_days, ratio AS top_ratio, variable AS dominant_variable FROM (SELECT *, pred_err / bust_threshold AS ratio, row_number() OVER (PARTITION BY region_id, init_date, valid_date, lead_time_days ORDER BY pred_err / bust_threshold DESC, variable) AS k FROM evt JOIN thr USING (variable) WHERE bust_threshold > 0) WHERE k = 1", ("top_ratio",))


def _frequency(s: SparkSession, d: str) -> DataFrame:
    rows = paired(s, d)
    return events.bust_frequency(rows, events.thresholds(rows, "abs_error", 0.75, "cut"), events.season_of(F.col("valid_date")))


R.add(
    "hist_bust_frequency",
    _frequency,
    with_sql(FC, OB, PAIRED) + "SELECT region_id, CASE WHEN month(valid_date) IN (12, 1, 2) THEN 'DJF' WHEN month(valid_date) IN (3, 4, 5) THEN 'MAM' WHEN month(valid_date) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END AS season, avg(CASE WHEN round(abs_error, 9) > cut THEN 1.0 ELSE 0.0 END) AS frequency, count(*) AS n_rows FROM paired JOIN (SELECT variable, round(quantile_cont(abs_error, 0.75), 9) AS cut FROM paired GROUP BY 1) USING (variable) GROUP BY ALL",
    ("frequency",),
)
CYCLES = ", c AS (SELECT init_date, row_number() OVER (ORDER BY init_date) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT init_date FROM fc))"
YEARS = "c AS (SELECT init_date, early, row_number() OVER (PARTITION BY early ORDER BY init_date) - 1 AS k, count(*) OVER (PARTITION BY early) AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS init_date, year(o_orderdate) < 1996 AS early FROM orders WHERE year(o_orderdate) <= 1996))"
SPLIT = """,
named AS (SELECT init_date, {named} AS split FROM {cycles}),
t AS (SELECT min(init_date) FILTER (split = 'test') AS t FROM named),
kept AS (SELECT init_date, split FROM named, t WHERE NOT (split = 'val' AND coalesce(init_date > t - 10, false))),
v AS (SELECT min(init_date) FILTER (split = 'val') AS v FROM kept)
SELECT init_date, split FROM kept, t, v WHERE NOT (split = 'train' AND coalesce(init_date > coalesce(v, t) - 10, false))"""


def _days(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "orders").select(F.to_date("o_orderdate").alias("init_date"))


R.add(
    "cycle_split_embargo",
    lambda s, d: events.split_cycles(forecasts(s, d)),
    with_sql(FC).rstrip()
    + CYCLES
    + SPLIT.format(cycles="c", named="CASE WHEN n < 3 OR k < greatest(1, round_even(n * 0.7, 0)) THEN 'train' WHEN k < greatest(greatest(1, round_even(n * 0.7, 0)) + 1, round_even(n * 0.85, 0)) THEN 'val' ELSE 'test' END"),
)
R.add(
    "year_split_embargo",
    lambda s, d: events.split_year(_days(s, d), 1996),
    "WITH "
    + YEARS
    + SPLIT.format(cycles="c", named="CASE WHEN NOT early THEN 'test' WHEN n < 2 OR k < least(greatest(1, round_even(n * 0.70::DOUBLE / 0.85, 0)), n - 1) THEN 'train' ELSE 'val' END"),
)


def event_frame(s: SparkSession, d: str, errors=None) -> DataFrame:
    """Every event with its predicted errors, trajectories, spreads, season, frequency, index, descriptors and label.

    Predicted errors are ``errors`` of the event rows, or else lines on the spread; either way from folds that lack the event.
    """
    pairs = written(paired(s, d))
    rows = written(events.event_rows(pairs, ANGLE))
    means = written(runs(s, d))
    p90 = events.thresholds(pairs, "abs_error", 0.9, "member_p90")
    predicted = frames.linear_out_of_fold(rows) if errors is None else frames.with_predicted(rows, errors(rows))
    full = frames.with_trajectories(predicted, trajectories.jumpiness(means, ANGLE), trajectories.lagged_pool(means, ANGLE))
    frequency = events.bust_frequency(pairs, events.thresholds(pairs, "abs_error", 0.75, "cut"), events.season_of(F.col("valid_date")))
    readings = table(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("value"))
    # the test tables' orders are years older than their events, so readings are moved next to them
    shifted = readings.select(F.date_add("date", OFFSET).alias("date"), "value")
    frame = frames.with_index(frames.with_frequency(frames.with_season(frames.wide(full, p90, VARIABLES)), frequency), shifted)
    named = frame.join(F.broadcast(table(s, d, "nation").select(F.col("n_nationkey").alias("region_id"), "n_name")), "region_id", "left")
    return named.join(events.label(rows, cuts(rows)), EVENT).select(*EVENT, *FRAMED, "month", "season", "n_name", "y_bust")


#: Days from the orders to the events, so that some runs have a fresh reading and some have none.
OFFSET = 9300
FRAMED = [*[f"{c}_{v}" for v in VARIABLES for c in ("pred_err", "conf", "spread", "jump_abs", "laf_ratio")], "spread_mean", "spread_max", "bust_frequency", "index_value", "bust_ratio"]
SEASON = "CASE WHEN month(valid_date) IN (12, 1, 2) THEN 'DJF' WHEN month(valid_date) IN (3, 4, 5) THEN 'MAM' WHEN month(valid_date) IN (6, 7, 8, 9) THEN 'JJAS' ELSE 'ON' END"
R.add(
    "event_frame",
    event_frame,
    with_sql(
        *ALL,
        RUNS,
        JUMPS,
        LAF,
        "folded AS (SELECT * EXCLUDE (pred_err), CAST((floor(datediff('day', DATE '2000-01-01', init_date) / 3) % 3 + 3) % 3 AS INTEGER) AS fold FROM evt)",
        "own AS (SELECT variable, fold, count(spread) AS n, coalesce(sum(spread), 0) AS x, coalesce(sum(actual_err) FILTER (spread IS NOT NULL), 0) AS y, coalesce(sum(spread * spread), 0) AS xx, coalesce(sum(spread * actual_err), 0) AS xy FROM folded GROUP BY ALL)",
        "rest AS (SELECT a.variable, a.fold, sum(b.n) AS n, sum(b.x) AS x, sum(b.y) AS y, sum(b.xx) AS xx, sum(b.xy) AS xy FROM own a JOIN own b ON a.variable = b.variable AND a.fold <> b.fold GROUP BY ALL HAVING sum(b.n) >= 30)",
        "pred AS (SELECT f.*, CASE WHEN n IS NOT NULL THEN greatest(0.0, y / n + coalesce((n * xy - x * y) / nullif(n * xx - x * x, 0), 0) * (coalesce(spread, x / n) - x / n)) END AS pred_err FROM folded f LEFT JOIN rest USING (variable, fold))",
        "ratios AS (SELECT *, CASE WHEN n_members < 2 THEN NULL WHEN len(p) = 0 THEN 1.0 WHEN spread = 0 THEN NULL ELSE laf_std / spread END AS laf_ratio FROM dev)",
        "full_rows AS (SELECT e.*, greatest(0.0, least(1.0, 1.0 - pred_err / member_p90)) AS conf, j.jump_abs, r.laf_ratio FROM pred e JOIN p90 USING (variable) LEFT JOIN jumps j USING (region_id, variable, valid_date, init_date) LEFT JOIN ratios r USING (region_id, variable, valid_date, init_date))",
        f"freq AS (SELECT region_id, {SEASON} AS season, avg(CASE WHEN round(abs_error, 9) > cut THEN 1.0 ELSE 0.0 END) AS bust_frequency FROM paired JOIN (SELECT variable, round(quantile_cont(abs_error, 0.75), 9) AS cut FROM paired GROUP BY 1) USING (variable) GROUP BY ALL)",
        f"readings AS (SELECT CAST(o_orderdate AS DATE) + {OFFSET} AS day, avg(o_totalprice) AS value FROM orders GROUP BY 1)",
        "wide AS (SELECT region_id, init_date, valid_date, lead_time_days, " + ", ".join(f"avg(CASE WHEN variable = '{v}' THEN {c} END) AS {c}_{v}" for v in VARIABLES for c in ("pred_err", "conf", "spread", "jump_abs", "laf_ratio")) + ", avg(spread) AS spread_mean, max(spread) AS spread_max FROM full_rows GROUP BY ALL)",
        "dated AS (SELECT i.init_date, CASE WHEN datediff('day', r.day, i.init_date) <= 5 THEN value END AS index_value FROM (SELECT DISTINCT init_date FROM wide) i ASOF LEFT JOIN readings r ON i.init_date >= r.day)",
    )
    + f"SELECT w.*, CAST(month(valid_date) AS INTEGER) AS month, {SEASON} AS season, bust_frequency, index_value, n_name, bust_ratio, y_bust FROM wide w JOIN labelled USING (region_id, init_date, valid_date, lead_time_days) LEFT JOIN freq ON freq.region_id = w.region_id AND freq.season = {SEASON} LEFT JOIN dated USING (init_date) LEFT JOIN nation ON n_nationkey = w.region_id",
    tuple(FRAMED),
)
MEMBER = ["region_id", "init_date", "member"]
R.add(
    "rates_to_all_variables",
    lambda s, d: trajectories.rates_to_all(_one_member(s, d), MEMBER, ["click", "view"]).select(*MEMBER, "variable", "valid_date", "lead_time_days", "rate_click", "rate_view"),
    with_sql(FC, ONE, "r AS (SELECT *, CASE WHEN datediff('day', lag(valid_date) OVER w, valid_date) > 0 THEN (forecast_value - lag(forecast_value) OVER w) / datediff('day', lag(valid_date) OVER w, valid_date) END AS rate FROM one WHERE variable IN ('click', 'view') WINDOW w AS (PARTITION BY region_id, init_date, member, variable ORDER BY valid_date))", "x AS (SELECT region_id, init_date, member, valid_date, avg(CASE WHEN variable = 'click' THEN rate END) AS rate_click, avg(CASE WHEN variable = 'view' THEN rate END) AS rate_view FROM r GROUP BY ALL)")
    + "SELECT region_id, init_date, member, variable, valid_date, lead_time_days, rate_click, rate_view FROM one LEFT JOIN x USING (region_id, init_date, member, valid_date)",
    ("rate_click", "rate_view"),
)
R.add(
    "concurrent_columns",
    lambda s, d: trajectories.concurrent_columns(_one_member(s, d), [*EVENT, "member"], VARIABLES).select(*EVENT, "member", "variable", *[f"concurrent_{v}" for v in VARIABLES]),
    with_sql(FC, ONE) + "SELECT region_id, init_date, valid_date, lead_time_days, member, variable, " + ", ".join(f"CASE WHEN variable <> '{v}' THEN avg(CASE WHEN variable = '{v}' THEN forecast_value END) OVER w END AS concurrent_{v}" for v in VARIABLES) + " FROM one WINDOW w AS (PARTITION BY region_id, init_date, valid_date, lead_time_days, member)",
    tuple(f"concurrent_{v}" for v in VARIABLES),
)
R.add(
    "saturated_and_excluded",
    lambda s, d: frames.drop_excluded(frames.drop_saturated(forecasts(s, d), "view", 300.0), "view", table(s, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("region_id"))).groupBy("region_id", "variable").agg(F.count(F.lit(1)).alias("n"), F.max("forecast_value").alias("most")),
    with_sql(FC) + "SELECT region_id, variable, count(*) AS n, max(forecast_value) AS most FROM fc WHERE NOT (variable = 'view' AND (forecast_value >= 300 OR region_id IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2))) GROUP BY ALL",
    ("most",),
)
