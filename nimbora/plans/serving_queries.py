"""Queries that answer requests from scored events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import serving
from nimbora.operators.ordered import written
from nimbora.plans.forecast_queries import cuts, event_rows
from nimbora.plans.registry import Registry
from nimbora.plans.score_queries import S, scored
from nimbora.plans.views import FC, forecasts, with_sql

R = Registry()
HOT = ["medium", "high"]
KEY = "region_id, init_date, valid_date, lead_time_days"

R.add("regions_by_lead", lambda s, d: scored(s, d).where("lead_time_days = 3"), with_sql(*S) + f"SELECT {KEY}, y, p, band FROM scored WHERE lead_time_days = 3")
R.add("alerts_topk", lambda s, d: serving.alerts(scored(s, d), HOT, 50), with_sql(*S) + f"SELECT {KEY}, y, p, band FROM scored WHERE band IN ('medium', 'high') ORDER BY p DESC, region_id, init_date, lead_time_days LIMIT 50")
R.add(
    "alerts_by_region",
    lambda s, d: serving.alerts_by_region(scored(s, d), HOT),
    with_sql(*S) + "SELECT region_id, p, init_date, lead_time_days, n AS n_alerts FROM (SELECT *, count(*) OVER (PARTITION BY region_id) AS n, row_number() OVER (PARTITION BY region_id ORDER BY p DESC, init_date DESC, lead_time_days DESC) AS k FROM scored WHERE band IN ('medium', 'high')) WHERE k = 1",
)
R.add("alert_totals", lambda s, d: scored(s, d).where(F.col("band").isin(HOT)).groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("region_id").alias("regions")), with_sql(*S) + "SELECT band, count(*) AS n, count(DISTINCT region_id) AS regions FROM scored WHERE band IN ('medium', 'high') GROUP BY 1")
R.add("national_risk", lambda s, d: serving.national(scored(s, d), ["lead_time_days"]), with_sql(*S) + "SELECT lead_time_days, avg(p) AS mean_p, min(p) AS least_p, max(p) AS most_p, count(DISTINCT region_id) AS regions, count(*) FILTER (band = 'high') AS n_high FROM scored GROUP BY 1", ("mean_p",))
R.add("first_crossing", lambda s, d: serving.first_crossing(scored(s, d), 0.4), with_sql(*S) + "SELECT region_id, init_date, min(CASE WHEN p >= 0.4 THEN lead_time_days END) AS first_lead, max(p) AS peak FROM scored GROUP BY ALL")
R.add(
    "prior_cycle_delta",
    lambda s, d: serving.prior_run(scored(s, d)),
    with_sql(*S, "r AS (SELECT region_id, init_date, avg(p) AS mean_p FROM scored GROUP BY ALL)", "l AS (SELECT *, CASE WHEN datediff('day', lag(init_date) OVER w, init_date) <= 7 THEN lag(mean_p) OVER w END AS prior_p FROM r WINDOW w AS (PARTITION BY region_id ORDER BY init_date))") + "SELECT *, mean_p - prior_p AS change FROM l",
    ("mean_p", "prior_p", "change"),
)
R.add("lead_step_deltas", lambda s, d: serving.lead_steps(scored(s, d)), with_sql(*S) + "SELECT region_id, init_date, lead_time_days, p, p - lag(p) OVER (PARTITION BY region_id, init_date ORDER BY lead_time_days) AS step FROM scored", ("step",))
R.add(
    "replay_cycle_summary",
    lambda s, d: serving.run_summary(scored(s, d)),
    with_sql(*S) + "SELECT init_date, max(p) AS peak, avg(CASE WHEN lead_time_days >= 4 THEN p END) - avg(CASE WHEN lead_time_days < 4 THEN p END) AS growth, count(DISTINCT lead_time_days) AS leads, count(DISTINCT region_id) AS regions FROM scored GROUP BY 1",
    ("growth",),
)


def _order(s: SparkSession, d: str) -> DataFrame:
    runs = serving.run_summary(scored(s, d))
    best = runs.agg(F.max("regions").alias("best"))
    tier = F.bround(F.col("regions") / F.col("best") / 0.1).cast("int")
    return runs.crossJoin(F.broadcast(best)).select("init_date", tier.alias("tier"), "leads", "peak").orderBy(F.desc("tier"), F.desc("leads"), F.desc("peak"), F.desc("init_date")).limit(10)


R.add("replay_order", _order, with_sql(*S, "r AS (SELECT init_date, max(p) AS peak, count(DISTINCT lead_time_days) AS leads, count(DISTINCT region_id) AS regions FROM scored GROUP BY 1)") + "SELECT init_date, CAST(round_even(regions / (SELECT max(regions) FROM r) / 0.1::DOUBLE, 0) AS INTEGER) AS tier, leads, peak FROM r ORDER BY 2 DESC, 3 DESC, 4 DESC, 1 DESC LIMIT 10")
R.add(
    "worst_misses",
    lambda s, d: serving.worst_misses(scored(s, d), 15),
    with_sql(*S) + "(SELECT region_id, init_date, lead_time_days, p, y, 'missed' AS kind FROM scored WHERE y = 1 ORDER BY p, region_id, init_date, lead_time_days LIMIT 15) UNION ALL (SELECT region_id, init_date, lead_time_days, p, y, 'false alarm' FROM scored WHERE y = 0 ORDER BY p DESC, region_id, init_date, lead_time_days LIMIT 15)",
)
R.add(
    "kpi_strip",
    lambda s, d: scored(s, d).agg(F.avg("p").alias("mean_p"), F.count(F.when(F.col("band") == "high", 1)).alias("n_high"), F.max("p").alias("peak"), ((F.avg(F.when(F.col("lead_time_days") == 10, 1 - F.col("p"))) - F.avg(F.when(F.col("lead_time_days") == 1, 1 - F.col("p")))) / F.avg(F.when(F.col("lead_time_days") == 1, 1 - F.col("p"))) * 100).alias("decay")),
    with_sql(*S) + "SELECT avg(p) AS mean_p, count(*) FILTER (band = 'high') AS n_high, max(p) AS peak, (avg(CASE WHEN lead_time_days = 10 THEN 1 - p END) - avg(CASE WHEN lead_time_days = 1 THEN 1 - p END)) / avg(CASE WHEN lead_time_days = 1 THEN 1 - p END) * 100 AS decay FROM scored",
    ("mean_p", "decay"),
)
R.add(
    "drift_per_week",
    lambda s, d: event_rows(s, d).groupBy(F.weekofyear("valid_date").alias("week"), "variable").agg(F.avg(F.col("fc_mean") - F.col("obs_mean")).alias("mean_err"), F.sqrt(F.avg((F.col("fc_mean") - F.col("obs_mean")) ** 2)).alias("rmse"), F.count(F.lit(1)).alias("n")),
    with_sql(*S) + "SELECT CAST(week(valid_date) AS INTEGER) AS week, variable, avg(fc_mean - obs_mean) AS mean_err, sqrt(avg((fc_mean - obs_mean) ** 2)) AS rmse, count(*) AS n FROM evt GROUP BY ALL",
    ("mean_err", "rmse"),
)
R.add(
    "product_agreement",
    lambda s, d: serving.agreement(event_rows(s, d), ["variable"], "fc_mean", "obs_mean"),
    with_sql(*S) + "SELECT variable, count(*) AS n, avg(fc_mean - obs_mean) AS bias, avg(abs(fc_mean - obs_mean)) AS mae, sqrt(avg((fc_mean - obs_mean) ** 2)) AS rmse, corr(fc_mean, obs_mean) AS pearson FROM evt GROUP BY 1",
    ("bias", "mae", "rmse", "pearson"),
)


def _against(s: SparkSession, d: str) -> DataFrame:
    rows = written(event_rows(s, d).select("variable", "fc_mean", "obs_mean", "actual_err"))
    return serving.against_threshold(serving.agreement(rows, ["variable"], "fc_mean", "obs_mean"), cuts(rows))


R.add(
    "agreement_of_threshold",
    _against,
    with_sql(*S, "a AS (SELECT variable, count(*) AS n, avg(fc_mean - obs_mean) AS bias, avg(abs(fc_mean - obs_mean)) AS mae, sqrt(avg((fc_mean - obs_mean) ** 2)) AS rmse, corr(fc_mean, obs_mean) AS pearson FROM evt GROUP BY 1)") + "SELECT *, CASE WHEN bust_threshold > 0 THEN 100 * mae / bust_threshold END AS mae_pct_of_threshold FROM a LEFT JOIN thr USING (variable)",
    ("bias", "mae", "rmse", "pearson", "mae_pct_of_threshold"),
)


def _detail(s: SparkSession, d: str) -> DataFrame:
    nested = written(serving.detail(scored(s, d), event_rows(s, d)))
    curves = nested.groupBy("region_id").agg(F.sum(F.size("curve")).alias("n_curve"))
    series = nested.select("region_id", "init_date", F.explode("series").alias("v"))
    points = series.groupBy("region_id", F.col("v.variable").alias("variable")).agg(F.sum(F.size("v.points")).alias("n_points"), F.min("init_date").alias("first_run"))
    return points.join(curves, "region_id")


R.add("nested_region_detail", _detail, with_sql(*S) + "SELECT e.region_id, c.n_curve, variable, count(*) AS n_points, min(init_date) AS first_run FROM evt e JOIN (SELECT region_id, count(*) AS n_curve FROM scored GROUP BY 1) c ON c.region_id = e.region_id GROUP BY ALL")


def _traces(s: SparkSession, d: str) -> DataFrame:
    return forecasts(s, d).groupBy("region_id", "variable", "init_date", "member").agg(F.count(F.lit(1)).alias("n"), F.avg("forecast_value").alias("level")).withColumn("is_control", F.col("member") == 0)


R.add("member_traces", _traces, with_sql(FC) + "SELECT region_id, variable, init_date, member, count(*) AS n, avg(forecast_value) AS level, member = 0 AS is_control FROM fc GROUP BY ALL", ("level",))


def _subject(s: SparkSession, d: str) -> DataFrame:
    """The series whose spread grows most from its early to its late leads."""
    from pyspark.sql import Window

    rows = event_rows(s, d).where("spread IS NOT NULL").groupBy("region_id", "variable", "lead_time_days").agg(F.avg("spread").alias("spread"))
    w = Window.partitionBy("region_id", "variable")
    placed = rows.withColumns({"n": F.count(F.lit(1)).over(w), "k": F.row_number().over(w.orderBy("lead_time_days"))})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    made = placed.where("n >= 3").groupBy("region_id", "variable").agg(F.avg(F.when(F.col("k") <= third, F.col("spread"))).alias("early"), F.avg(F.when(F.col("k") > F.col("n") - third, F.col("spread"))).alias("late"))
    return made.withColumn("gain", F.col("late") - F.col("early"))


R.add(
    "subject_pick",
    _subject,
    with_sql(*S, "l AS (SELECT region_id, variable, lead_time_days, avg(spread) AS spread FROM evt WHERE spread IS NOT NULL GROUP BY ALL)", "k AS (SELECT *, count(*) OVER (PARTITION BY region_id, variable) AS n, row_number() OVER (PARTITION BY region_id, variable ORDER BY lead_time_days) AS k FROM l)") + "SELECT region_id, variable, avg(CASE WHEN k <= greatest(1, n // 3) THEN spread END) AS early, avg(CASE WHEN k > n - greatest(1, n // 3) THEN spread END) AS late, avg(CASE WHEN k > n - greatest(1, n // 3) THEN spread END) - avg(CASE WHEN k <= greatest(1, n // 3) THEN spread END) AS gain FROM k WHERE n >= 3 GROUP BY ALL",
    ("early", "late", "gain"),
)
