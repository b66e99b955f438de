"""Queries on reductions in time, grids and areas. Hours, cells and members are laid out over the nations' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators import areas, frames, reductions, serving
from nimbora.plans.forecast_queries import EVT, cuts, event_rows, paired
from nimbora.plans.registry import Registry
from nimbora.plans.score_queries import S, scored
from nimbora.plans.views import ANGLE, EVENT, FC, OB, PAIRED, THRESHOLDS, VARIABLES, forecasts, table, with_sql

R = Registry()

#: Hours that are laid out.
HOURS = 96


def hourly(s: SparkSession, d: str) -> DataFrame:
    """Hourly stamps of a cell a nation; every fifth cell lacks an hour, every fourth has no soil."""
    n = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("cell"), F.explode(F.sequence(F.lit(1), F.lit(HOURS))).alias("h"))
    cell, h = F.col("cell"), F.col("h")
    t = 280 + (h * 7 + cell * 3) % 23
    return n.where(~((cell % 5 == 0) & (h == 31))).select(
        "cell", F.timestamp_add("HOUR", h, F.lit("2024-01-01").cast("timestamp")).alias("time"), t.cast("double").alias("t"), (t - 1.5 - cell % 5).cast("double").alias("td"), (95000.0 + (h * 13 + cell) % 800).alias("sp"),
        ((h + cell) % 9 - 4.5).cast("double").alias("u"), ((h * 3 + cell) % 7 - 3.25).cast("double").alias("v"), ((h * cell) % 5 / 10000).cast("double").alias("rain"), F.when(cell % 4 != 0, (h % 10) / 20).cast("double").alias("soil"),
    )


HOURLY = f"""hourly AS (SELECT n_nationkey::BIGINT AS cell, h, TIMESTAMP '2024-01-01' + h * INTERVAL 1 HOUR AS time, (280 + (h * 7 + n_nationkey * 3) % 23)::DOUBLE AS t, (280 + (h * 7 + n_nationkey * 3) % 23 - 1.5 - n_nationkey % 5)::DOUBLE AS td,
  (95000 + (h * 13 + n_nationkey) % 800)::DOUBLE AS sp, ((h + n_nationkey) % 9 - 4.5)::DOUBLE AS u, ((h * 3 + n_nationkey) % 7 - 3.25)::DOUBLE AS v, (h * n_nationkey) % 5 / 10000 AS rain, CASE WHEN n_nationkey % 4 <> 0 THEN (h % 10) / 20 END AS soil
  FROM nation, range(1, {HOURS + 1}) r(h) WHERE NOT (n_nationkey % 5 = 0 AND h = 31)),
timed AS (SELECT *, CAST(time - INTERVAL 1 HOUR AS DATE) AS day, 611.2 * exp(17.67 * (td - 273.15) / (td - 29.65)) AS e, 611.2 * exp(17.67 * (t - 273.15) / (t - 29.65)) AS es FROM hourly)"""
R.add(
    "hourly_to_daily",
    lambda s, d: reductions.daily(hourly(s, d), ["cell"]),
    with_sql(HOURLY) + "SELECT cell, day, avg(t) - 273.15 AS t_c, avg(greatest(0, least(100, 100 * e / es))) AS rh, sum(rain) * 1000 AS rain_mm, avg(sp) / 100 AS sp_hpa, sqrt(avg(u) ** 2 + avg(v) ** 2) AS speed, ((270 - degrees(atan2(avg(v), avg(u)))) % 360 + 360) % 360 AS direction FROM timed GROUP BY ALL HAVING count(*) = 24",
    ("t_c", "rh", "rain_mm", "sp_hpa", "speed", "direction"),
    6,
)
CELL_DAYS = """q AS (SELECT *, 0.622 * e / (sp - 0.378 * e) AS qq, hour(time) % 3 = 0 AS i FROM timed),
cell_days AS (SELECT cell, day, avg(t) FILTER (i) AS t, avg(qq) FILTER (i) AS q, avg(sp) FILTER (i) AS sp, avg(u) FILTER (i) AS u, avg(v) FILTER (i) AS v, CASE WHEN count(soil) FILTER (i) = 8 THEN avg(soil) FILTER (i) END AS soil, sum(rain) * 1000 AS rain_mm FROM q GROUP BY ALL HAVING count(*) = 24)"""
PARTS = ("t", "q", "sp", "u", "v", "soil", "rain_mm")
R.add("hourly_to_cells", lambda s, d: reductions.cells_daily(hourly(s, d), ["cell"]), with_sql(HOURLY, CELL_DAYS) + "SELECT * FROM cell_days", PARTS, 7)


def _weights(s: SparkSession, d: str) -> DataFrame:
    n = table(s, d, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("cell"), F.col("n_regionkey").alias("region_id"), (F.col("n_nationkey") % 3 + 0.5).alias("weight"), (F.col("n_nationkey") % 6 / 5).alias("land"))


REGION_DAYS = """met AS (SELECT c.*, n_regionkey AS region_id, n_nationkey % 3 + 0.5::DOUBLE AS w, n_nationkey % 6 / 5 >= 0.5 AS land FROM cell_days c JOIN nation ON n_nationkey = cell),
m AS (SELECT region_id, day, sum(w * t) / sum(w) AS t, sum(w * q) / sum(w) AS q, sum(w * sp) / sum(w) AS sp, sum(w * u) / sum(w) AS u, sum(w * v) / sum(w) AS v, sum(w * rain_mm) / sum(w) AS rain_mm,
  sum(w * soil) FILTER (land AND soil IS NOT NULL) / sum(w) FILTER (land AND soil IS NOT NULL) AS soil, bool_or(land AND soil IS NULL) AS gap FROM met GROUP BY ALL)
SELECT region_id, day, t - 273.15 AS t_c, greatest(0, least(100, 100 * (q * sp / (0.622 + 0.378 * q)) / (611.2 * exp(17.67 * (t - 273.15) / (t - 29.65))))) AS rh, rain_mm, sqrt(u * u + v * v) AS speed, ((270 - degrees(atan2(v, u))) % 360 + 360) % 360 AS direction, {soil} AS soil_pct FROM m"""
VALUES = tuple(reductions.NEEDS)
R.add("cells_to_regions", lambda s, d: reductions.regions_daily(reductions.cells_daily(hourly(s, d), ["cell"]), _weights(s, d)), with_sql(HOURLY, CELL_DAYS, REGION_DAYS.format(soil="soil * 100")), VALUES, 6)
R.add("regions_without_gaps", lambda s, d: reductions.regions_daily(reductions.cells_daily(hourly(s, d), ["cell"]), _weights(s, d), void_gaps=True), with_sql(HOURLY, CELL_DAYS, REGION_DAYS.format(soil="CASE WHEN NOT gap THEN soil * 100 END")), VALUES, 6)


def _leads(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").select("event_id", F.timestamp_add("HOUR", (F.col("event_id") % 4 * 6).cast("int"), F.to_date("ts").cast("timestamp")).alias("init"), (F.col("event_id") % 80 * 3).cast("int").alias("hour"))
    day, lead = reductions.lead_day(F.col("init"), F.col("hour"))
    return e.select("event_id", day.alias("day"), lead.alias("lead"))


R.add(
    "lead_day_of_hour",
    _leads,
    "SELECT event_id, CAST(i + CAST(event_id % 80 * 3 AS INTEGER) * INTERVAL 1 HOUR - INTERVAL 1 SECOND AS DATE) AS day, CAST(datediff('day', CAST(i AS DATE), CAST(i + CAST(event_id % 80 * 3 AS INTEGER) * INTERVAL 1 HOUR - INTERVAL 1 SECOND AS DATE)) + 1 AS INTEGER) AS lead FROM (SELECT event_id, CAST(CAST(ts AS DATE) AS TIMESTAMP) + CAST(event_id % 4 * 6 AS INTEGER) * INTERVAL 1 HOUR AS i FROM events)",
)
R.add(
    "steps_by_day",
    lambda s, d: reductions.steps_by_day(table(s, d, "nation").select(F.timestamp_add("HOUR", F.col("n_nationkey").cast("int") * 6, F.lit("2024-01-01").cast("timestamp")).alias("init")), 6, 120).select(F.to_date("init").alias("day"), F.hour("init").alias("hour"), "lead", "first_hour", "last_hour", "samples", "whole"),
    "WITH i AS (SELECT TIMESTAMP '2024-01-01' + CAST(n_nationkey * 6 AS INTEGER) * INTERVAL 1 HOUR AS init FROM nation), h AS (SELECT init, CAST(hh AS INTEGER) AS hh, CAST(datediff('day', CAST(init AS DATE), CAST(init + CAST(hh AS INTEGER) * INTERVAL 1 HOUR - INTERVAL 1 SECOND AS DATE)) + 1 AS INTEGER) AS lead FROM i, range(6, 121, 6) r(hh)) SELECT CAST(init AS DATE) AS day, CAST(hour(init) AS INTEGER) AS hour, lead, min(hh) AS first_hour, max(hh) AS last_hour, count(*) AS samples, count(*) = 4 AS whole FROM h GROUP BY init, lead",
)
R.add("plane_statistics", lambda s, d: reductions.plane_statistics(forecasts(s, d), ["region_id", "valid_date", "variable"], "forecast_value"), with_sql(FC) + "SELECT region_id, valid_date, variable, avg(forecast_value) AS mean, stddev_pop(forecast_value) AS deviation, count(forecast_value) AS members FROM fc GROUP BY ALL", ("mean", "deviation"))
PLANE = "(SELECT c_nationkey / 4 AS lat, (c_nationkey % 7) / 4 + 350 AS lon, sum(c_acctbal) AS x FROM customer GROUP BY ALL)"


def _regrid(s: SparkSession, d: str) -> DataFrame:
    plane = table(s, d, "customer").groupBy((F.col("c_nationkey") / 4).alias("lat"), (F.col("c_nationkey") % 7 / 4 + 350).alias("lon")).agg(F.sum("c_acctbal").alias("x"))
    domain = table(s, d, "nation").select((F.col("n_nationkey") / 4).alias("lat"), F.explode(F.array(F.lit(-10.0), F.lit(-9.5), F.lit(350.25))).alias("lon"))
    return reductions.regrid(plane, domain, "x")


R.add("grid_regrid", _regrid, f"SELECT n_nationkey / 4 AS lat, l.lon, x FROM nation, (SELECT unnest([-10.0::DOUBLE, -9.5, 350.25]) AS lon) l LEFT JOIN {PLANE} p ON p.lat = n_nationkey / 4 AND (p.lon + 360) % 360 = (l.lon + 360) % 360", ("x",), 4)
R.add("valid_date_repair", lambda s, d: reductions.repaired_dates(forecasts(s, d).withColumn("value_type", F.when(F.col("member") < 3, "forecast").otherwise("observed"))).select("region_id", "init_date", "member", "valid_date", reductions.gauge_day(F.col("valid_date")).alias("gauge_day")), with_sql(FC) + "SELECT region_id, init_date, member, CASE WHEN member < 3 THEN valid_date - 1 ELSE valid_date END AS valid_date, CASE WHEN member < 3 THEN valid_date - 2 ELSE valid_date - 1 END AS gauge_day FROM fc")


def _assembled(s: SparkSession, d: str) -> DataFrame:
    rows = forecasts(s, d).withColumnRenamed("forecast_value", "value")
    return reductions.assembled({v: rows.where(F.col("variable") == v) for v in ("click", "view")}, [*EVENT, "member"])


R.add("outer_assembly", _assembled, with_sql(FC) + "SELECT * FROM (SELECT region_id, init_date, valid_date, lead_time_days, member, avg(forecast_value) AS click FROM fc WHERE variable = 'click' GROUP BY ALL) FULL JOIN (SELECT region_id, init_date, valid_date, lead_time_days, member, avg(forecast_value) AS view FROM fc WHERE variable = 'view' GROUP BY ALL) USING (region_id, init_date, valid_date, lead_time_days, member)", ("click", "view"))


def _lagged(s: SparkSession, d: str) -> DataFrame:
    rows = forecasts(s, d)
    side = lambda v: rows.where(F.col("variable") == v).groupBy("region_id", F.col("valid_date").alias("day")).agg(F.avg("forecast_value").alias("value"))
    return reductions.lagged_agreement(side("click"), side("view"), [-1, 0, 1], 10)


R.add(
    "lagged_agreement",
    _lagged,
    with_sql(FC, "a AS (SELECT region_id, valid_date AS day, avg(forecast_value) AS x FROM fc WHERE variable = 'click' GROUP BY ALL)", "b AS (SELECT region_id, valid_date AS day, avg(forecast_value) AS y FROM fc WHERE variable = 'view' GROUP BY ALL)", "p AS (SELECT lag, a.region_id, x, y FROM a CROSS JOIN (SELECT unnest([-1, 0, 1]) AS lag) JOIN b ON b.region_id = a.region_id AND b.day = a.day + lag)", "r AS (SELECT lag, region_id, rank() OVER (PARTITION BY lag, region_id ORDER BY x) + (count(*) OVER (PARTITION BY lag, region_id, x) - 1) / 2 AS u, rank() OVER (PARTITION BY lag, region_id ORDER BY y) + (count(*) OVER (PARTITION BY lag, region_id, y) - 1) / 2 AS v FROM p)", "c AS (SELECT lag, region_id, corr(u, v) AS rho FROM r GROUP BY ALL HAVING count(*) >= 10 AND stddev_pop(u) > 0 AND stddev_pop(v) > 0)") + "SELECT lag, avg(rho) AS rho, count(*) AS regions FROM c GROUP BY 1",
    ("rho",),
)


def _rings(s: SparkSession, d: str) -> DataFrame:
    """A lozenge for each nation."""
    k = F.col("n_nationkey")
    x, y = k % 6 * 0.37, k * 0.11
    return table(s, d, "nation").select(k.alias("region_id"), F.array(*[F.struct((x + a).alias("x"), (y + b).alias("y")) for a, b in ((0.5, 0.0), (1.0, 0.5), (0.5, 1.0), (0.0, 0.5))]).alias("ring"))


R.add("cell_weights_total", lambda s, d: areas.cell_weights(_rings(s, d), 0.25).groupBy("region_id").agg(F.sum("weight").alias("weight")), "SELECT n_nationkey AS region_id, 0.5::DOUBLE AS weight FROM nation", ("weight",))
#: A lozenge x + y <= c is cut by cells whose sides are halves of its own, so that shares are known in closed form.
R.add(
    "cell_weights",
    lambda s, d: areas.cell_weights(table(s, d, "nation").select(F.col("n_nationkey").alias("region_id"), F.array(*[F.struct((F.col("n_nationkey") * 2.0 + a).alias("x"), F.lit(b).alias("y")) for a, b in ((1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 1.0))]).alias("ring")), 1.0),
    "SELECT n_nationkey AS region_id, CAST(n_nationkey * 2 + a AS INTEGER) AS ix, CAST(b AS INTEGER) AS iy, 0.5::DOUBLE AS weight FROM nation, range(2) x(a), range(2) y(b)",
    ("weight",),
)


def _weighted(s: SparkSession, d: str) -> DataFrame:
    cells = table(s, d, "customer").select((F.col("c_nationkey") / 4).alias("lat"), (F.col("c_custkey") % 3 / 4 + 359.5).alias("lon"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_acctbal")).alias("x"))
    weights = table(s, d, "nation").select((F.col("n_nationkey") / 4).alias("lat"), F.explode(F.array(F.lit(-0.5), F.lit(-0.25))).alias("lon"), F.col("n_regionkey").alias("region_id"), (F.col("n_nationkey") + 1.0).alias("weight")).where("region_id <> 4")
    return areas.weighted_regions(cells, weights, table(s, d, "region").select(F.col("r_regionkey").alias("region_id")), "x")


R.add(
    "static_weight_join",
    _weighted,
    "SELECT r_regionkey AS region_id, mean FROM region LEFT JOIN (SELECT n_regionkey, sum((n_nationkey + 1) * c_acctbal) / sum(n_nationkey + 1) AS mean FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 4 <> 0 AND c_custkey % 3 < 2 AND n_regionkey <> 4 GROUP BY 1) ON n_regionkey = r_regionkey",
    ("mean",),
    4,
)
R.add(
    "nearest_place",
    lambda s, d: areas.nearest(table(s, d, "customer").select(F.col("c_custkey").alias("point_id"), (F.col("c_custkey") % 101 / 7).alias("x"), (F.col("c_custkey") % 53 / 5).alias("y")), table(s, d, "nation").select(F.col("n_nationkey").alias("place_id"), (F.col("n_nationkey") % 5 * 2.6).alias("x"), (F.col("n_nationkey") % 7 * 1.4).alias("y"))),
    """WITH p AS (SELECT c_custkey AS point_id, c_custkey % 101 / 7 AS x, c_custkey % 53 / 5 AS y FROM customer), q AS (SELECT n_nationkey AS place_id, n_nationkey % 5 * 2.6::DOUBLE AS px, n_nationkey % 7 * 1.4::DOUBLE AS py FROM nation),
m AS (SELECT point_id, place_id, sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS apart, row_number() OVER (PARTITION BY point_id ORDER BY sqrt((x - px) * (x - px) + (y - py) * (y - py)), place_id) AS k FROM p, q WHERE sqrt((x - px) * (x - px) + (y - py) * (y - py)) <= 1.5)
SELECT p.point_id, place_id, apart FROM p LEFT JOIN (SELECT * FROM m WHERE k = 1) m ON m.point_id = p.point_id""",
    ("apart",),
)
R.add(
    "region_descriptors",
    lambda s, d: areas.descriptors(_rings(s, d)),
    "SELECT n_nationkey AS region_id, 0.5 * cos(radians(y)) * 111.195 * 111.195 AS area_km2, y AS lat, x AS lon, 111.195 * 0.5 * cos(radians(y)) / sqrt(1 + cos(radians(y)) ** 2) AS boundary_km FROM (SELECT n_nationkey, n_nationkey % 6 * 0.37::DOUBLE + 0.5 AS x, n_nationkey * 0.11::DOUBLE + 0.5 AS y FROM nation)",
    ("area_km2", "lat", "lon", "boundary_km"),
    6,
)


def _shared(s: SparkSession, d: str) -> DataFrame:
    rows = scored(s, d).select(*EVENT, "p")
    return frames.shared_events(rows, rows.withColumn("p", F.round(1 - F.col("p"), 4)), EVENT, "p")


R.add("shared_events", _shared, with_sql(*S) + "SELECT region_id, init_date, valid_date, lead_time_days, p, round(1 - p, 4) AS other_p FROM scored", ("other_p",), 4)


def _per_variable(s: SparkSession, d: str) -> DataFrame:
    pairs = paired(s, d)
    rows = event_rows(s, d)
    from nimbora.operators import events

    return serving.per_variable(rows, events.thresholds(pairs, "abs_error", 0.9, "member_p90"), cuts(rows))


R.add(
    "per_variable_table",
    _per_variable,
    with_sql(*EVT, THRESHOLDS) + "SELECT region_id, lead_time_days, variable, valid_date, avg(fc_mean) AS predicted_value, avg(obs_mean) AS observed_value, avg(pred_err) AS predicted_error, avg(spread) AS spread, max(n_rows) AS members, greatest(0.0, least(1.0, 1.0 - avg(pred_err) / any_value(member_p90))) AS confidence, any_value(bust_threshold) AS bust_threshold FROM evt JOIN p90 USING (variable) JOIN thr USING (variable) GROUP BY ALL",
    ("predicted_value", "observed_value", "predicted_error", "spread", "confidence", "bust_threshold"),
)
R.add(
    "top_factors",
    lambda s, d: serving.top_factors(event_rows(s, d), cuts(event_rows(s, d)), EVENT, 2),
    with_sql(*EVT, THRESHOLDS) + "SELECT region_id, init_date, valid_date, lead_time_days, string_agg(variable, ',' ORDER BY k) AS factors FROM (SELECT *, row_number() OVER (PARTITION BY region_id, init_date, valid_date, lead_time_days ORDER BY round(pred_err / bust_threshold, 6) DESC, variable) AS k FROM evt JOIN thr USING (variable) WHERE bust_threshold > 0) WHERE k <= 2 GROUP BY ALL",
)
R.add(
    "event_mean_error",
    lambda s, d: event_rows(s, d).groupBy(*EVENT).agg(F.avg("actual_err").alias("mean_error"), F.count("actual_err").alias("n")),
    with_sql(*EVT) + "SELECT region_id, init_date, valid_date, lead_time_days, avg(actual_err) AS mean_error, count(actual_err) AS n FROM evt GROUP BY ALL",
    ("mean_error",),
)


def _yearly(s: SparkSession, d: str) -> DataFrame:
    """Share of events any of whose variables reaches its threshold, by year and quarter."""
    rows = event_rows(s, d)
    from nimbora.operators import events

    each = rows.join(F.broadcast(cuts(rows)), "variable").groupBy(*EVENT).agg(F.max(events.bust_ratio()).alias("ratio")).where("ratio IS NOT NULL")
    return each.groupBy(F.year("valid_date").alias("year"), F.quarter("valid_date").alias("quarter")).agg(F.avg((F.col("ratio") >= 1).cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


R.add("bust_rate_per_year", _yearly, with_sql(*EVT, THRESHOLDS) + "SELECT CAST(year(valid_date) AS INTEGER) AS year, CAST(quarter(valid_date) AS INTEGER) AS quarter, avg(CASE WHEN ratio >= 1 THEN 1.0 ELSE 0.0 END) AS rate, count(*) AS n FROM (SELECT region_id, init_date, valid_date, lead_time_days, max(actual_err / bust_threshold) AS ratio FROM evt JOIN thr USING (variable) WHERE bust_threshold > 0 GROUP BY ALL) GROUP BY ALL", ("rate",))
R.add(
    "store_mae",
    lambda s, d: paired(s, d).groupBy("variable", "region_id", "init_date", "valid_date").agg(F.avg("forecast_value").alias("f"), F.avg("observed_value").alias("o")).groupBy("variable").agg(F.avg(F.abs(F.col("f") - F.col("o"))).alias("mae"), F.count(F.lit(1)).alias("n")),
    with_sql(FC, OB, PAIRED) + "SELECT variable, avg(abs(f - o)) AS mae, count(*) AS n FROM (SELECT variable, region_id, init_date, valid_date, avg(forecast_value) AS f, avg(observed_value) AS o FROM paired GROUP BY ALL) GROUP BY 1",
    ("mae",),
)


def _refreshed(s: SparkSession, d: str) -> DataFrame:
    """Forecasts whose observations are replaced by those of the first twenty days of each month."""
    rows = paired(s, d).select("region_id", "variable", "valid_date", "init_date", "member", "forecast_value", "observed_value", "abs_error")
    again = rows.where("dayofmonth(valid_date) <= 20").groupBy("region_id", "variable", "valid_date").agg(F.max("forecast_value").alias("observed_value"))
    return frames.refreshed(rows, again, ["region_id", "variable", "valid_date"]).select("region_id", "variable", "valid_date", "init_date", "member", "observed_value", "abs_error")


R.add(
    "observation_refresh",
    _refreshed,
    with_sql(FC) + "SELECT fc.region_id, fc.variable, fc.valid_date, init_date, member, o.v AS observed_value, abs(forecast_value - o.v) AS abs_error FROM fc LEFT JOIN (SELECT region_id, variable, valid_date, max(forecast_value) AS v FROM fc WHERE day(valid_date) <= 20 GROUP BY ALL) o ON o.region_id = fc.region_id AND o.variable = fc.variable AND o.valid_date = fc.valid_date",
    ("observed_value", "abs_error"),
)
ERRORS = [f"error_{v}" for v in VARIABLES]
R.add(
    "event_signed_errors",
    lambda s, d: frames.signed_errors(paired(s, d), ANGLE, VARIABLES),
    with_sql(FC, OB, PAIRED, "m AS (SELECT region_id, init_date, valid_date, lead_time_days, variable, avg(forecast_value) - avg(observed_value) AS plain, degrees(atan2(avg(sin(radians(forecast_value))), avg(cos(radians(forecast_value))))) - degrees(atan2(avg(sin(radians(observed_value))), avg(cos(radians(observed_value))))) AS turn FROM paired GROUP BY ALL)", "e AS (SELECT *, CASE WHEN variable = 'error' THEN ((turn + 180) % 360 + 360) % 360 - 180 ELSE plain END AS e FROM m)")
    + "SELECT region_id, init_date, valid_date, lead_time_days, " + ", ".join(f"avg(CASE WHEN variable = '{v}' THEN e END) AS error_{v}" for v in VARIABLES) + " FROM e GROUP BY ALL",
    tuple(ERRORS),
    6,
)
