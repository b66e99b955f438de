"""How the test tables stand for forecasts and observations, in Spark and in the reference SQL.

``events`` gives a forecast for each row: users make regions, event types make variables, the event's number gives lead
and member. The variable ``error`` is scaled to an angle, so that circular paths are used.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The variable that is an angle.
ANGLE = "error"

VARIABLES = ["click", "error", "purchase", "signup", "view"]

EVENT = ["region_id", "init_date", "valid_date", "lead_time_days"]

TRAJECTORY = ["region_id", "variable", "valid_date"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member forecasts."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type", "value")
    day, back = F.to_date("ts"), (F.col("event_id") % 10).cast("int")
    return e.select(
        (F.col("user_id") % 25).alias("region_id"),
        F.col("event_type").alias("variable"),
        day.alias("valid_date"),
        (back + 1).alias("lead_time_days"),
        F.date_sub(day, back).alias("init_date"),
        (F.floor(F.col("event_id") / 10) % 5).cast("int").alias("member"),
        F.when(F.col("event_type") == ANGLE, F.col("value") * 0.72).otherwise(F.col("value")).alias("forecast_value"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw observations, several to a region, variable and day."""
    return forecasts(spark, sf_dir).select("region_id", "variable", "valid_date", F.col("forecast_value").alias("observed_value"))


FC = """fc AS (
  SELECT user_id % 25 AS region_id, event_type AS variable, CAST(ts AS DATE) AS valid_date,
    CAST(event_id % 10 AS INTEGER) + 1 AS lead_time_days, CAST(ts AS DATE) - CAST(event_id % 10 AS INTEGER) AS init_date,
    CAST((event_id // 10) % 5 AS INTEGER) AS member,
    CASE WHEN event_type = 'error' THEN value * 0.72 ELSE value END AS forecast_value
  FROM events)"""

OB = """ob AS (SELECT region_id, variable, valid_date, avg(forecast_value) AS observed_value, count(*) AS n_obs FROM fc GROUP BY ALL)"""

#: The angle between two directions, in SQL.
SEPARATION = "least(abs(a - b) % 360, 360 - abs(a - b) % 360)"

PAIRED = """paired AS (
  SELECT fc.*, ob.observed_value,
    CASE WHEN fc.variable = 'error' THEN least(abs(forecast_value - observed_value) % 360, 360 - abs(forecast_value - observed_value) % 360)
      ELSE abs(forecast_value - observed_value) END AS abs_error
  FROM fc JOIN ob USING (region_id, variable, valid_date))"""

MEMBERS = """members AS (
  SELECT region_id, init_date, valid_date, lead_time_days, variable, count(forecast_value) AS n_members,
    CASE WHEN variable = 'error' THEN ((degrees(atan2(avg(sin(radians(forecast_value))), avg(cos(radians(forecast_value))))) % 360) + 360) % 360 ELSE avg(forecast_value) END AS fc_mean,
    CASE WHEN count(forecast_value) < 2 THEN NULL WHEN variable = 'error' THEN
      degrees(sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt(avg(sin(radians(forecast_value))) ** 2 + avg(cos(radians(forecast_value))) ** 2))))))
      ELSE stddev_samp(forecast_value) END AS spread, avg(sin(radians(forecast_value))) AS east, avg(cos(radians(forecast_value))) AS north
  FROM fc GROUP BY region_id, init_date, valid_date, lead_time_days, variable)"""

EVENTS = """evt AS (
  SELECT region_id, init_date, valid_date, lead_time_days, variable, avg(forecast_value) AS fc_mean, avg(observed_value) AS obs_mean,
    round(abs(avg(forecast_value) - avg(observed_value)), 9) AS actual_err, avg(abs_error) AS pred_err,
    CASE WHEN count(forecast_value) < 2 THEN NULL WHEN variable = 'error' THEN
      degrees(sqrt(-2 * ln(greatest(1e-12, least(1.0, sqrt(avg(sin(radians(forecast_value))) ** 2 + avg(cos(radians(forecast_value))) ** 2))))))
      ELSE stddev_samp(forecast_value) END AS spread, count(*) AS n_rows
  FROM paired GROUP BY region_id, init_date, valid_date, lead_time_days, variable)"""

THRESHOLDS = """thr AS (SELECT variable, round(quantile_cont(actual_err, 0.9), 9) AS bust_threshold FROM evt GROUP BY 1),
p90 AS (SELECT variable, round(quantile_cont(abs_error, 0.9), 9) AS member_p90 FROM paired GROUP BY 1)"""

LABELLED = """labelled AS (
  SELECT region_id, init_date, valid_date, lead_time_days, max(actual_err / bust_threshold) AS bust_ratio,
    CAST(max(actual_err / bust_threshold) >= 1 AS INTEGER) AS y_bust
  FROM evt JOIN thr USING (variable) WHERE bust_threshold > 0 GROUP BY ALL)"""


def with_sql(*parts: str) -> str:
    """A WITH clause of these parts."""
    return "WITH " + ",\n".join(parts) + "\n"
