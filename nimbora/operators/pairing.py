"""Pairing of forecasts with observations, and what each member's forecast missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.functions.circular import deviation, heading, separation

KEYS = ["region_id", "variable", "valid_date"]


def observed_means(observations: DataFrame) -> DataFrame:
    """One observed value for each region, variable and day."""
    return observations.groupBy(*KEYS).agg(F.avg("observed_value").alias("observed_value"), F.count(F.lit(1)).alias("n_obs"))


def error_of(forecast: Column, observed: Column, angle: Column) -> Column:
    """Absolute error; the smaller angle where the variable is one."""
    return F.when(angle, separation(forecast, observed)).otherwise(F.abs(forecast - observed))


def pair(forecasts: DataFrame, observations: DataFrame, angle: str, how: str = "inner") -> DataFrame:
    """Each forecast with the observed mean of its region, variable and day, and its absolute error."""
    paired = forecasts.join(observed_means(observations).drop("n_obs"), KEYS, how)
    return paired.withColumn("abs_error", error_of(F.col("forecast_value"), F.col("observed_value"), F.col("variable") == angle))


def drop_implausible(rows: DataFrame, ranges: dict[str, tuple[float, float]], value: str = "forecast_value") -> DataFrame:
    """Drops values outside their variable's inclusive range; null values and unknown variables pass."""
    wrong = F.lit(False)
    for variable, (low, high) in ranges.items():
        wrong = wrong | ((F.col("variable") == variable) & ~F.col(value).between(low, high))
    return rows.where(~F.coalesce(wrong, F.lit(False)))


def drop_beyond_lead(rows: DataFrame, caps: dict[str, int]) -> DataFrame:
    """Drops forecasts farther ahead than their variable's archive reaches."""
    beyond = F.lit(False)
    for variable, cap in caps.items():
        beyond = beyond | ((F.col("variable") == variable) & (F.col("lead_time_days") > cap))
    return rows.where(~beyond)


def ensemble(forecasts: DataFrame, angle: str, keys: list[str]) -> DataFrame:
    """Mean, spread and number of members; circular where the variable is an angle, spread null below two members.

    ``east`` and ``north`` are the mean sine and cosine, from which angles are pooled further.
    """
    turn = F.radians("forecast_value")
    east, north = F.avg(F.sin(turn)), F.avg(F.cos(turn))
    is_angle, n = F.col("variable") == angle, F.count("forecast_value")
    return forecasts.groupBy(*keys).agg(
        n.alias("n_members"),
        F.when(is_angle, heading(east, north)).otherwise(F.avg("forecast_value")).alias("fc_mean"),
        F.when(n < 2, None).when(is_angle, deviation(F.sqrt(east * east + north * north))).otherwise(F.stddev_samp("forecast_value")).alias("spread"),
        east.alias("east"),
        north.alias("north"),
    )
