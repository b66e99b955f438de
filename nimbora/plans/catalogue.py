"""Registry of the forecast-verification queries and their reference SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.plans import forecast_queries

#: Modules that register queries.
MODULES = ["forecast_queries", "score_queries", "serving_queries", "replay_queries", "store_queries", "model_queries", "stream_queries", "source_queries", "reduction_queries", "algorithm_queries"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rate of badly wrong forecasts by region and lead."""
    made = forecast_queries.labelled(spark, sf_dir)
    return made.groupBy("region_id", "lead_time_days").agg(F.round(F.avg("y_bust"), 8).alias("bust_rate"), F.count(F.lit(1)).alias("n_events"))


def _registries() -> list:
    return [importlib.import_module(f"nimbora.plans.{m}").R for m in MODULES]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Name to query."""
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {"bust_rate_by_lead": flagship}
    for r in _registries():
        found.update(r.queries)
    return found


def oracle_sql() -> dict[str, str]:
    """Name to DuckDB SQL."""
    found: dict[str, str] = {"bust_rate_by_lead": forecast_queries.with_sql(*forecast_queries.ALL) + "SELECT region_id, lead_time_days, round(avg(y_bust), 8) AS bust_rate, count(*) AS n_events FROM labelled GROUP BY ALL"}
    for r in _registries():
        found.update(r.sql)
    return found
