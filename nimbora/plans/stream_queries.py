"""Streaming queries, run over files until all have been taken in."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.ordered import shared_folder
from nimbora.plans.registry import Registry
from nimbora.plans.views import FC, forecasts, table, with_sql
from nimbora.streaming import tiers

R = Registry()

KEYS = ["region_id", "variable", "valid_date"]


def _upsert(s: SparkSession, d: str) -> DataFrame:
    """Provisional means of some members come first; final means of all members replace them for two days in three."""
    base = f"{shared_folder(s)}/nimbora-{uuid.uuid4().hex}"
    rows = forecasts(s, d)
    early = rows.where("member < 2").groupBy(*KEYS).agg(F.avg("forecast_value").alias("value")).withColumns({"status": F.lit("provisional"), "ingested_at": F.lit(1).cast("long")})
    late = rows.where("dayofmonth(valid_date) % 3 <> 0").groupBy(*KEYS).agg(F.avg("forecast_value").alias("value")).withColumns({"status": F.lit("final"), "ingested_at": F.lit(2).cast("long")})
    schema = "region_id long, variable string, valid_date date, value double, status string, ingested_at long"
    for batch in (early, late):
        batch.write.mode("append").parquet(f"{base}/in")
        tiers.run(s, f"{base}/in", schema, f"{base}/store", f"{base}/state", KEYS, "valid_date").awaitTermination()
    return s.read.schema(schema).parquet(f"{base}/store").select(*KEYS, "value", "status")


R.add(
    "streaming_tier_upsert",
    _upsert,
    with_sql(FC)
    + """, p AS (SELECT region_id, variable, valid_date, avg(forecast_value) AS v FROM fc WHERE member < 2 GROUP BY ALL),
f AS (SELECT region_id, variable, valid_date, avg(forecast_value) AS v FROM fc WHERE day(valid_date) % 3 <> 0 GROUP BY ALL)
SELECT region_id, variable, valid_date, coalesce(f.v, p.v) AS value, CASE WHEN f.v IS NULL THEN 'provisional' ELSE 'final' END AS status FROM p FULL JOIN f USING (region_id, variable, valid_date)""",
    ("value",),
)
R.add("cycles_to_do", lambda s, d: tiers.unfinished(forecasts(s, d), forecasts(s, d).where("dayofmonth(init_date) % 2 = 0")), with_sql(FC) + "SELECT DISTINCT init_date FROM fc WHERE day(init_date) % 2 <> 0")
R.add(
    "latency_windows",
    lambda s, d: tiers.tier_windows(table(s, d, "orders").select(F.to_date("o_orderdate").alias("today")).distinct()),
    "SELECT DISTINCT CAST(o_orderdate AS DATE) AS today, CAST(CAST(o_orderdate AS DATE) - 5 AS DATE) AS final_until, CAST(CAST(o_orderdate AS DATE) - 1 AS DATE) AS provisional_until FROM orders",
)
