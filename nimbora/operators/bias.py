"""Forecast bias by region, variable, lead and month, with a way back to coarser cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a cell needs.
LEAST_ROWS = 30


def fit_bias(events: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """Mean of forecast minus observation (fc_mean, obs_mean) in three levels: with lead and month, with month, by itself.

    A coarser level has lead_time_days -1 and, at the last, month -1. Cells of fewer than ``least`` rows are left out.
    """
    e = events.select("region_id", "variable", F.col("lead_time_days").alias("lead"), F.month("valid_date").alias("month"), (F.col("fc_mean") - F.col("obs_mean")).alias("diff"))
    levels = e.groupingSets(
        [["region_id", "variable", "lead", "month"], ["region_id", "variable", "month"], ["region_id", "variable"]],
        "region_id",
        "variable",
        "lead",
        "month",
    ).agg(F.sum("diff").alias("s"), F.count("diff").alias("n"))
    return levels.where(F.col("n") >= least).select(
        "region_id", "variable", F.coalesce("lead", F.lit(-1)).alias("lead_time_days"), F.coalesce("month", F.lit(-1)).alias("month"), (F.col("s") / F.col("n")).alias("bias"), "n"
    )


def apply_bias(events: DataFrame, table: DataFrame) -> DataFrame:
    """Adds bias, of the finest cell that has one, corrected and corrected_err, its distance from obs_mean (null where no cell has one)."""
    keyed = events.withColumn("_month", F.month("valid_date"))
    for k, (lead, month) in enumerate([(F.col("lead_time_days"), F.col("_month")), (F.lit(-1), F.col("_month")), (F.lit(-1), F.lit(-1))]):
        level = table.select(F.col("region_id").alias(f"_r{k}"), F.col("variable").alias(f"_v{k}"), F.col("lead_time_days").alias(f"_l{k}"), F.col("month").alias(f"_m{k}"), F.col("bias").alias(f"_b{k}"))
        keyed = keyed.join(level, (F.col("region_id") == F.col(f"_r{k}")) & (F.col("variable") == F.col(f"_v{k}")) & (lead == F.col(f"_l{k}")) & (month == F.col(f"_m{k}")), "left")
    made = keyed.withColumn("bias", F.coalesce("_b0", "_b1", "_b2"))
    return made.select(*events.columns, "bias", (F.col("fc_mean") - F.col("bias")).alias("corrected"), F.abs(F.col("fc_mean") - F.col("bias") - F.col("obs_mean")).alias("corrected_err"))
