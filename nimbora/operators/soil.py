"""Which regions a model's soil says nothing about, because it holds sea there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sea_cells(fields: DataFrame, saturated: float = 0.995, always: float = 0.95) -> DataFrame:
    """cell and sea: whether a cell of ``fields`` (cell, init_date, value) is saturated in at least the share ``always`` of its known values.

    Null and NaN values do not count; a cell without any known value is no sea.
    """
    known = F.when(~F.isnan("value"), F.col("value"))
    share = F.avg(F.when(known.isNotNull(), (known >= saturated).cast("double")))
    return fields.groupBy("cell").agg(F.coalesce(share >= always, F.lit(False)).alias("sea"))


def excluded_regions(sea: DataFrame, cells: DataFrame, most: float) -> DataFrame:
    """Of each region the weight share of sea cells and of water cells, and whether the sea share is above ``most``.

    ``cells`` has cell, region_id, weight and land (a share; below a half is water). Only the sea share decides; the
    water share is told beside it. Cells without a row in ``sea`` are no sea.
    """
    met = cells.join(sea, "cell", "left")
    share = lambda wet: F.try_divide(F.sum(F.when(wet, F.col("weight")).otherwise(0.0)), F.sum("weight"))
    made = met.groupBy("region_id").agg(share(F.coalesce(F.col("sea"), F.lit(False))).alias("sea_share"), share(F.col("land") < 0.5).alias("water_share"))
    return made.withColumn("excluded", F.col("sea_share") > most)
