"""Exact cover of a span of hours by buckets (accumulation windows)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PICKED = "array<struct<start:int,end:int,bucket_id:bigint>>"


def exact_cover(buckets: DataFrame, by: list[str], low: Column, high: Column) -> DataFrame:
    """For each group the buckets that tile its hours from ``low`` to ``high``: by, covered, start_hour, end_hour, bucket_id, place.

    ``buckets`` has the columns ``by``, start_hour, end_hour (whole hours) and bucket_id. From each hour the widest bucket that starts there
    and ends within the span leads on (the smallest id of several); it is followed from the span's start. Where the end
    is not met exactly, by a gap or because the widest buckets lead past it, the group has no rows. ``low`` and ``high``
    are made of ``by``. A group keeps one bucket for each start hour, so it is as small as the span.
    """
    inside = buckets.where((F.col("start_hour") >= low) & (F.col("end_hour") <= high) & (F.col("end_hour") > F.col("start_hour")))
    widest = F.max_by(F.struct(F.col("end_hour").cast("int").alias("end"), F.col("bucket_id").cast("long").alias("bucket_id")), F.struct("end_hour", -F.col("bucket_id")))
    next_ = inside.groupBy(*by, "start_hour").agg(widest.alias("next"))
    leads = next_.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct(F.col("start_hour").cast("int").alias("start"), "next"))).alias("leads"))
    none = F.array().cast(PICKED)

    def follow(acc: Column, hour: Column) -> Column:
        found = F.try_element_at(F.col("leads"), hour)
        here = (acc["at"] == hour) & found.isNotNull()
        step = F.array(F.struct(hour.alias("start"), found["end"].alias("end"), found["bucket_id"].alias("bucket_id")))
        return F.struct(F.when(here, found["end"]).otherwise(acc["at"]).alias("at"), F.when(here, F.concat(acc["picked"], step)).otherwise(acc["picked"]).alias("picked"))

    start = F.struct(low.cast("int").alias("at"), none.alias("picked"))
    run = leads.withColumn("_run", F.aggregate(F.sequence(low.cast("int"), high.cast("int") - 1), start, follow))
    whole = run.where(F.col("_run.at") == high.cast("int"))
    return whole.select(*by, F.posexplode("_run.picked").alias("place", "b")).select(*by, "place", F.col("b.start").alias("start_hour"), F.col("b.end").alias("end_hour"), F.col("b.bucket_id").alias("bucket_id"))
