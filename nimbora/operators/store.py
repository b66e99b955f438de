"""The long store: reading, latest-wins dedupe, appending, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row of each key: the first in ``order``; null keys are alike."""
    w = Window.partitionBy(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys]).orderBy(*order)
    return rows.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def read(rows: DataFrame, columns: list[str], equals: dict | None = None, between: dict | None = None, include_provisional: bool = True) -> DataFrame:
    """Filter and projection that reach the scan."""
    for c, v in (equals or {}).items():
        rows = rows.where(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    for c, (low, high) in (between or {}).items():
        rows = rows.where(F.col(c).between(low, high))
    if not include_provisional:
        rows = rows.where(F.coalesce(F.col("status"), F.lit("")) != "provisional")
    return rows.select(*columns)


def append(batch: DataFrame, path: str, partitions: list[str]) -> None:
    """Adds a batch to the store, one file for each partition and task."""
    batch.repartition(*partitions).write.mode("append").partitionBy(*partitions).parquet(path)


def summary(rows: DataFrame, kinds: list[str]) -> DataFrame:
    """Rows of each variable by kind (value_type), zero where none, with regions and first and last day."""
    counts = [F.count(F.when(F.col("value_type") == k, 1)).alias(f"n_{k}") for k in kinds]
    return rows.groupBy("variable").agg(*counts, F.countDistinct("region_id").alias("regions"), F.min("valid_date").alias("first_day"), F.max("valid_date").alias("last_day"))


def stratified_sample(rows: DataFrame, by: list[str], keys: list[str], n: int) -> DataFrame:
    """``n`` rows of each stratum (all, if fewer), those whose keys have the least hashes: the same rows each time."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.concat_ws("|", *keys)), *keys))
    return rows.withColumn("_place", place).where(F.col("_place") <= n).drop("_place")


def missing_keys(wanted: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of ``wanted`` without a row in ``present``."""
    return wanted.select(*keys).distinct().join(present.select(*keys), keys, "left_anti")
