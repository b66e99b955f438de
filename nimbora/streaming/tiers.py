"""Two tiers of late data: final observations replace provisional ones as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nimbora.operators.store import latest


def best(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key: final before provisional, then the one ingested last."""
    return latest(rows, keys, [F.asc(F.coalesce(F.col("status"), F.lit("")) == "provisional"), F.desc("ingested_at"), F.desc("value")])


def upsert(batch: DataFrame, path: str, keys: list[str], partition: str) -> None:
    """Puts a batch into the store at ``path``; only partitions that it touches are written again.

    Doing a batch twice leaves the store as it was, so a restart after a failure is safe. Rows whose partition is null
    are a partition like others. Which partitions are touched is found by a join, which prunes the scan; nothing of the
    batch comes to the driver.
    """
    spark = batch.sparkSession
    if batch.isEmpty():
        return
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    merged = batch
    if there:
        stored = spark.read.schema(batch.schema).parquet(path)
        touched = batch.select(partition).distinct()
        same = stored.join(touched.where(F.col(partition).isNotNull()), partition, "left_semi").select(*batch.columns)
        merged = batch.unionByName(same)
        if not batch.where(F.col(partition).isNull()).isEmpty():
            merged = merged.unionByName(stored.where(F.col(partition).isNull()).select(*batch.columns))
    # what replaces the partitions is on disk before any of them goes, so that a lost executor costs no rows
    side = f"{path}_staged/{uuid.uuid4().hex}"
    best(merged, keys).write.parquet(side)
    spark.read.schema(batch.schema).parquet(side).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    staged = jvm.org.apache.hadoop.fs.Path(side)
    staged.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(staged, True)


def run(spark: SparkSession, source: str, schema: str, path: str, checkpoint: str, keys: list[str], partition: str, files: int = 1_000) -> StreamingQuery:
    """Takes in all files that have come since the last run, oldest first, at most ``files`` to a batch."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    return (
        stream.writeStream.foreachBatch(lambda batch, _: upsert(batch, path, keys, partition))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def unfinished(wanted: DataFrame, done: DataFrame) -> DataFrame:
    """Cycles (init_date) still to be taken in, oldest first: those without a row in ``done``, so each is done once."""
    return wanted.select("init_date").distinct().join(done.select("init_date"), "init_date", "left_anti").orderBy("init_date")


def tier_windows(today: DataFrame, final_days: int = 5, provisional_days: int = 1) -> DataFrame:
    """For each day ``today`` the last day whose observations are final, and the last that has provisional ones."""
    return today.select("today", F.date_sub("today", final_days).alias("final_until"), F.date_sub("today", provisional_days).alias("provisional_until"))
