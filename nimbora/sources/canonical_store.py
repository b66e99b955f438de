"""The canonical store: batches of long rows, one folder a batch, in committed snapshots."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbora.operators.store import latest
from nimbora.sources import footers, snapshots

#: The columns of canonical rows.
SCHEMA = (
    "record_id string, source_file string, source_column string, variable string, value_type string, value double, region_id string, lat double, lon double, "
    "init_date date, valid_date date, lead_time_days int, ensemble_member_id string, verification_status string, ingested_at timestamp, grain string, batch_id string"
)

#: What makes two rows the same reading.
DEDUPE_KEY = ["region_id", "valid_date", "variable", "value_type", "init_date", "lead_time_days", "ensemble_member_id", "source_column"]

#: The order of a batch's rows, so that filters on these columns skip row groups.
ORDER = ["value_type", "init_date", "valid_date", "variable"]


def _columns(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA).schema


def conformed(rows: DataFrame) -> DataFrame:
    """``rows`` in the store's columns and types: what is missing, or no date or number, is null; others are left out."""
    have = set(rows.columns)
    return rows.select(*[(F.col(f"`{f.name}`").cast("string").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in _columns(rows.sparkSession).fields])


def _batch_name(batch_id: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch_id):
        raise ValueError(f"a batch is named by letters, digits, '_', '.' and '-': {batch_id!r}")
    return f"batch_id={batch_id}"


def _data(store: str) -> str:
    return f"{store.rstrip('/')}/data"


def append_batch(store: str, batch_id: str, rows: DataFrame) -> int:
    """Puts a batch into the store in place of one of the same id, and returns its number of rows; none for an empty one.

    The rows are written into a folder of their own, which the store's next snapshot names: a reader sees all of a batch,
    new or old, and a failure at any step leaves the old one. Each file is sorted by ORDER, nulls first.
    """
    spark = rows.sparkSession
    made = conformed(rows.withColumn("batch_id", F.lit(batch_id)))
    folder = f"{_batch_name(batch_id)}/v={snapshots.new_name()}"
    made.drop("batch_id").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER).write.parquet(f"{_data(store)}/{folder}")
    n = spark.read.parquet(f"{_data(store)}/{folder}").count()
    if n:
        snapshots.commit(spark, store, lambda found: found | {batch_id: {"rows": n, "folders": {"rows": folder}}})
    return n


def batch_ids(spark: SparkSession, store: str) -> list[str]:
    """The batches that the store holds, by name."""
    return sorted(snapshots.current(spark, store))


def batch_folders(spark: SparkSession, store: str) -> list[str]:
    """The folders of the store's batches in its newest snapshot."""
    return [f"{_data(store)}/{entry['folders']['rows']}" for _, entry in sorted(snapshots.current(spark, store).items())]


def refuse_excluded(spark: SparkSession, store: str, excluded: set[str]) -> None:
    """Raises ValueError if a batch that was set aside is in the store."""
    found = sorted(set(batch_ids(spark, store)) & excluded)
    if found:
        raise ValueError(f"batches that were set aside are in the store: {', '.join(found)}")


def _rows(spark: SparkSession, store: str, folders: list[str]) -> DataFrame:
    return spark.read.schema(f"{SCHEMA}, v string").option("basePath", _data(store)).parquet(*folders).drop("v")


def read_store(spark: SparkSession, store: str, dedupe: bool = True) -> DataFrame:
    """The rows of the store's newest snapshot, each reading once if asked for; an empty store gives no rows of the same columns."""
    folders = batch_folders(spark, store)
    if not folders:
        return spark.createDataFrame([], SCHEMA)
    rows = _rows(spark, store, folders)
    return deduped(rows) if dedupe else rows


def deduped(rows: DataFrame) -> DataFrame:
    """One row for each reading: not provisional before provisional, then the latest; by record_id where these are alike.

    Nulls are alike. Rows without a region are told apart by their coordinates.
    """
    place = F.coalesce(F.col("region_id"), F.concat_ws(",", F.coalesce(F.col("lat").cast("string"), F.lit("nan")), F.coalesce(F.col("lon").cast("string"), F.lit("nan"))))
    order: list[Column] = [F.asc(F.coalesce(F.col("verification_status") == "provisional", F.lit(False))), F.desc_nulls_last("ingested_at"), F.desc_nulls_last("record_id")]
    return latest(rows.withColumn("_region", place), ["_region", *DEDUPE_KEY[1:]], order).drop("_region")


def compact(spark: SparkSession, store: str) -> dict[str, int]:
    """Keeps one row of each reading: batches are written again, those with nothing left go. Returns the rows before and after.

    All batches change in one snapshot. One that another writer replaced meanwhile stays as that writer left it.
    """
    seen = snapshots.current(spark, store)
    before = read_store(spark, store, dedupe=False).count()
    version = snapshots.new_name()
    once = read_store(spark, store).withColumn("v", F.lit(version))
    once.repartitionByRange("batch_id", *ORDER).sortWithinPartitions("batch_id", *ORDER).write.mode("append").partitionBy("batch_id", "v").parquet(_data(store))
    there = [b for b in seen if snapshots.exists(spark, store, f"{_batch_name(b)}/v={version}")]
    counted = _rows(spark, store, [f"{_data(store)}/{_batch_name(b)}/v={version}" for b in there]) if there else once
    kept = {r["batch_id"]: r["n"] for r in counted.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a batch

    def change(found: dict[str, dict]) -> dict[str, dict]:
        mine = {k: {"rows": n, "folders": {"rows": f"{_batch_name(k)}/v={version}"}} for k, n in kept.items()}
        others = {k: v for k, v in found.items() if v != seen.get(k)}
        return {k: v for k, v in mine.items() if found.get(k) == seen.get(k)} | others

    snapshots.commit(spark, store, change)
    after = sum(kept.values())
    return {"rows_before": before, "rows_after": after, "removed": before - after, "batches": len(kept)}


def drop_batches(spark: SparkSession, store: str, retired: set[str]) -> list[str]:
    """Takes batches out of the store in one snapshot; returns those that were there."""
    gone = sorted(set(batch_ids(spark, store)) & retired)
    if gone:
        snapshots.commit(spark, store, lambda found: {k: v for k, v in found.items() if k not in retired})
    return gone


def batch_spans(spark: SparkSession, store: str) -> DataFrame:
    """batch_id, first_day, last_day, rows and bytes of each batch, from the files' footers.

    Days of a batch with a file that does not say are null, and its rows where a footer cannot be read.
    """
    files = footers.spans(spark, batch_folders(spark, store), "valid_date").withColumn("batch_id", F.regexp_extract("path", "batch_id=([^/]+)", 1))
    sure = F.min("known")
    made = files.groupBy("batch_id").agg(F.min("first_day").alias("first_day"), F.max("last_day").alias("last_day"), F.sum("rows").alias("rows"), F.sum("size").alias("bytes"), sure.alias("known"))
    return made.select("batch_id", *[F.when(F.col("known"), F.col(c)).alias(c) for c in ("first_day", "last_day")], "rows", "bytes")


def cycles(spark: SparkSession, store: str) -> DataFrame:
    """The initial dates (init_date) of the store's forecasts, from the files' footers: only forecasts have one."""
    folders = batch_folders(spark, store)
    if not folders:
        return spark.createDataFrame([], "init_date date")
    return footers.distinct_dates(spark, folders, "init_date")


def signature(spark: SparkSession, store: str) -> str:
    """A text that changes whenever the store's files do; of an empty store it is ''."""
    folders = batch_folders(spark, store)
    return footers.signature(spark, folders) if folders else ""


def retired_cycle(rows: DataFrame, init_date: str, live: str) -> bool:
    """Whether a cycle came from point forecasts: a file named like ``live`` has forecast rows whose region was not given by id."""
    mine = rows.where((F.col("value_type") == "forecast") & (F.col("init_date") == F.lit(init_date).cast("date")) & F.col("source_file").startswith(live))
    return not mine.where(F.coalesce(F.col("region_resolution_method"), F.lit("")) != "region_id").isEmpty()


def reaching_year(spans: DataFrame, year: int, before: int = 3, after: int = 13) -> DataFrame:
    """The batches whose days reach a year, from ``before`` days ahead of it to ``after`` days past it; unknown days reach all."""
    low, high = (F.expr(f"date_add(make_date({year}, {m}, {d}), {n})") for m, d, n in ((1, 1, -before), (12, 31, after)))
    apart = (F.col("last_day") < low) | (F.col("first_day") > high)
    return spans.where(~F.coalesce(apart, F.lit(False)))


def has_cycle(rows: DataFrame, init_date: str, least: int) -> bool:
    """Whether a run has at least so many forecast rows; no more than that are looked at."""
    return rows.where((F.col("value_type") == "forecast") & (F.col("init_date") == F.lit(init_date).cast("date"))).limit(least).count() >= least


def history(rows: DataFrame, first: str, days: int = 9) -> DataFrame:
    """Forecasts of the runs up to ``days`` before ``first`` that are valid from ``first`` on."""
    start = F.lit(first).cast("date")
    return rows.where((F.col("value_type") == "forecast") & (F.col("init_date") >= F.date_sub(start, days)) & (F.col("init_date") < start) & (F.col("valid_date") >= start))


def safe_text(value: Column) -> Column:
    """A text that a spreadsheet does not take for a formula: one that begins like one gets a quote before it."""
    return F.regexp_replace(value, r"^(?=[=+\-@\t\r])", "'")


def write_csv(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` as CSV files below ``path``: texts are made safe, quotes doubled, lines end in CR LF.

    Every partition is a file of its own; the header is in a file whose name comes before theirs, so that the files in
    order of their names are the table.
    """
    safe = rows.select(*[(safe_text(F.col(f"`{f.name}`")) if f.dataType.typeName() == "string" else F.col(f"`{f.name}`")).alias(f.name) for f in rows.schema.fields])
    lines = safe.select(F.to_csv(F.struct("*"), {"escape": '"'}).alias("value"))
    names = rows.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(rows.columns)]), {"escape": '"'}).alias("value")).coalesce(1)
    # the header is the first partition of the union, and partitions are files in order
    names.union(lines).write.option("lineSep", "\r\n").text(path)
