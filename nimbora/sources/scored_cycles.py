"""Scored cycles: the events and per-variable rows of one run and initial date, committed together."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from nimbora.sources import snapshots


def _name(run_id: str, init_date: dt.date) -> str:
    return f"{run_id}__{init_date:%Y%m%d}"


def write_scored_cycle(store: str, run_id: str, init_date: dt.date, events: DataFrame, per_variable: DataFrame) -> int:
    """Writes both tables and then commits them with their numbers of rows; returns the number of events.

    A cycle of the same run and date is replaced at once; one that fails part-way is not to be seen.
    """
    spark = events.sparkSession
    short = snapshots.new_name()
    folder = f"{store.rstrip('/')}/data/{short}"
    counts = {}
    for name, rows in (("events", events), ("per_variable", per_variable)):
        rows.write.parquet(f"{folder}/{name}")
        counts[name] = spark.read.parquet(f"{folder}/{name}").count()
    entry = {"run_id": run_id, "init_date": str(init_date), "counts": counts, "folders": {name: f"{short}/{name}" for name in counts}}
    snapshots.commit(spark, store, lambda found: found | {_name(run_id, init_date): entry})
    return counts["events"]


def read_scored_cycle(spark: SparkSession, store: str, run_id: str, init_date: dt.date) -> dict[str, DataFrame] | None:
    """The tables ``events`` and ``per_variable`` of a cycle; None if there is none, or its rows are not as many as were committed."""
    entry = snapshots.current(spark, store).get(_name(run_id, init_date))
    if entry is None or entry["run_id"] != run_id:
        return None
    tables = {}
    for name, folder in entry["folders"].items():
        try:
            rows = spark.read.parquet(f"{store.rstrip('/')}/data/{folder}")
            whole = rows.count() == entry["counts"][name]
        except Exception:  # noqa: BLE001 - an unreadable table is a miss
            return None
        if not whole:
            return None
        tables[name] = rows
    return tables


def prune_scored_cycles(spark: SparkSession, store: str, run_id: str, keep: list[dt.date], older_than_ms: int = 0) -> list[str]:
    """Drops all cycles but those of ``run_id`` and the dates ``keep``; returns the names of what was dropped."""
    kept = {_name(run_id, d) for d in keep}
    dropped = sorted(set(snapshots.current(spark, store)) - kept)
    if dropped:
        snapshots.commit(spark, store, lambda found: {k: v for k, v in found.items() if k in kept})
        snapshots.vacuum(spark, store, older_than_ms=older_than_ms)
    return dropped
