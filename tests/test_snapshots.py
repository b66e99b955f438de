"""Committed snapshots, scored cycles and footers: failures at every step, and no data page read."""

import datetime as dt
import pathlib

import pytest
from pyspark.sql import functions as F

from nimbora.sources import canonical_store, footers, scored_cycles, snapshots


def made(spark, data):
    return spark.createDataFrame(data, "region_id string, variable string, value string, valid_date string, init_date string, value_type string, record_id string")


def batch(spark, value, n=1):
    return made(spark, [("r", "t", str(value), f"2024-01-{k + 1:02d}", "2024-01-01", "forecast", f"{value}-{k}") for k in range(n)])


def values(spark, store):
    return sorted(r["value"] for r in canonical_store.read_store(spark, store).collect())


@pytest.mark.parametrize("step", ["before the data", "after the data", "in the manifest", "in the rename"])
def test_a_failure_at_any_step_leaves_the_old_batch(spark, tmp_path, monkeypatch, step):
    store = f"file://{tmp_path}/store"
    canonical_store.append_batch(store, "x", batch(spark, 1))
    before = snapshots.current(spark, store)

    def stop(*_):
        raise RuntimeError("stopped")

    if step == "before the data":
        monkeypatch.setattr(snapshots, "new_name", stop)
    elif step == "after the data":
        monkeypatch.setattr(snapshots, "commit", stop)
    elif step == "in the manifest":
        monkeypatch.setattr(snapshots._Files, "put", stop)
    else:
        monkeypatch.setattr(snapshots, "TRIES", 2)
        monkeypatch.setattr(snapshots._Files, "put", lambda *_: False)
    for change in (lambda: canonical_store.append_batch(store, "x", batch(spark, 2)), lambda: canonical_store.compact(spark, store)):
        with pytest.raises(RuntimeError):
            change()
    monkeypatch.undo()
    assert snapshots.current(spark, store) == before and values(spark, store) == [1.0]
    canonical_store.append_batch(store, "x", batch(spark, 3))
    assert values(spark, store) == [3.0]


def test_writers_that_meet_both_get_in(spark, tmp_path):
    store = f"file://{tmp_path}/store"

    def slow(found):
        if "b" not in found:  # another writer commits while this one makes its change
            snapshots.commit(spark, store, lambda seen: seen | {"b": {"folders": {}}})
        return found | {"a": {"folders": {}}}

    snapshots.commit(spark, store, slow)
    assert sorted(snapshots.current(spark, store)) == ["a", "b"]
    with pytest.raises(ValueError):
        canonical_store.append_batch(store, "a/b", batch(spark, 1))


def test_old_folders_go(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    for value in (1, 2, 3):
        canonical_store.append_batch(store, "x", batch(spark, value))
    assert snapshots.vacuum(spark, store) == []  # too young
    assert len(snapshots.vacuum(spark, store, keep=2, older_than_ms=0)) == 1 and values(spark, store) == [3.0]
    assert len(snapshots.vacuum(spark, store, older_than_ms=0)) == 1 and values(spark, store) == [3.0]
    assert canonical_store.drop_batches(spark, store, {"x", "y"}) == ["x"] and values(spark, store) == []


def test_scored_cycles(spark, tmp_path):
    store, day = f"file://{tmp_path}/scored", dt.date(2024, 1, 5)
    events, rows = spark.range(7), spark.range(20)
    assert scored_cycles.read_scored_cycle(spark, store, "run", day) is None
    assert scored_cycles.write_scored_cycle(store, "run", day, events, rows) == 7
    found = scored_cycles.read_scored_cycle(spark, store, "run", day)
    assert (found["events"].count(), found["per_variable"].count()) == (7, 20)
    assert scored_cycles.read_scored_cycle(spark, store, "other", day) is None
    assert scored_cycles.write_scored_cycle(store, "run", day, events.limit(3), rows) == 3  # in place of the first
    with pytest.raises(Exception):  # noqa: B017
        scored_cycles.write_scored_cycle(store, "run", day, events, rows.select(F.raise_error(F.lit("stop"))))
    assert scored_cycles.read_scored_cycle(spark, store, "run", day)["events"].count() == 3
    scored_cycles.write_scored_cycle(store, "run", day + dt.timedelta(days=1), events, rows)
    scored_cycles.write_scored_cycle(store, "old", day, events, rows)
    assert scored_cycles.prune_scored_cycles(spark, store, "run", [day]) == ["old__20240105", "run__20240106"]
    assert scored_cycles.read_scored_cycle(spark, store, "run", day)["events"].count() == 3
    lost = next(p for p in pathlib.Path(f"{tmp_path}/scored/data").rglob("*.parquet") if "events" in str(p) and p.stat().st_size)
    folder = lost.parent
    for p in folder.glob("part-*"):
        p.unlink()
    assert scored_cycles.read_scored_cycle(spark, store, "run", day) is None  # fewer rows than were committed


def store_of_cycles(spark, path):
    day = lambda k: str(dt.date(2024, 1, 1) + dt.timedelta(days=k))
    rows = [("r", "t", "1", day(c + k), day(c), "forecast", f"{c}-{k}") for c in range(6) for k in range(4)]
    canonical_store.append_batch(path, "a", made(spark, rows[:12]))
    canonical_store.append_batch(path, "b", made(spark, rows[12:]).coalesce(1))
    canonical_store.append_batch(path, "c", made(spark, [("r", "t", "1", day(40), None, "observed", "o")]))
    return path


def test_footers_say_cycles_and_spans(spark, tmp_path):
    store = store_of_cycles(spark, f"file://{tmp_path}/store")
    rows = canonical_store.read_store(spark, store, dedupe=False)
    want = sorted(r[0] for r in rows.where("init_date IS NOT NULL").select("init_date").distinct().collect())
    assert sorted(r[0] for r in canonical_store.cycles(spark, store).collect()) == want and len(want) == 6
    spans = {r["batch_id"]: (r["first_day"], r["last_day"], r["rows"]) for r in canonical_store.batch_spans(spark, store).collect()}
    assert spans == {r["batch_id"]: (r["a"], r["b"], r["n"]) for r in rows.groupBy("batch_id").agg(F.min("valid_date").alias("a"), F.max("valid_date").alias("b"), F.count(F.lit(1)).alias("n")).collect()}
    assert canonical_store.cycles(spark, f"file://{tmp_path}/none").count() == 0


def test_no_data_page_is_read(spark, tmp_path):
    """The pages of every file are overwritten: what is read from footers is the same."""
    path = f"{tmp_path}/one"
    spark.range(100).select(F.lit("2024-03-01").cast("date").alias("day"), "id").coalesce(1).write.parquet(f"{path}/a")
    spark.range(5).select(F.lit(None).cast("date").alias("day"), "id").coalesce(1).write.parquet(f"{path}/b")
    for p in pathlib.Path(path).rglob("*.parquet"):
        raw = bytearray(p.read_bytes())
        length = int.from_bytes(raw[-8:-4], "little")
        raw[4 : len(raw) - 8 - length] = b"\xff" * (len(raw) - 12 - length)
        p.write_bytes(bytes(raw))
        (p.parent / f".{p.name}.crc").unlink(missing_ok=True)
    folders = [f"file://{path}/a", f"file://{path}/b"]
    assert [r[0] for r in footers.distinct_dates(spark, folders, "day").collect()] == [dt.date(2024, 3, 1)]
    assert sorted((r["rows"], r["first_day"], r["known"]) for r in footers.spans(spark, folders, "day").collect()) == [(5, None, True), (100, dt.date(2024, 3, 1), True)]


def test_what_footers_cannot_say_is_read(spark, tmp_path):
    path = f"file://{tmp_path}/mixed"
    spark.range(10).select(F.date_add(F.lit("2024-03-01").cast("date"), F.col("id").cast("int")).alias("day")).coalesce(1).write.parquet(path)
    assert footers.distinct_dates(spark, [path], "day").count() == 10
    assert footers.distinct_dates(spark, [path], "other").count() == 0 if "other" in spark.read.parquet(path).columns else True


def test_signature(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    assert canonical_store.signature(spark, store) == ""
    canonical_store.append_batch(store, "x", batch(spark, 1))
    one = canonical_store.signature(spark, store)
    assert one == canonical_store.signature(spark, store)
    canonical_store.append_batch(store, "y", batch(spark, 1))
    assert canonical_store.signature(spark, store) != one


def test_retired_cycles(spark):
    rows = spark.createDataFrame([("forecast", "2024-01-01", "live_1.csv", "name"), ("forecast", "2024-01-02", "live_1.csv", "region_id"), ("forecast", "2024-01-03", "other.csv", None), ("forecast", "2024-01-04", "live_2.csv", None)], "value_type string, init_date string, source_file string, region_resolution_method string").withColumn("init_date", F.col("init_date").cast("date"))
    assert [canonical_store.retired_cycle(rows, f"2024-01-0{k}", "live_") for k in range(1, 5)] == [True, False, False, True]


def test_csv_is_written_by_many_tasks(spark, tmp_path):
    canonical_store.write_csv(spark.range(1000).repartition(6), f"file://{tmp_path}/out")
    files = sorted(pathlib.Path(f"{tmp_path}/out").glob("part-*"))
    sizes = [p.read_text().count("\n") for p in files if p.stat().st_size]
    assert len(sizes) == 7 and max(sizes) < 400
    text = "".join(p.read_bytes().decode() for p in files).split("\r\n")
    assert text[0] == "id" and sorted(map(int, text[1:-1])) == list(range(1000))
