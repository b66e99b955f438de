"""Region look-ups, bucket covers, released cycles, pruned neighbours and predicted errors against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nimbora.operators import buckets, frames, ingest, models, neighbours, regions, soil
from nimbora.streaming import release

RING = "region_id string, ring array<struct<x:double,y:double>>"


def polygons(seed, n=7):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        cx, cy, corners = rng.uniform(-3, 3), rng.uniform(-3, 3), rng.randint(3, 9)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(corners))
        out.append((f"r{k}", [(cx + rng.uniform(0.3, 1.4) * math.cos(a), cy + rng.uniform(0.3, 1.4) * math.sin(a)) for a in angles]))
    return out


def holds(x, y, ring):
    odd = False
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[(k + 1) % len(ring)]
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def apart(x, y, ring):
    best = math.inf
    for k, (ax, ay) in enumerate(ring):
        bx, by = ring[(k + 1) % len(ring)]
        dx, dy = bx - ax, by - ay
        t = max(0.0, min(1.0, ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(ax + t * dx - x, ay + t * dy - y))
    return best


def test_cover_and_points(spark):
    shapes = polygons(1)
    rings = spark.createDataFrame(shapes, RING)
    covered = regions.cover(rings, 0.25)
    rng = random.Random(2)
    points = [(k, rng.uniform(-5, 5), rng.uniform(-5, 5)) for k in range(1500)]
    out = {r["point_id"]: r["region_id"] for r in regions.points_in_regions(spark.createDataFrame(points, "point_id int, x double, y double"), covered, 0.25).collect()}
    want = {k: min(r for r, ring in shapes if holds(x, y, ring)) for k, x, y in points if any(holds(x, y, ring) for _, ring in shapes)}
    assert out == want and len(want) > 100
    cells = covered.groupBy("border").count().collect()
    assert {r["border"] for r in cells} == {True, False}
    near = {r["point_id"]: (r["region_id"], r["apart"]) for r in regions.nearest_region(spark.createDataFrame([p for p in points if p[0] not in want], "point_id int, x double, y double"), rings).collect()}
    for k, x, y in points:
        if k not in want:
            d, r = min((apart(x, y, ring), r) for r, ring in shapes)
            assert (near.get(k) is None) == (d > 1.5) and (d > 1.5 or (near[k][0] == r and abs(near[k][1] - d) < 1e-9))


def test_the_chain(spark):
    registry = spark.createDataFrame([("1", "North Town", "Alpha"), ("2", "South Town", "Alpha"), ("3", "North Town", "Beta")], "region_id string, name string, state string")
    states = spark.createDataFrame([("S1", "Alpha"), ("S2", "Beta")], "region_id string, name string")
    rings = spark.createDataFrame([("1", [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)])], RING)
    asked = [
        (1, "2", None, 0.5, 0.5), (2, "south-town", None, 9.0, 9.0), (3, "North Town", "beta", 0.5, 0.5), (4, "North Town", None, 0.5, 0.5), (5, "north town", None, None, None),
        (6, "ALPHA", None, 0.5, 0.5), (7, "alpha", None, None, 0.5), (8, "S2", None, 50.0, 0.0), (9, None, None, 1.5, 0.5), (10, None, None, 3.0, 3.0), (11, "nowhere", "Alpha", None, None), (12, "", None, 0.2, 0.2),
    ]
    out = {r["row_id"]: (r["region_id"], r["method"]) for r in regions.look_up(spark.createDataFrame(asked, "row_id int, name string, state string, x double, y double"), registry, states, rings).collect()}
    assert out == {
        1: ("2", "region_id"), 2: ("2", "name"), 3: ("3", "name"), 4: ("1", "point_in_polygon"), 5: (None, None), 6: ("1", "point_in_polygon"), 7: ("S1", "state_name"), 8: ("S2", "state_name"),
        9: ("1", "nearest_polygon"), 10: (None, None), 11: (None, None), 12: ("1", "point_in_polygon"),
    }


def test_exact_covers(spark):
    days = {
        "six hours": [(0, 6), (6, 12), (12, 18), (18, 24)],
        "widest first": [(0, 3), (0, 6), (3, 6), (6, 24), (6, 9)],
        "gap": [(0, 6), (9, 24)],
        "overlap": [(0, 6), (3, 12), (6, 12), (12, 24)],
        "dead end": [(0, 12), (0, 6), (6, 24)],
        "ties": [(0, 24), (0, 24)],
        "beyond": [(0, 12), (12, 30), (12, 24), (-6, 0)],
        "nothing wide": [(0, 0), (0, 24)],
        "not the start": [(3, 24)],
    }
    rows = [(d, a, b, k) for d, all_ in days.items() for k, (a, b) in enumerate(all_)]
    out = {}
    for r in buckets.exact_cover(spark.createDataFrame(rows, "day string, start_hour int, end_hour int, bucket_id long"), ["day"], F.lit(0), F.lit(24)).orderBy("day", "place").collect():
        out.setdefault(r["day"], []).append((r["start_hour"], r["end_hour"], r["bucket_id"]))
    assert out == {
        "six hours": [(0, 6, 0), (6, 12, 1), (12, 18, 2), (18, 24, 3)], "widest first": [(0, 6, 1), (6, 24, 3)], "overlap": [(0, 6, 0), (6, 12, 2), (12, 24, 3)],
        "ties": [(0, 24, 0)], "beyond": [(0, 12, 0), (12, 24, 2)], "nothing wide": [(0, 24, 1)],
    }


def test_cycles_are_released_once(spark, tmp_path):
    """Late, repeated, foreign and missing parts, with a restart between every two lots of files."""
    base, schema = f"file://{tmp_path}", "cycle string, step int, variable string"
    lots = [
        [("a", 1, "t"), ("a", 2, "t"), ("b", 1, "t"), ("a", 1, "t")],
        [("a", 1, "r"), ("a", 9, "r"), (None, 1, "t"), ("b", 1, None)],
        [("a", 2, "r"), ("a", 2, "r")],  # a is whole
        [("a", 1, "t"), ("c", 1, "t"), ("c", 2, "t"), ("c", 1, "r"), ("c", 2, "r")],  # a again, c at once; b has waited too long
        [("b", 2, "t"), ("b", 1, "r"), ("b", 2, "r"), ("a", 2, "t")],  # b after all
    ]
    told = []
    for lot in lots:
        spark.createDataFrame(lot, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        release.run(spark, f"{base}/in", schema, f"{base}/out", f"{base}/state", [1, 2], ["t", "r"], patience_ms=1).awaitTermination()
        found = sorted((r["cycle"], r["status"], r["parts"]) for r in spark.read.schema(release.RELEASED).parquet(f"{base}/out").collect())
        told.append([x for x in found if x not in (told and sum(told, []) or [])])
    whole = [x for lot in told for x in lot if x[1] == "whole"]
    assert sorted(whole) == [("a", "whole", 4), ("b", "whole", 4), ("c", "whole", 4)]
    assert ("a", "whole", 4) in told[2] and ("c", "whole", 4) in told[3] and ("b", "whole", 4) in told[4]
    assert ("b", "missing", 1) in [x for lot in told for x in lot]


def test_neighbours_pass_over_far_leaves(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LEAF", 32)
    rng = np.random.default_rng(3)
    data = [(i, [float(x) for x in rng.normal(size=3)], int(rng.integers(0, 2))) for i in range(3000)]
    best, opened = neighbours.nearest_rows(spark.createDataFrame(data, "id long, v array<double>, label long"), F.col("id") % 20 == 0, 10)
    m = np.array([v for _, v, _ in data])
    out = {}
    for r in best.collect():
        out.setdefault(r["query_id"], {})[r["r"]] = r["id"]
    for q in range(0, 3000, 20):
        far = ((m - m[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        assert [out[q][k] for k in range(1, 11)] == np.lexsort((np.arange(3000), far))[:10].tolist()
    share = opened.first()
    assert share["pairs"] == 3000 * 150 and share["opened"] / share["pairs"] < 0.35


def test_predicted_errors_come_from_other_folds(spark):
    """An error that stands out in one fold does not show in that fold's own predictions."""
    rng = random.Random(6)
    rows = []
    for k in range(120):
        day = dt.date(2024, 1, 1) + dt.timedelta(days=k % 60)
        for v in ("t", "r"):
            spread = rng.random() if k % 9 else None
            fold = ((day - dt.date(2000, 1, 1)).days // 3) % 3
            rows.append((k, day, day, 1, v, 100.0 if fold == 1 else 2.0 + (spread or 0.5), spread))
    made = spark.createDataFrame(rows, "region_id int, init_date date, valid_date date, lead_time_days int, variable string, actual_err double, spread double")
    for out in (frames.linear_out_of_fold(made), models.predicted_errors(made, ["t", "r"], ["spread"], embargo=0)):
        found = out.select("init_date", "pred_err").collect()
        assert len(found) == len(rows) and all(r["pred_err"] is not None and r["pred_err"] >= 0 for r in found)
        own = [r["pred_err"] for r in found if ((r["init_date"] - dt.date(2000, 1, 1)).days // 3) % 3 == 1]
        assert max(own) < 10
    few = frames.linear_out_of_fold(made.limit(20)).collect()
    assert all(r["pred_err"] is None for r in few)
    kept = frames.with_predicted(made, frames.linear_out_of_fold(made).limit(5))
    assert kept.count() == len(rows) and kept.where("pred_err IS NOT NULL").count() == 5


def test_soil_mask_and_gate(spark):
    fields = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.2), ("b", 1.0), ("c", float("nan")), ("c", None)], "cell string, value double")
    sea = {r["cell"]: r["sea"] for r in soil.sea_cells(fields).collect()}
    assert sea == {"a": True, "b": False, "c": False}
    cells = spark.createDataFrame([("a", "R", 1.0, 1.0), ("b", "R", 3.0, 0.1), ("d", "Q", 1.0, 1.0)], "cell string, region_id string, weight double, land double")
    out = {r["region_id"]: (r["sea_share"], r["water_share"], r["excluded"]) for r in soil.excluded_regions(soil.sea_cells(fields), cells, 0.2).collect()}
    assert out == {"R": (0.25, 0.75, True), "Q": (0.0, 0.0, False)}
    rows = spark.createDataFrame([("1", "x"), ("50", None), ("150", "")], "a string, b string")
    out = {(r["column"], r["variable"]): (r["share"], r["plausible"]) for r in ingest.range_scores(rows, ["a", "b"], {"share": (0, 100)}).collect()}
    assert out == {("a", "share"): (pytest.approx(2 / 3), True), ("b", "share"): (None, True)}
    values = spark.createDataFrame([(1.0,), (float("inf"),), (float("-inf"),), (float("nan"),), (None,)], "x double").select(ingest.finite(F.col("x")).alias("x"))
    assert [r["x"] for r in values.collect()] == [1.0, None, None, None, None]


def test_visits_are_given_out_in_bounded_parts():
    """A batch of queries that must look into all leaves gives many small tables with every visit once."""
    leaves, n = 500, 400
    low, high = np.zeros((leaves, 2)), np.ones((leaves, 2))
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array([[0.5, 0.5]] * n), pa.array([k % leaves for k in range(n)]), pa.array([1.0] * n)], names=["id", "v", "leaf", "bound"]
    )
    parts = list(neighbours._visits(low, high, np.arange(leaves))(iter([batch])))
    assert max(p.num_rows for p in parts) < 20_000 + leaves
    found = [(i, x) for p in parts for i, x in zip(p.column("id").to_pylist(), p.column("leaf").to_pylist())]
    assert sorted(found) == [(i, x) for i in range(n) for x in range(leaves) if x != i]


def test_batches_of_neighbours_are_bounded(spark):
    data = [(i, [float(i % 7), float(i % 5)], 0) for i in range(40)]
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = [spark.conf.get(c) for c in names]
    try:
        for c, value in zip(names, ("10000", str(256 << 20))):
            spark.conf.set(c, value)
        neighbours.nearest_rows(spark.createDataFrame(data, "id long, v array<double>, label long"), F.lit(True), 3)
        assert [int(spark.conf.get(c).rstrip("b")) <= most for c, most in zip(names, (1_000, 16 << 20))] == [True, True]
    finally:
        for c, value in zip(names, before):
            spark.conf.set(c, value)


def test_rows_ruled_out_by_inner_products_are_not_near():
    rng = np.random.default_rng(4)
    for scale in (1.0, 1e-7, 1e6):
        known = np.round(rng.normal(size=(300, 3)), 1) * scale  # many ties
        known[5], known[6, 0] = np.inf, np.nan
        queries = known[:40]
        for q, kept in zip(queries, neighbours._near(known, queries, 7)):
            far = np.round(((known - q) ** 2).sum(axis=1), neighbours.PLACES)
            first = np.lexsort((np.arange(300), far))[:8]
            assert set(first[np.isfinite(far[first])].tolist()) <= set(kept.tolist())
