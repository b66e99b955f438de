"""Analogs of every row, every pair compared, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators import baselines, neighbours
from nimbora.plans.score_queries import R

KIND = "id long, v array<double>, label long"


def test_every_row_is_asked_about(spark):
    made = R.queries["baseline_analog_knn"](spark, "/root/testdata/sf0.001")
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    totals = {r["query_id"]: r["share"] for r in made.groupBy("query_id").agg(F.sum("share").alias("share")).collect()}
    assert totals.keys() == {r["vec_id"] for r in rows.select("vec_id").collect()}
    assert all(abs(x - 1) < 1e-9 for x in totals.values())


@pytest.mark.parametrize(("block", "asked", "share"), [(2_048, 64, 64 << 20), (16, 3, 64 << 20), (16, 5, 1_000)])
def test_all_pairs_match_brute_force(spark, monkeypatch, block, asked, share):
    for name, value in (("BLOCK", block), ("ASKED", asked), ("KNOWN_BYTES", share), ("PIECE", 64)):
        monkeypatch.setattr(neighbours, name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rng = np.random.default_rng(3)
        data = [(int(i) - 20, [float(x) for x in rng.normal(size=6)], int(i) % 4) for i in rng.permutation(90)]
        data += [(200 + i, data[0][1], i % 2) for i in range(12)]  # copies: ties go to the smaller id
        m = np.array([v for _, v, _ in data])
        rows = spark.createDataFrame(data, KIND).repartition(3)
        found = neighbours.nearest_of_all(rows, F.lit(True), 9).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = set()
    for k, (i, _, _) in enumerate(data):
        near = sorted((round(float(((m[j] - m[k]) ** 2).sum()), 9), data[j][0], data[j][2]) for j in range(len(data)) if j != k)[:9]
        want |= {(i, j, label, r) for r, (_, j, label) in enumerate(near, 1)}
    assert {(r["query_id"], r["id"], r["label"], r["r"]) for r in found} == want and len(found) == len(want)


def test_fewer_rows_than_neighbours_give_all_others(spark):
    rows = spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 1), (3, [5.0, 1.0], 1)], KIND)
    made = {(r["query_id"], r["label"]): r["share"] for r in baselines.analog_votes(rows, F.lit(True), 50).collect()}
    assert made == {(1, 1): 1.0, (2, 0): 0.5, (2, 1): 0.5, (3, 0): 0.5, (3, 1): 0.5}
    assert baselines.analog_votes(rows, F.col("id") > 9, 50).count() == 0
