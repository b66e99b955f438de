"""Exact search against brute force."""

import math

import numpy as np
from pyspark.sql import functions as F

from nimbora.llm import search


def brute(rows, queries, top):
    def whole(v):
        if v is None or any(x is None or not math.isfinite(x) for x in v):
            return None
        return [math.floor(1024 * x) for x in v]

    known = [(i, w) for i, v in rows if i is not None and (w := whole(v)) is not None]
    asked = {}
    for i, v in queries:
        if (w := whole(v)) is not None:
            asked[i] = min(w, asked.get(i, w))
    out = set()
    for i, w in asked.items():
        scored = sorted((-sum(a * b for a, b in zip(w, x)), j) for j, x in known if j != i)[:top]
        out |= {(i, k, j, -s) for k, (s, j) in enumerate(scored, 1)}
    return out


def run(spark, rows, queries, **kw):
    make = lambda r: spark.createDataFrame(r, "vec_id long, embedding array<float>").withColumn("score", F.lit("clash"))
    return sorted(tuple(r) for r in search.top_neighbours(make(rows), make(queries), **kw).collect())


def test_matches_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 12))
    rows = [(i, [float(np.float32(x)) for x in centres[i % 6] * rng.uniform(0.2, 2) + rng.normal(size=12) * 0.2]) for i in range(900)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)]  # a hot vector
    rows += [(5000, None), (5001, [float("nan")] * 12), (5002, [None] + [0.0] * 11), (5003, [float("inf")] * 12), (5004, [0.0] * 12), (5005, []), (None, [1.0] * 12), rows[7]]
    queries = [r for r in rows if r[0] is not None and r[0] % 50 == 0]
    want = sorted(brute(rows, queries, 10))
    assert run(spark, rows, queries) == want
    assert run(spark, rows, queries, pivots=3, sample=40) == want


def test_rings_of_many_blocks(spark, monkeypatch):
    """One pivot and one ring hold nearly all vectors; queries meet their blocks one by one."""
    monkeypatch.setattr(search, "BLOCK", 16)
    monkeypatch.setattr(search, "QUERIES", 4)
    rng = np.random.default_rng(5)
    rows = [(i, [float(np.float32(x)) for x in 1 + 0.01 * rng.normal(size=6)]) for i in range(700)]
    queries = [r for r in rows if r[0] % 20 == 0]
    assert run(spark, rows, queries, sample=64) == sorted(brute(rows, queries, 10))


def test_an_id_with_several_vectors(spark):
    rows = [(i, [float(i % 7), float(i % 5)]) for i in range(60)] + [(3, [9.0, 9.0]), (3, [-1.0, 2.0]), (3, [9.0, 9.0])]
    queries = [(3, [9.0, 9.0]), (3, [-1.0, 2.0]), (20, [6.0, 0.0])]
    assert run(spark, rows, queries) == sorted(brute(rows, queries, 10))


def test_few_and_none(spark):
    rows = [(i, [float(i), 1.0]) for i in range(4)]
    assert run(spark, rows, rows) == sorted(brute(rows, rows, 10))
    assert run(spark, [], []) == []
    assert run(spark, rows, []) == []
    same = [(i, [0.5, 0.5]) for i in range(30)]
    assert run(spark, same, same[:2]) == sorted(brute(same, same[:2], 10))
