"""Quantiles by rank, the isotonic fit by hulls and the bootstrap over pairs of cycles, against plain Python."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from nimbora.operators import scores
from nimbora.operators.quantiles import quantiles


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_quantiles_of_groups(spark, many_ranges):
    """One group holds nearly all rows, one is a single row, one has ties, one no value at all."""
    rng = random.Random(1)
    data = [("big", rng.gauss(0, 1)) for _ in range(3000)] + [("one", 5.0)] + [("tied", 2.0)] * 9 + [("tied", 3.0)] + [("none", None), (None, 1.0), (None, 2.0)]
    rows = spark.createDataFrame(data, "g string, x double")
    shares = {"least": 0.0, "q10": 0.1, "mid": 0.5, "q90": 0.9, "most": 1.0}
    out = {r["g"]: r for r in quantiles(rows, F.col("x"), shares, ["g"], "n").collect()}
    assert set(out) == {"big", "one", "tied", None}
    for g, r in out.items():
        values = [x for h, x in data if h == g]
        assert r["n"] == len(values)
        for name, share in shares.items():
            assert math.isclose(r[name], np.quantile(values, share), rel_tol=1e-12, abs_tol=1e-12)


def test_quantiles_of_a_whole_table(spark, many_ranges):
    rows = spark.createDataFrame([(float(i % 100),) for i in range(1000)] + [(None,)], "x double")
    assert tuple(quantiles(rows, F.col("x"), {"a": 0.25, "b": 0.9}).first()) == (24.75, pytest.approx(np.quantile([i % 100 for i in range(1000)], 0.9)))
    assert tuple(quantiles(rows.limit(0), F.col("x"), {"a": 0.5}, count="n").first()) == (None, 0)


def test_no_task_holds_the_largest_group(spark, many_ranges):
    """All rows are one group: they are dealt into ranges, none of which has more than its share."""
    from nimbora.operators import ordered

    rows = spark.range(20_000).select(F.lit("g").alias("g"), F.xxhash64("id").cast("double").alias("x"))
    dealt = ordered.by_ranges(rows.groupBy("g", "x").count(), [F.col("g"), F.col("x")])
    sizes = [r["count"] for r in dealt.groupBy("_range").count().collect()]
    assert len(sizes) == 7 and max(sizes) < 2 * 20_000 / 7


def pav(data):
    blocks = []
    for p in sorted({p for p, _ in data}):
        ys = [y for q, y in data if q == p]
        blocks.append([sum(ys), len(ys), [p]])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, n, ps = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2] + ps]
    return {p: a / n for a, n, ps in blocks for p in ps}


@pytest.mark.parametrize("kind", ["noise", "rising", "falling", "one pool over most ranges", "convex"])
def test_isotonic_fit(spark, many_ranges, monkeypatch, kind):
    """Also with few corners looked at in a round, so that several rounds are needed."""
    monkeypatch.setattr(scores, "CORNERS", 6)
    rng = random.Random(kind)
    n = 900
    chance = {"noise": lambda x: 0.4, "rising": lambda x: x, "falling": lambda x: 1 - x, "one pool over most ranges": lambda x: 0.95 if x < 0.2 else 0.1 + 0.8 * x, "convex": lambda x: x * x}[kind]
    data = [(i / n, int(rng.random() < chance(i / n))) for i in range(n) for _ in range(2)]
    out = scores.pooled_adjacent(spark.createDataFrame(data, "p double, y int")).collect()
    want = pav(data)
    assert len(out) == len(want) and all(abs(r["fitted"] - want[r["p"]]) < 1e-12 for r in out)


def area(rows):
    pos, neg = ([p for p, y in rows if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))


def test_bootstrap_equals_resampled_rows(spark, many_ranges):
    rng = random.Random(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=3 * k) for k in range(17)]
    data = [(day, round(rng.random(), 1), int(rng.random() < 0.4)) for day in days for _ in range(rng.randint(1, 12))]
    rows = spark.createDataFrame(data, "init_date date, p double, y int")
    out = {r["draw"]: r["auc"] for r in scores.bootstrap_areas(rows, draws=40, block=8, seed=5).collect()}
    assert len(out) == 40
    n, block = 17, 3  # a block of 8 is more than a fifth of 17 cycles
    for draw in range(40):
        drawn = []
        for b in range(-(-n // block)):
            start = scores.draw_starts(draw, b, 5) % n
            drawn += [(start + j) % n for j in range(block)][: n - b * block]
        assert len(drawn) == n
        resampled = [(p, y) for k in drawn for day, p, y in data if day == days[k]]
        assert abs(out[draw] - area(resampled)) < 1e-12


def test_bootstrap_of_one_cycle_is_a_point(spark):
    data = [(dt.date(2024, 1, 1), p, y) for p, y in ((0.1, 0), (0.4, 1), (0.3, 0), (0.2, 1))]
    found = scores.block_bootstrap(spark.createDataFrame(data, "init_date date, p double, y int"), draws=10).first()
    assert found["low"] == found["high"] == area([(p, y) for _, p, y in data]) and found["draws"] == 10
    one_class = scores.block_bootstrap(spark.createDataFrame([(d, p, 1) for d, p, _ in data], "init_date date, p double, y int"), draws=10).first()
    assert tuple(one_class) == (None, None, 0)
