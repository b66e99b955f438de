"""Shapley values of boosted trees: additivity, and all subsets by brute force."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from nimbora.operators import models, shapley

COLUMNS = ["a", "b", "c", "d"]


def data(n=400):
    rng = random.Random(2)
    out = []
    for k in range(n):
        x = [rng.random() for _ in COLUMNS]
        out.append((k, k % 3, *[None if rng.random() < 0.05 else v for v in x], int(x[0] + x[1] * x[2] + rng.random() * 0.3 > 0.9), x[0] * x[1] + (x[2] > 0.5)))
    return out


@pytest.fixture(scope="module")
def fitted(spark):
    rows = spark.createDataFrame(data(), "k int, g int, a double, b double, c double, d double, y int, e double")
    return rows, models.fitted_classifier(rows, COLUMNS, trees=4, depth=3), models.fitted_regressor(rows, COLUMNS, "e", trees=3, depth=4)


def expected(leaves, x, known):
    """The value of a set of columns: the leaves' path-dependent expectation."""
    total = 0.0
    for leaf in leaves:
        part = leaf.value
        for c, share in leaf.share.items():
            part *= (leaf.low[c] < x[c] <= leaf.high[c]) if c in known else share
        total += part
    return total


@pytest.mark.parametrize("which", [1, 2])
def test_values_against_all_subsets(spark, fitted, which):
    leaves = shapley.leaves(fitted[which], spark)
    rng = np.random.default_rng(1)
    x = rng.random((6, 4))
    phi = shapley.shapley_values(leaves, x)
    for row, values in zip(x, phi):
        for i in range(4):
            others = [c for c in range(4) if c != i]
            want = 0.0
            for k in range(4):
                for known in itertools.combinations(others, k):
                    weight = math.factorial(k) * math.factorial(3 - k) / math.factorial(4)
                    want += weight * (expected(leaves, row, {*known, i}) - expected(leaves, row, set(known)))
            assert abs(values[i] - want) < 1e-9


@pytest.mark.parametrize("which", [1, 2])
def test_base_and_values_add_up_to_the_raw_score(fitted, which):
    rows, model = fitted[0], fitted[which]
    raw = vector_to_array("rawPrediction")[1] if which == 1 else F.col("prediction")
    by_model = {r["k"]: r["raw"] for r in model.transform(rows).select("k", raw.alias("raw")).collect()}
    out = shapley.attributed(model, rows, COLUMNS, ["k"]).collect()
    assert len(out) == len(by_model)
    for r in out:
        assert abs(r["base"] + sum(r["phi"]) - by_model[r["k"]]) < 1e-6 and abs(r["raw_score"] - by_model[r["k"]]) < 1e-6


def test_a_column_that_is_not_used_has_none(spark, fitted):
    rows = fitted[0].withColumn("d", F.lit(1.0))
    model = models.fitted_classifier(rows, COLUMNS, trees=3)
    assert all(r["phi"][3] == 0 for r in shapley.attributed(model, rows, COLUMNS, ["k"]).collect())


def test_means_by_group(fitted):
    rows, model, _ = fitted
    each = shapley.attributed(model, rows, COLUMNS, ["k", "g"])
    means = {(r["feature"], None if r["of_all"] else r["g"]): (r["moved"], r["n"]) for r in shapley.mean_attributions(each, COLUMNS, ["g"]).collect()}
    found = each.collect()
    for k, c in enumerate(COLUMNS):
        for g in (None, 0, 1, 2):
            values = [abs(r["phi"][k]) for r in found if g is None or r["g"] == g]
            assert means[c, g][1] == len(values) and abs(means[c, g][0] - sum(values) / len(values)) < 1e-12
