"""Exact search over tables whose rows repeat."""

import numpy as np

from tests.llm.test_search import brute, run


def vectors(n, width=8, seed=3):
    rng = np.random.default_rng(seed)
    return [(i, [float(np.float32(x)) for x in rng.normal(size=width)]) for i in range(n)]


def test_every_row_repeats(spark):
    once = vectors(120)
    queries = [r for r in once if r[0] % 10 == 0]
    for times in (3, 10, 12):
        want = sorted(brute(once * times, queries, 10))
        assert run(spark, once * times, queries * 2) == want
        assert run(spark, once * times, queries, pivots=3, sample=40) == want


def test_copies_of_one_row_near_queries(spark):
    once = vectors(200, seed=4)
    hot = (1000, [2 * x for x in once[0][1]])
    near = [(1001 + i, [x * (1.5 + i / 100) for x in once[0][1]]) for i in range(12)]
    rows = once + near + [hot] * 30
    queries = [once[0], near[3], hot]
    assert run(spark, rows, queries) == sorted(brute(rows, queries, 10))
