"""Shapley values of boosted trees, row by row, from the trees' node tables.

A leaf is reached by its conditions, each on one column. For a set of columns whose values are taken from the row, the
leaf counts fully where their conditions hold, and the other columns' conditions count by the share of training rows that
went that way (path-dependent expectation). That is a product of one factor for each column on the path, so a column's
Shapley value over the leaf follows from the coefficients of a polynomial with those factors: no subset is enumerated.
Rows go through in Arrow batches; the node tables, whose size the model bounds, go with the tasks.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.operators.models import Fitted
from nimbora.operators.ordered import shared_folder


@dataclass
class Leaf:
    """A leaf's value (times its tree's weight) and its conditions by column: the interval (low, high] and the share of rows."""

    value: float
    low: dict[int, float]
    high: dict[int, float]
    share: dict[int, float]


def _tree_leaves(nodes: dict[int, dict], weight: float) -> list[Leaf]:
    found: list[Leaf] = []
    todo = [(0, Leaf(0.0, {}, {}, {}))]
    while todo:
        at, path = todo.pop()
        node = nodes[at]
        if node["leftChild"] < 0:
            found.append(Leaf(weight * node["prediction"], path.low, path.high, path.share))
            continue
        if node["split"]["numCategories"] != -1:
            raise ValueError("splits on categories are not known here")
        column, bound = node["split"]["featureIndex"], node["split"]["leftCategoriesOrThreshold"][0]
        for side, child in (("left", node["leftChild"]), ("right", node["rightChild"])):
            low, high, share = dict(path.low), dict(path.high), dict(path.share)
            low.setdefault(column, -math.inf)
            high.setdefault(column, math.inf)
            if side == "left":
                high[column] = min(high[column], bound)
            else:
                low[column] = max(low[column], bound)
            share[column] = share.get(column, 1.0) * nodes[child]["rawCount"] / node["rawCount"]
            todo.append((child, Leaf(0.0, low, high, share)))
    return found


def leaves(fitted: Fitted, spark) -> list[Leaf]:
    """The leaves of a fitted ensemble of trees, as its saved node tables have them: one row a node, bounded by the model."""
    path = f"{shared_folder(spark)}/nimbora-{uuid.uuid4().hex}"
    fitted.model.write().save(path)
    trees: dict[int, dict[int, dict]] = {}
    for r in spark.read.parquet(f"{path}/data").collect():
        row = r.asDict(recursive=True)
        node = row.get("nodeData", row)
        trees.setdefault(row["treeID"], {})[node["id"]] = node
    weights = list(fitted.model.treeWeights)
    return [leaf for tree, nodes in sorted(trees.items()) for leaf in _tree_leaves(nodes, weights[tree])]


def base_value(found: list[Leaf]) -> float:
    """The expected raw score when no column is known."""
    return sum(leaf.value * math.prod(leaf.share.values()) for leaf in found)


def shapley_values(found: list[Leaf], x: np.ndarray) -> np.ndarray:
    """The Shapley value of each column for each row of ``x`` (rows by columns)."""
    made = np.zeros(x.shape)
    for leaf in found:
        columns = list(leaf.share)
        d = len(columns)
        if not d:
            continue
        met = [(x[:, c] > leaf.low[c]) & (x[:, c] <= leaf.high[c]) for c in columns]
        shares = [leaf.share[c] for c in columns]
        weights = [math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)]
        for i, c in enumerate(columns):
            # coefficients of the product of (share + met * t) over the other columns: sets of k known ones, added up
            polynomial = [np.ones(len(x)), *(np.zeros(len(x)) for _ in range(d - 1))]
            for j in range(d):
                if j != i:
                    for k in range(d - 1, -1, -1):
                        polynomial[k] = polynomial[k] * shares[j] + (polynomial[k - 1] * met[j] if k else 0.0)
            made[:, c] += leaf.value * (met[i] - shares[i]) * sum(w * p for w, p in zip(weights, polynomial, strict=True))
    return made


def attributed(fitted: Fitted, rows: DataFrame, columns: list[str], keep: list[str]) -> DataFrame:
    """``keep`` and the attribution of each row's raw score: base, phi (an array, in the order of ``columns``) and raw_score.

    base and phi add up to raw_score, the margin that the trees give (for a classifier, half the log odds of its
    probability). Missing values are the fitted medians.
    """
    found = leaves(fitted, rows.sparkSession)
    base = base_value(found)
    medians = np.array([fitted.medians[c] for c in columns])
    kept = rows.select(*keep, F.array(*[F.col(c).cast("double") for c in columns]).alias("_x"))

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("_x").flatten().to_numpy(zero_copy_only=False), dtype=float).reshape(batch.num_rows, len(columns))
            x = np.where(np.isnan(x), medians, x)
            phi = shapley_values(found, x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * len(columns), pa.int32()), pa.array(phi.reshape(-1)))
            others = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*others, pa.array(np.full(batch.num_rows, base)), lists, pa.array(base + phi.sum(axis=1))], names=[*keep, "base", "phi", "raw_score"])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(explain, f"{kinds}, base double, phi array<double>, raw_score double")


def mean_attributions(attributed_rows: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Mean absolute attribution of each column: over all rows (of_all, groups null) and for each value of ``groups``."""
    each = attributed_rows.select(*groups, F.explode(F.arrays_zip(F.array(*map(F.lit, columns)).alias("feature"), F.col("phi").alias("value"))).alias("c"))
    parts = each.select(*groups, F.col("c.feature").alias("feature"), F.abs("c.value").alias("moved"))
    return parts.groupingSets([["feature"], ["feature", *groups]], "feature", *groups).agg(F.avg("moved").alias("moved"), F.count(F.lit(1)).alias("n"), (F.grouping(groups[0]) == 1).alias("of_all"))
