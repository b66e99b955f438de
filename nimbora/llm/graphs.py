"""Connected components of a graph given by its edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbora.llm.common import materialise


def components(edges: DataFrame) -> DataFrame:
    """For each vertex of ``edges`` (a, b): id and component, the smallest id it is connected with.

    Each round a vertex takes the least label among its neighbours', then the label of its label, so the rounds grow
    with the logarithm of the longest path. Labels are written after each round; nothing is gathered on the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("near")).select("id", F.least("id", "near").alias("component")))
    while True:
        offers = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("offer"))
        better = materialise(labels.join(offers, labels["id"] == offers["a"], "left").select("id", F.least("component", "offer").alias("label"), F.col("component").alias("old")))
        known = better.select(F.col("id").alias("key"), F.col("label").alias("next"))
        jumped = materialise(better.join(known, better["label"] == known["key"], "left").select("id", F.least("label", "next").alias("component"), "old"))
        labels = jumped.select("id", "component")
        if jumped.where("component <> old").isEmpty():
            return labels
