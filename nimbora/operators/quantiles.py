"""Exact quantiles by rank, for groups of any size.

An exact percentile as an aggregate holds every distinct value of a group in one task. Here the distinct values are
counted and dealt into ranges; the ranges' sums tell which of them hold the asked ranks, and only in those are running
counts made and values picked out: no task holds more than a range, even where one group is the whole table.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.operators.ordered import by_ranges, written


def quantiles(rows: DataFrame, value: Column, shares: dict[str, float], by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """The quantiles ``shares`` (name to share, from 0 to 1) of ``value`` within each group of ``by``.

    Between two ranks the values are interpolated. Nulls do not count; a group without any value has no row, and without
    ``by`` there is one row in any case. ``count`` names a column for the number of values.
    """
    by = by or []
    known = rows.select(*by, value.cast("double").alias("_v")).where("_v IS NOT NULL")
    dealt = by_ranges(known.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c")), [*map(F.col, by), F.col("_v")])
    places = [(F.col("_n") - 1) * F.lit(float(share)) for share in shares.values()]
    ranks = [(f"_{name}{k}", rank(place)) for k, place in enumerate(places) for name, rank in (("low", F.floor), ("high", F.ceil))]
    met = _holding(dealt, [rank for _, rank in ranks], by)
    inner = Window.partitionBy(*by, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = met.withColumn("_upto", F.col("_before") + F.sum("_c").over(inner))
    parts = [F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank), F.col("_v"))).alias(name) for name, rank in ranks]
    found = run.groupBy(*by).agg(F.max("_n").alias("_n"), *parts)
    made = []
    for k, (name, place) in enumerate(zip(shares, places, strict=True)):
        low, high, part = F.col(f"_low{k}"), F.col(f"_high{k}"), place - F.floor(place)
        made.append(F.when(low == high, low).otherwise((1 - part) * low + part * high).alias(name))
    return found.select(*by, *made, *([F.coalesce("_n", F.lit(0)).cast("long").alias(count)] if count else []))


def _holding(dealt: DataFrame, ranks: list[Column], by: list[str]) -> DataFrame:
    """The rows of the ranges that hold one of ``ranks`` of their group, with the count before the range and the group's (_n)."""
    # a row for each range and group that it holds part of: few, as a range holds neighbours in order
    every = Window.partitionBy(*by)
    totals = dealt.groupBy(*by, "_range").agg(F.sum("_c").alias("_in"))
    upto = F.sum("_in").over(every.orderBy("_range").rowsBetween(Window.unboundedPreceding, 0))
    placed = totals.withColumns({"_to": upto, "_n": F.sum("_in").over(every)}).withColumn("_before", F.col("_to") - F.col("_in"))
    asked = functools.reduce(lambda a, b: a | b, [(F.col("_to") > rank) & (F.col("_before") <= rank) for rank in ranks])
    # written, so that its size is known when it is joined; groups meet null-safely, so that null is a group like others
    named = written(placed.where(asked).select(*[F.col(c).alias(f"_of_{c}") for c in [*by, "_range"]], "_before", "_n"))
    same = F.col("_range") == F.col("_of__range")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return dealt.join(named, same).drop(*[f"_of_{c}" for c in [*by, "_range"]])
