"""Grid cells: weighted means over areas, daily reductions, quantising, merging of ranges, polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions.circular import heading


def weighted_mean(rows: DataFrame, by: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean over the rows whose value is known; null where their weights add up to nothing."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(F.try_divide(F.sum(w * F.col(value)), F.sum(w)).alias("mean"), F.count(value).alias("n"))


def weighted_direction(rows: DataFrame, by: list[str], angle: str, weight: str) -> DataFrame:
    """Weighted mean direction."""
    turn, w = F.radians(F.col(angle)), F.when(F.col(angle).isNotNull(), F.col(weight))
    return rows.groupBy(*by).agg(heading(F.try_divide(F.sum(w * F.sin(turn)), F.sum(w)), F.try_divide(F.sum(w * F.cos(turn)), F.sum(w))).alias("direction"))


def complete_days(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Rows of those groups that have at least so many."""
    return rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") >= least).drop("_n")


def daily(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, sum, extremes and count of each group's values, and null sums where one is missing."""
    whole = F.count(value) == F.count(F.lit(1))
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.when(whole, F.sum(value)).alias("total"), F.min(value).alias("least"), F.max(value).alias("most"), F.count(F.lit(1)).alias("n"))


def quantised(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """Adds code and restored: steps of at least 0.01 about the middle of the group's range, in 16 bits."""
    ends = rows.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    met = rows.join(ends, by)
    step = F.greatest(F.lit(0.01), (F.col("_high") - F.col("_low")) / 65534)
    middle = F.col("_low") + (F.col("_high") - F.col("_low")) / 2
    code = F.rint((F.col(value) - middle) / step).cast("int")
    return met.withColumns({"code": code, "restored": code * step + middle}).drop("_low", "_high")


def merged_ranges(rows: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Ranges that touch or overlap made one."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.when(F.col(start) <= reach, 0).otherwise(1)
    marked = rows.withColumn("_fresh", fresh).withColumn("_island", F.sum("_fresh").over(w))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def overlap_hours(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """Hours that two time windows share."""
    shared = F.least(end, other_end).cast("double") - F.greatest(start, other_start).cast("double")
    return F.greatest(F.lit(0.0), shared / 3600.0)


def inside(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a polygon, by the even-odd rule; ``ring`` is an array of (x, y), not closed."""
    n = F.size(ring)

    def crossing(count: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        spans = (a["y"] > y) != (b["y"] > y)
        return count + F.when(spans & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]), 1).otherwise(0)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), crossing) % 2 == 1


def ring_area(ring: Column) -> Column:
    """Area of a polygon in its own units."""
    n = F.size(ring)

    def part(total: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return total + a["x"] * b["y"] - b["x"] * a["y"]

    return F.abs(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), part)) / 2
