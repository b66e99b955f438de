"""Ingest: header matching, sentinels, reshaping, units and dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def plain_header(name: Column) -> Column:
    """Lower case, other characters than letters and digits as single underscores, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def without_sentinels(value: Column, sentinels: list[float]) -> Column:
    """Null where a number stands for missing."""
    return F.when(~F.isnan(value) & ~value.isin(sentinels), value)


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two headers' tokens."""
    x, y = F.array_distinct(F.split(a, "_")), F.array_distinct(F.split(b, "_"))
    return F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))


def numeric_share(rows: DataFrame, column: str) -> DataFrame:
    """Share of non-null texts that read as numbers."""
    return rows.agg((F.count(F.expr(f"try_cast({column} AS double)")) / F.count(column)).alias("numeric_share"))


def to_long(rows: DataFrame, keys: list[str], values: list[str], name: str = "variable", value: str = "value") -> DataFrame:
    """One row for each key and value column; nulls are left out."""
    return rows.unpivot(keys, values, name, value).where(F.col(value).isNotNull())


def day_of_year(year: Column, day: Column) -> Column:
    """The date of a year's n-th day."""
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (day - 1).cast("int"))


def converted(value: Column, unit: Column) -> Column:
    """Values in the store's units: celsius, hectopascal, millimetres, percent."""
    return (
        F.when(unit == "K", value - 273.15)
        .when(unit == "F", (value - 32.0) * 5.0 / 9.0)
        .when(unit == "Pa", value / 100.0)
        .when(unit == "m", value * 1000.0)
        .when(unit == "fraction", value * 100.0)
        .otherwise(value)
    )


def dates(init: Column, valid: Column, lead: Column) -> tuple[Column, Column, Column]:
    """Fills in the one of initial date, valid date and lead that is missing. An upload's lead is the days between them."""
    return (
        F.coalesce(init, F.date_sub(valid, lead.cast("int"))),
        F.coalesce(valid, F.date_add(init, lead.cast("int"))),
        F.coalesce(lead.cast("int"), F.datediff(valid, init)),
    )


#: A table of names is sent to all executors up to this number of rows, else joined by a shuffle.
BROADCAST_NAMES = 100_000


def resolve(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Adds region_id by the plain form of a name (``names``: name, region_id); null where none or more than one fits."""
    plain = names.select(plain_header(F.col("name")).alias("_plain"), "region_id").where(F.col("_plain").isNotNull()).distinct()
    known = plain.groupBy("_plain").agg(F.min("region_id").alias("region_id"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")
    small = names.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    return rows.withColumn("_plain", plain_header(F.col(column))).join(F.broadcast(known) if small else known, "_plain", "left").drop("_plain")


def range_scores(rows: DataFrame, columns: list[str], ranges: dict[str, tuple[float, float]], least: float = 0.6) -> DataFrame:
    """For each column and each variable of ``ranges`` (low, high): the share of the column's numbers within, and whether that is
    ``least`` or more (plausible).

    Texts that are no numbers do not count. A column without numbers has a null share and is plausible: nothing speaks
    against it. All rows count, by one aggregation.
    """
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").try_cast("double").alias("x")) for c in columns])).alias("c")
    numbers = rows.select(each).select("c.column", "c.x")
    made = numbers.groupBy("column").agg(*[F.avg(F.when(F.col("x").isNotNull(), F.col("x").between(low, high).cast("double"))).alias(name) for name, (low, high) in ranges.items()])
    long = made.unpivot(["column"], list(ranges), "variable", "share")
    return long.withColumn("plausible", F.coalesce(F.col("share") >= least, F.lit(True)))


def finite(value: Column) -> Column:
    """A number that is neither NaN nor infinite, else null."""
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
