"""Reductions in time: forecast hours and hourly stamps to days, cells to regions, members to planes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.functions import moisture
from nimbora.functions.circular import heading

#: Stamps of a whole day, the step of the instants that a forecast's own day is built from, and how many those are.
STAMPS, STEP, INSTANTS = 24, 3, 8


def lead_day(init: Column, hour: Column) -> tuple[Column, Column]:
    """The day that a forecast hour belongs to (its end counts to the day before) and the lead, from 1."""
    day = F.to_date(F.timestamp_add("SECOND", hour * 3600 - 1, init))
    return day, F.datediff(day, F.to_date(init)) + 1


def steps_by_day(runs: DataFrame, step: int, hours: int) -> DataFrame:
    """For each run (init) and lead its first and last forecast hour, samples, and whether the day is whole."""
    each = runs.select("init", F.explode(F.sequence(F.lit(step), F.lit(hours), F.lit(step))).alias("hour"))
    _, lead = lead_day(F.col("init"), F.col("hour"))
    made = each.groupBy("init", lead.alias("lead")).agg(F.min("hour").alias("first_hour"), F.max("hour").alias("last_hour"), F.count(F.lit(1)).alias("samples"))
    return made.withColumn("whole", F.col("samples") == STAMPS // step)


def stamped_day(time: Column) -> Column:
    """The day of an hourly stamp, which closes the hour before it."""
    return F.to_date(F.timestamp_add("HOUR", F.lit(-1), time))


def _whole_days(hourly: DataFrame, cell: list[str]) -> tuple[DataFrame, list[str]]:
    return hourly.withColumn("day", stamped_day(F.col("time"))), [*cell, "day"]


def daily(hourly: DataFrame, cell: list[str]) -> DataFrame:
    """Days of cells from hourly t, td (kelvin), sp (pascal), u, v and rain (metres); days without all 24 stamps are left out.

    Humidity is the mean of the hours', rain their sum in millimetres, wind that of the mean vector.
    """
    rows, keys = _whole_days(hourly, cell)
    humid = moisture.relative_humidity(moisture.humidity_from_dewpoint(F.col("td"), F.col("sp")), F.col("t"), F.col("sp"))
    made = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.avg("t").alias("t"), F.avg(humid).alias("rh"), F.sum("rain").alias("rain"), F.avg("sp").alias("sp"), F.avg("u").alias("u"), F.avg("v").alias("v")
    ).where(F.col("_n") == STAMPS)
    return made.select(*keys, (F.col("t") - 273.15).alias("t_c"), "rh", (F.col("rain") * 1000).alias("rain_mm"), (F.col("sp") / 100).alias("sp_hpa"), moisture.wind_speed(F.col("u"), F.col("v")).alias("speed"), moisture.wind_from(F.col("u"), F.col("v")).alias("direction"))


def cells_daily(hourly: DataFrame, cell: list[str]) -> DataFrame:
    """Components of whole days: rain over 24 hours, all else the mean of the eight 3-hourly instants, null where one lacks a value."""
    rows, keys = _whole_days(hourly, cell)
    instant = F.hour("time") % STEP == 0
    q = moisture.humidity_from_dewpoint(F.col("td"), F.col("sp"))

    def mean(value: Column, name: str) -> Column:
        at = F.when(instant, value)
        return F.when(F.count(at) == INSTANTS, F.avg(at)).alias(name)

    whole = F.when(F.count("rain") == STAMPS, F.sum("rain") * 1000)
    made = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), mean(F.col("t"), "t"), mean(q, "q"), mean(F.col("sp"), "sp"), mean(F.col("u"), "u"), mean(F.col("v"), "v"), mean(F.col("soil"), "soil"), whole.alias("rain_mm"))
    return made.where(F.col("_n") == STAMPS).drop("_n")


#: What a region's value is made of; a gap in one of these voids it.
NEEDS = {"t_c": ["t"], "rh": ["q", "t", "sp"], "rain_mm": ["rain_mm"], "speed": ["u", "v"], "direction": ["u", "v"], "soil_pct": ["soil"]}


def regions_daily(days: DataFrame, weights: DataFrame, land: str = "land", least_land: float = 0.5, void_gaps: bool = False) -> DataFrame:
    """Values of regions from components of cells (keyed cell, day) and ``weights`` (cell, region_id, weight, land share).

    Components are averaged over a region first; humidity and wind come from the means. Soil is taken from land cells
    alone. Cells without a value are left out of a mean; with ``void_gaps`` a region with weight on a cell that lacks a
    value (for soil, a land cell) has no value of what needs it.
    """
    met = days.join(weights, "cell")
    on_land = F.col(land) >= least_land

    def mean(c: str) -> Column:
        known = F.col(c).isNotNull() & on_land if c == "soil" else F.col(c).isNotNull()
        w = F.when(known, F.col("weight"))
        return F.try_divide(F.sum(w * F.col(c)), F.sum(w)).alias(c)

    def gap(c: str) -> Column:
        missing = F.col(c).isNull() & on_land if c == "soil" else F.col(c).isNull()
        return F.max((missing & (F.col("weight") > 0)).cast("int")).alias(f"gap_{c}")

    parts = ["t", "q", "sp", "u", "v", "soil", "rain_mm"]
    means = met.groupBy("region_id", "day").agg(*[f(c) for c in parts for f in (mean, gap)])
    values = {
        "t_c": F.col("t") - 273.15,
        "rh": moisture.relative_humidity(F.col("q"), F.col("t"), F.col("sp")),
        "rain_mm": F.col("rain_mm"),
        "speed": moisture.wind_speed(F.col("u"), F.col("v")),
        "direction": moisture.wind_from(F.col("u"), F.col("v")),
        "soil_pct": F.col("soil") * 100,
    }

    def kept(name: str) -> Column:
        gaps = sum((F.col(f"gap_{c}") for c in NEEDS[name]), F.lit(0))
        return F.when(gaps == 0, values[name]) if void_gaps else values[name]

    return means.select("region_id", "day", *[kept(n).alias(n) for n in values])


def plane_statistics(members: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and population deviation over the members of each cell; null where no member has a value."""
    return members.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("deviation"), F.count(value).alias("members"))


def plane_directions(members: DataFrame, by: list[str], angle: str) -> DataFrame:
    """Mean direction over the members of each cell."""
    turn = F.radians(F.col(angle))
    return members.groupBy(*by).agg(heading(F.avg(F.sin(turn)), F.avg(F.cos(turn))).alias("direction"))


def quarter(degrees: Column) -> Column:
    """A coordinate as a whole number of quarter degrees."""
    return F.rint(degrees * 4).cast("int")


def plain_longitude(degrees: Column) -> Column:
    """A longitude from -180 up to but without 180."""
    return F.pmod(degrees + 180.0, F.lit(360.0)) - 180.0


def regrid(plane: DataFrame, domain: DataFrame, value: str) -> DataFrame:
    """``domain`` (lat, lon) with the plane's value at the same quarter degree; longitudes meet round the globe, null where none."""
    keyed = plane.select(quarter(F.col("lat")).alias("_la"), F.pmod(quarter(F.col("lon")), F.lit(1440)).alias("_lo"), value)
    wanted = domain.withColumns({"_la": quarter(F.col("lat")), "_lo": F.pmod(quarter(F.col("lon")), F.lit(1440))})
    return wanted.join(keyed, ["_la", "_lo"], "left").drop("_la", "_lo")


def repaired_dates(rows: DataFrame, kind: str = "forecast", days: int = 1) -> DataFrame:
    """Rows of ``kind`` moved back by so many days; others stay."""
    return rows.withColumn("valid_date", F.when(F.col("value_type") == kind, F.date_sub("valid_date", days)).otherwise(F.col("valid_date")))


def gauge_day(day: Column) -> Column:
    """The model day that a gauge day, which is named for its end at 03 UTC, is compared with."""
    return F.date_sub(day, 1)


def assembled(parts: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """One column a variable: full outer assembly of frames (keys, value), done by one grouping; repeated keys are averaged."""
    long = None
    for name, part in parts.items():
        tagged = part.select(*keys, F.lit(name).alias("_name"), "value")
        long = tagged if long is None else long.unionByName(tagged)
    return long.groupBy(*keys).agg(*[F.avg(F.when(F.col("_name") == n, F.col("value"))).alias(n) for n in parts])


def lagged_agreement(rain: DataFrame, other: DataFrame, lags: list[int], least: int = 30) -> DataFrame:
    """For each lag the mean over regions of the rank correlation of ``rain`` with ``other`` so many days later.

    Both have region_id, day and value. Regions with fewer than ``least`` pairs or without any change are left out.
    """
    from pyspark.sql import Window

    moved = other.select("region_id", "day", F.col("value").alias("other")).withColumn("lag", F.explode(F.array(*map(F.lit, lags)))).withColumn("day", F.expr("date_sub(day, lag)"))
    pairs = rain.join(moved, ["region_id", "day"]).where("value IS NOT NULL AND other IS NOT NULL")
    w = Window.partitionBy("lag", "region_id")

    def rank(c: str) -> Column:
        return F.rank().over(w.orderBy(c)) + (F.count(F.lit(1)).over(Window.partitionBy("lag", "region_id", c)) - 1) / 2

    ranked = pairs.select("lag", "region_id", rank("value").alias("a"), rank("other").alias("b"))
    each = ranked.groupBy("lag", "region_id").agg(F.corr("a", "b").alias("rho"), F.count(F.lit(1)).alias("n"), F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"))
    return each.where((F.col("n") >= least) & (F.col("sa") > 0) & (F.col("sb") > 0)).groupBy("lag").agg(F.avg("rho").alias("rho"), F.count(F.lit(1)).alias("regions"))
