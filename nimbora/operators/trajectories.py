"""How the forecasts for one day change from run to run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions.circular import deviation, heading, wrapped

SERIES = ["region_id", "variable", "valid_date"]

#: Earlier runs that are looked at.
EARLIER = 4


def jumpiness(means: DataFrame, angle: str) -> DataFrame:
    """Adds jump_abs, jump_std and jump_flips to run means (region_id, variable, valid_date, init_date, fc_mean).

    Steps between angles are wrapped. The deviation is that of values rebuilt from the steps, over this and at most
    four earlier runs; it and the number of reversals, without flat steps, need three runs.
    """
    w = Window.partitionBy(*SERIES).orderBy("init_date")
    values = [F.col("fc_mean"), *(F.lag("fc_mean", k).over(w) for k in range(1, EARLIER + 1))]
    rows = means.select("*", *[v.alias(f"_v{k}") for k, v in enumerate(values)])
    is_angle = F.col("variable") == angle

    def step(k: int) -> Column:
        d = F.col(f"_v{k}") - F.col(f"_v{k + 1}")
        return F.when(is_angle, wrapped(d)).otherwise(d)

    rows = rows.select("*", *[step(k).alias(f"_d{k}") for k in range(EARLIER)])
    relative, total = [F.lit(0.0)], F.lit(0.0)
    for k in range(EARLIER):
        total = total - F.col(f"_d{k}")
        relative.append(total)
    known = F.filter(F.array(*relative), lambda x: x.isNotNull())
    n = F.size(known)
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(known, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))

    def turn(acc: Column, d: Column) -> Column:
        s = F.signum(d)
        moved = d.isNotNull() & (s != 0)
        flips = acc["flips"] + F.when((acc["last"] != 0) & (s != acc["last"]), 1).otherwise(0)
        return F.when(moved, F.struct(s.alias("last"), flips.alias("flips"))).otherwise(acc)

    steps = F.array(*[F.col(f"_d{k}") for k in range(EARLIER)])
    flips = F.aggregate(steps, F.struct(F.lit(0.0).alias("last"), F.lit(0).alias("flips")), turn, lambda a: a["flips"])
    made = rows.withColumns({"jump_abs": F.abs("_d0"), "jump_std": F.when(n >= 3, F.sqrt(squares / (n - 1))), "jump_flips": F.when(n >= 3, flips)})
    return made.select(*means.columns, "jump_abs", "jump_std", "jump_flips")


def lagged_pool(own: DataFrame, angle: str) -> DataFrame:
    """Adds laf_size, laf_mean, laf_std and laf_ratio to run statistics (SERIES, init_date, n_members, fc_mean, spread, east, north).

    The run's own members are pooled with the means of up to four earlier runs, each counting as one member; angles are
    pooled as vectors. The ratio of the pool's deviation to the run's own is 1 without earlier runs and null below two
    own members or where the own deviation is 0 and there are earlier runs.
    """
    w = Window.partitionBy(*SERIES).orderBy("init_date").rowsBetween(-EARLIER, -1)
    rows = own.withColumn("_prior", F.collect_list("fc_mean").over(w)).withColumn("_k", F.size("_prior"))
    n, is_angle = F.col("n_members"), F.col("variable") == angle

    def over_prior(of) -> Column:
        return F.aggregate(F.transform("_prior", of), F.lit(0.0), lambda a, x: a + x)

    east = n * F.col("east") + over_prior(lambda x: F.sin(F.radians(x)))
    north = n * F.col("north") + over_prior(lambda x: F.cos(F.radians(x)))
    rows = rows.withColumns({"laf_size": n + F.col("_k"), "_east": east, "_north": north})
    mean = (n * F.col("fc_mean") + over_prior(lambda x: x)) / F.col("laf_size")
    rows = rows.withColumn("laf_mean", F.when(is_angle, heading(F.col("_east"), F.col("_north"))).otherwise(mean))
    own_squares = F.when(n > 1, (n - 1) * F.col("spread") * F.col("spread")).otherwise(0.0)
    between = n * (F.col("fc_mean") - F.col("laf_mean")) * (F.col("fc_mean") - F.col("laf_mean"))
    prior = over_prior(lambda x: (x - F.col("laf_mean")) * (x - F.col("laf_mean")))
    length = F.sqrt(F.col("_east") * F.col("_east") + F.col("_north") * F.col("_north")) / F.col("laf_size")
    pooled = F.when(is_angle, deviation(length)).otherwise(F.sqrt((own_squares + between + prior) / (F.col("laf_size") - 1)))
    rows = rows.withColumn("laf_std", F.when(F.col("laf_size") >= 2, pooled))
    ratio = F.when(n < 2, None).when(F.col("_k") == 0, 1.0).when(F.col("spread") == 0, None).otherwise(F.col("laf_std") / F.col("spread"))
    return rows.withColumn("laf_ratio", ratio).drop("_prior", "_k", "_east", "_north")


def rate_of_change(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds rate: the change of forecast_value a day along valid_date within ``keys``; null at the first and for equal days."""
    w = Window.partitionBy(*keys).orderBy("valid_date")
    days = F.datediff("valid_date", F.lag("valid_date").over(w))
    return rows.withColumn("rate", F.when(days > 0, (F.col("forecast_value") - F.lag("forecast_value").over(w)) / days))


def error_lag(rows: DataFrame) -> DataFrame:
    """Adds error_lag: the error one lead earlier in the same run, variable and member."""
    w = Window.partitionBy("region_id", "init_date", "variable", "member").orderBy("lead_time_days")
    return rows.withColumn("error_lag", F.lag("abs_error").over(w))


def concurrent_columns(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """Each of ``rows`` with the mean forecast of every other variable of its ``keys`` (concurrent_<variable>), its own null."""
    w = Window.partitionBy(*keys)
    means = {f"concurrent_{v}": F.when(F.col("variable") != v, F.avg(F.when(F.col("variable") == v, F.col("forecast_value"))).over(w)) for v in variables}
    return rows.withColumns(means)


def rates_to_all(rows: DataFrame, member: list[str], of: list[str]) -> DataFrame:
    """Each of ``rows`` with the daily change (rate_<variable>) of the variables ``of`` for its ``member`` keys and valid_date.

    A change is known on its own variable's rows alone; it is set down on the rows of all variables.
    """
    rates = rate_of_change(rows.where(F.col("variable").isin(of)), [*member, "variable"])
    wide = rates.groupBy(*member, "valid_date").agg(*[F.avg(F.when(F.col("variable") == v, F.col("rate"))).alias(f"rate_{v}") for v in of])
    return rows.join(wide, [*member, "valid_date"], "left")


def concurrent(rows: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One row for each of ``keys`` with the mean forecast of every variable beside each other."""
    return rows.groupBy(*keys).pivot("variable", variables).agg(F.avg("forecast_value"))


def as_of(dates: DataFrame, readings: DataFrame, days: int) -> DataFrame:
    """The last reading on or before each date (date) among ``readings`` (date, value), null beyond ``days`` days.

    A reading is good for its own day and ``days`` more, so it is set down for each of them, the latest one of a day
    stays, and dates meet it by equality: nothing is ordered as a whole.
    """
    good = readings.select(F.col("date").alias("read_on"), "value", F.explode(F.sequence(F.col("date"), F.date_add("date", days))).alias("date"))
    last = good.groupBy("date").agg(F.max_by("value", "read_on").alias("value"))
    return dates.select("date").join(last, "date", "left").select("date", "value")
