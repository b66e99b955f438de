"""Events: all variables of one forecast day, and whether the forecast was badly wrong."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nimbora.functions.circular import deviation
from nimbora.operators.quantiles import quantiles

KEYS = ["region_id", "init_date", "valid_date", "lead_time_days"]

#: The bands' cuts where scores are too few or too alike.
DEFAULT_CUTS = (0.33, 0.66)


#: Places to which errors and thresholds are rounded: means of the same values, summed in another order, differ in their
#: last bits, and a label must not hang on those.
PLACES = 9


def event_rows(paired: DataFrame, angle: str) -> DataFrame:
    """Means over members for each event and variable; the error is that of the means, the spread of an angle circular."""
    turn = F.radians("forecast_value")
    length = F.sqrt(F.pow(F.avg(F.sin(turn)), F.lit(2.0)) + F.pow(F.avg(F.cos(turn)), F.lit(2.0)))
    rows = paired.groupBy(*KEYS, "variable").agg(
        F.avg("forecast_value").alias("fc_mean"),
        F.avg("observed_value").alias("obs_mean"),
        F.avg("abs_error").alias("pred_err"),
        F.when(F.count("forecast_value") < 2, None).when(F.col("variable") == angle, deviation(length)).otherwise(F.stddev_samp("forecast_value")).alias("spread"),
        F.count(F.lit(1)).alias("n_rows"),
    )
    return rows.withColumn("actual_err", F.round(F.abs(F.col("fc_mean") - F.col("obs_mean")), PLACES))


def thresholds(rows: DataFrame, error: str, share: float, name: str) -> DataFrame:
    """The exact percentile of an error for each variable."""
    return quantiles(rows, F.col(error), {name: share}, ["variable"]).select("variable", F.round(name, PLACES).alias(name))


def bust_ratio() -> Column:
    """A row's error against its variable's threshold; null where the threshold is not above 0."""
    return F.when(F.col("bust_threshold") > 0, F.round(F.col("actual_err"), PLACES) / F.round(F.col("bust_threshold"), PLACES))


def label(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds up an event's variables: the largest error against its threshold, and y_bust where it reaches 1.

    Events without any usable variable are dropped.
    """
    made = rows.join(F.broadcast(cuts), "variable").groupBy(*KEYS).agg(F.max(bust_ratio()).alias("bust_ratio"))
    return made.where("bust_ratio IS NOT NULL").withColumn("y_bust", (F.col("bust_ratio") >= 1).cast("int"))


def pivot(rows: DataFrame, variables: list[str], values: list[str], *more: Column) -> DataFrame:
    """One row for each event with value_variable columns in a fixed order, and ``more`` aggregates."""
    made = [F.avg(F.when(F.col("variable") == v, F.col(c))).alias(f"{c}_{v}") for v in variables for c in values]
    return rows.groupBy(*KEYS).agg(*made, *more)


def across(columns: list[Column]) -> tuple[Column, Column]:
    """Mean and largest of the columns that are not null."""
    known = F.array_compact(F.array(*columns))
    return F.try_divide(F.aggregate(known, F.lit(0.0), lambda a, x: a + x), F.size(known)), F.array_max(known)


def confidence(error: Column, p90: Column) -> Column:
    """1 minus the predicted error against its usual largest, from 0 to 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - F.try_divide(error, p90)))


def dominant(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """For each event the variable whose predicted error is largest against its threshold; names break ties."""
    ratio = F.col("pred_err") / F.col("bust_threshold")
    known = rows.join(F.broadcast(cuts), "variable").where("bust_threshold > 0").withColumn("ratio", ratio).where("ratio IS NOT NULL")
    return known.groupBy(*KEYS).agg(F.max("ratio").alias("top_ratio"), F.min_by("variable", F.struct(-F.col("ratio"), "variable")).alias("dominant_variable"))


def band_cuts(scores: DataFrame, score: str) -> DataFrame:
    """The one row (medium, high) of cuts: the scores' 50 % and 80 % points, or the defaults for few or like scores."""
    made = quantiles(scores, F.col(score), {"q50": 0.5, "q80": 0.8, "least": 0.0, "most": 1.0}, count="n")
    plain = (F.col("n") < 20) | (F.col("most") - F.col("least") <= 1e-8)
    above = F.when(F.col("q80") <= F.col("q50"), F.least(F.lit(1.0), F.col("q50") + 1e-3)).otherwise(F.col("q80"))
    return made.select(F.when(plain, DEFAULT_CUTS[0]).otherwise(F.col("q50")).alias("medium"), F.when(plain, DEFAULT_CUTS[1]).otherwise(above).alias("high"))


def band(score: Column, medium: Column, high: Column) -> Column:
    """The risk band of a score."""
    return F.when(score.isNull(), "unknown").when(score >= high, "high").when(score >= medium, "medium").otherwise("low")


def bust_frequency(rows: DataFrame, cuts: DataFrame, season: Column) -> DataFrame:
    """Share of rows of a region and season whose error is above its variable's cut (null errors count as not)."""
    above = F.coalesce(F.round("abs_error", PLACES) > F.col("cut"), F.lit(False)).cast("double")
    return rows.join(F.broadcast(cuts), "variable").groupBy("region_id", season.alias("season")).agg(F.avg(above).alias("frequency"), F.count(F.lit(1)).alias("n_rows"))


def season_of(date: Column) -> Column:
    """Winter, pre-monsoon, monsoon and post-monsoon by month."""
    m = F.month(date)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8, 9), "JJAS").otherwise("ON")


def split_cycles(rows: DataFrame, train: float = 0.70, validate: float = 0.85, embargo: int = 10) -> DataFrame:
    """init_date and split: cycles by order, without those so near the next part that their days overlap it.

    Each part but the last holds a cycle at least. Validation keeps its distance from the test; training from what is
    left of validation, or, where nothing is, from the test. Fewer than three cycles are all for training.
    """
    cycles = rows.where("init_date IS NOT NULL").select("init_date").distinct()
    w = Window.orderBy("init_date")  # one row a cycle: a small table
    placed = cycles.select("init_date", (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("n"))
    a = F.greatest(F.lit(1), F.bround(F.col("n") * train))
    b = F.greatest(a + 1, F.bround(F.col("n") * validate))
    part = F.when((F.col("n") < 3) | (F.col("k") < a), "train").when(F.col("k") < b, "val").otherwise("test")
    return _apart(placed.select("init_date", part.alias("split")), embargo)


def split_year(rows: DataFrame, year: int, train: float = 0.70, validate: float = 0.85, embargo: int = 10) -> DataFrame:
    """init_date and split: the cycles of ``year`` are the test, those of earlier years are cut into training and validation."""
    cycles = rows.where("init_date IS NOT NULL").where(F.year("init_date") <= year).select("init_date").distinct()
    early = F.year("init_date") < year
    w = Window.partitionBy(early).orderBy("init_date")  # one row a cycle: a small table
    placed = cycles.select("init_date", early.alias("early"), (F.row_number().over(w) - 1).alias("k"), F.count(F.lit(1)).over(Window.partitionBy(early)).alias("n"))
    a = F.least(F.greatest(F.lit(1), F.bround(F.col("n") * train / validate)), F.col("n") - 1)
    part = F.when(~F.col("early"), "test").when((F.col("n") < 2) | (F.col("k") < a), "train").otherwise("val")
    return _apart(placed.select("init_date", part.alias("split")), embargo)


def _apart(named: DataFrame, embargo: int) -> DataFrame:
    """Drops the cycles of a part that lie within ``embargo`` days of the next one."""

    def first(part: str, frame: DataFrame) -> DataFrame:
        return F.broadcast(frame.agg(F.min(F.when(F.col("split") == part, F.col("init_date"))).alias(f"_{part}")))

    def near(edge: Column) -> Column:
        return F.coalesce(F.col("init_date") > F.date_sub(edge, embargo), F.lit(False))

    kept = named.crossJoin(first("test", named)).where(~((F.col("split") == "val") & near(F.col("_test"))))
    again = kept.crossJoin(first("val", kept))
    return again.where(~((F.col("split") == "train") & near(F.coalesce("_val", "_test")))).select("init_date", "split")
