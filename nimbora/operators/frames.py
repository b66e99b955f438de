"""The event frame: one row an event, with everything a model of busts is given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nimbora.functions.circular import heading, wrapped
from nimbora.operators import events
from nimbora.operators.models import LEAST_ROWS, fold_of
from nimbora.operators.trajectories import as_of

RUN = ["region_id", "variable", "valid_date", "init_date"]


def with_trajectories(rows: DataFrame, jumps: DataFrame, pools: DataFrame) -> DataFrame:
    """Event rows by variable with the jumpiness and the lagged pool of their run; null where a run has none."""
    return rows.join(jumps.select(*RUN, "jump_abs", "jump_std", "jump_flips"), RUN, "left").join(pools.select(*RUN, "laf_std", "laf_ratio"), RUN, "left")


def wide(rows: DataFrame, member_p90: DataFrame, variables: list[str]) -> DataFrame:
    """One row an event: conf, jump_abs, laf_ratio and spread by variable, and the mean and largest spread.

    A variable that an event lacks has null columns and no part in the mean. pred_err must be a prediction, not what was
    observed: see ``linear_out_of_fold`` and ``models.predicted_errors``.
    """
    rated = rows.join(F.broadcast(member_p90), "variable", "left").withColumn("conf", events.confidence(F.col("pred_err"), F.col("member_p90")))
    each = [F.avg(F.when(F.col("variable") == v, F.col(c))).alias(f"{c}_{v}") for v in variables for c in ("pred_err", "conf", "spread", "jump_abs", "laf_ratio")]
    return rated.groupBy(*events.KEYS).agg(*each, F.avg("spread").alias("spread_mean"), F.max("spread").alias("spread_max"))


def linear_out_of_fold(rows: DataFrame, k: int = 3, block: int = 3) -> DataFrame:
    """``rows`` (KEYS, variable, actual_err, spread) with pred_err: each error as a line on the spread fitted on the other folds.

    Folds are blocks of runs; the fit of a fold is the sums over all rows less its own, so no row is joined to other
    rows. A missing spread is the other folds' mean. It is null where the others have fewer than LEAST_ROWS rows.
    """
    folded = rows.withColumn("_fold", fold_of(F.col("init_date"), k, block))
    x, y = F.col("spread"), F.col("actual_err")
    both = x.isNotNull() & y.isNotNull()
    sums = {"n": F.count(F.when(both, 1)), "x": F.sum(F.when(both, x)), "y": F.sum(F.when(both, y)), "xx": F.sum(F.when(both, x * x)), "xy": F.sum(F.when(both, x * y))}
    own = folded.groupBy("variable", "_fold").agg(*[F.coalesce(v, F.lit(0)).alias(f"_own_{c}") for c, v in sums.items()])
    whole = own.groupBy("variable").agg(*[F.sum(f"_own_{c}").alias(f"_all_{c}") for c in sums])
    rest = own.join(whole, "variable").select("variable", "_fold", *[(F.col(f"_all_{c}") - F.col(f"_own_{c}")).alias(c) for c in sums])
    slope = F.coalesce(F.try_divide(F.col("n") * F.col("xy") - F.col("x") * F.col("y"), F.col("n") * F.col("xx") - F.col("x") * F.col("x")), F.lit(0.0))
    fits = rest.where(F.col("n") >= LEAST_ROWS).select("variable", "_fold", slope.alias("_slope"), (F.col("x") / F.col("n")).alias("_mx"), (F.col("y") / F.col("n")).alias("_my"))
    met = folded.drop("pred_err").join(F.broadcast(fits), ["variable", "_fold"], "left")  # a row for each variable and fold
    line = F.col("_my") + F.col("_slope") * (F.coalesce(x, F.col("_mx")) - F.col("_mx"))
    return met.withColumn("pred_err", F.when(line.isNotNull(), F.greatest(F.lit(0.0), line))).drop("_fold", "_slope", "_mx", "_my")


def with_predicted(rows: DataFrame, predicted: DataFrame) -> DataFrame:
    """``rows`` with pred_err of ``predicted`` (KEYS, variable, pred_err) in place of their own; null where there is none."""
    return rows.drop("pred_err").join(predicted.select(*events.KEYS, "variable", "pred_err"), [*events.KEYS, "variable"], "left")


def with_season(frame: DataFrame) -> DataFrame:
    """Adds month and season of the valid date."""
    return frame.withColumns({"month": F.month("valid_date"), "season": events.season_of(F.col("valid_date"))})


def with_frequency(frame: DataFrame, frequency: DataFrame) -> DataFrame:
    """Adds the bust frequency of the row's region and season; null where there is none. ``frequency`` has a row for each."""
    found = frequency.select("region_id", "season", F.col("frequency").alias("bust_frequency"))
    return frame.join(found, ["region_id", "season"], "left")


def with_index(frame: DataFrame, readings: DataFrame, days: int = 5) -> DataFrame:
    """Adds index_value: the last reading (date, value) on or before the run's day, null beyond ``days`` days."""
    known = as_of(frame.select(F.col("init_date").alias("date")).distinct(), readings, days)
    return frame.join(known.select(F.col("date").alias("init_date"), F.col("value").alias("index_value")), "init_date", "left")


def as_of_issue(frame: DataFrame, observed: list[str], labels: list[str]) -> DataFrame:
    """The frame as it was when a run was issued: columns derived from observations are null, but for the labels."""
    return frame.withColumns({c: F.lit(None).cast(frame.schema[c].dataType) for c in observed if c in frame.columns and c not in labels})


def drop_saturated(rows: DataFrame, variable: str, limit: float = 99.5, value: str = "forecast_value") -> DataFrame:
    """Drops rows of ``variable`` at or above the value that an archive writes where it has none; nulls stay."""
    return rows.where(~F.coalesce((F.col("variable") == variable) & (F.col(value) >= limit), F.lit(False)))


def drop_excluded(rows: DataFrame, variable: str, excluded: DataFrame) -> DataFrame:
    """Drops rows of ``variable`` in the regions of ``excluded`` (region_id); other variables stay."""
    marked = excluded.select("region_id").where(F.col("region_id").isNotNull()).distinct().withColumn("variable", F.lit(variable))
    return rows.join(marked, ["region_id", "variable"], "left_anti").select(*rows.columns)


def refreshed(rows: DataFrame, observations: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with observed_value and abs_error anew from ``observations`` (keys, observed_value); null where there is none.

    Raises ValueError if ``observations`` repeats a key, which would multiply rows.
    """
    if not observations.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("the observations repeat a key")
    met = rows.drop("observed_value", "abs_error").join(observations.select(*keys, "observed_value"), keys, "left")
    return met.withColumn("abs_error", F.abs(F.col("forecast_value") - F.col("observed_value")))


def signed_errors(paired: DataFrame, angle: str, variables: list[str]) -> DataFrame:
    """One row an event with the signed error of each variable's means (error_<variable>); angles by their mean vectors, the short way round."""

    def middle(value: str) -> Column:
        turn = F.radians(value)
        return F.when(F.col("variable") == angle, heading(F.avg(F.sin(turn)), F.avg(F.cos(turn)))).otherwise(F.avg(value))

    each = paired.groupBy(*events.KEYS, "variable").agg(middle("forecast_value").alias("f"), middle("observed_value").alias("o"))
    signed = F.when(F.col("variable") == angle, wrapped(F.col("f") - F.col("o"))).otherwise(F.col("f") - F.col("o"))
    return each.withColumn("e", signed).groupBy(*events.KEYS).agg(*[F.avg(F.when(F.col("variable") == v, F.col("e"))).alias(f"error_{v}") for v in variables])


def shared_events(rows: DataFrame, others: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``rows`` with the value of ``others`` for the same keys (other_<value>).

    Raises ValueError if ``others`` repeats a key or lacks one of ``rows``: a comparison must be over the same events.
    """
    if not others.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        raise ValueError("the other scores repeat an event")
    met = rows.join(others.select(*keys, F.col(value).alias(f"other_{value}")), keys, "left")
    if not met.where(F.col(f"other_{value}").isNull()).isEmpty():
        raise ValueError("the other scores lack an event")
    return met
